"""Windows, masks and probabilities of the attention model."""

import numpy as np
import pytest

from strandwork.llm import lm_scoring

S = lm_scoring.Settings()


def _texts(rng, sizes, ids=900):
    return [np.asarray((rng.zipf(1.3, n) - 1) % ids, np.uint16) for n in sizes]


def _model(texts, s=S, learn=True):
    flat = np.concatenate(texts).astype(np.int64)
    count = np.bincount(flat, minlength=s.vocabulary).astype(float)
    leaves = lm_scoring.arrange(count, np.zeros((s.vocabulary, 2 * s.profile)), s)
    trainer = lm_scoring.Trainer(lm_scoring.draw(s, leaves, count), leaves, s, 1, s.rate)
    if learn:
        trainer.learn(texts)
    return lm_scoring.Model(trainer.w, leaves, s)


@pytest.mark.parametrize("stride", [S.window, S.stride])
def test_every_id_is_a_target_once(stride):
    texts = [np.arange(n, dtype=np.uint16) for n in (1, 5, S.window, S.window + 1, 1000, 1)]
    rank = np.arange(S.vocabulary)
    cut = lm_scoring.Windows(texts, rank, S, stride)
    x, y, real = cut.batch(slice(None))
    at = cut.start[:, None] + cut.column
    assert sorted(at[real].tolist()) == list(range(sum(map(len, texts))))
    assert (y[real] == cut.flat[at[real]]).all()
    # the input is the id before, or the start of the text
    first = np.isin(at[real], cut.begins)
    assert (x[real][first] == S.known + 1).all()
    assert (x[real][~first] == cut.flat[at[real][~first] - 1]).all()


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    model = _model(_texts(rng, (4000, 300)))
    h, _ = lm_scoring.hidden(model.weights, rng.integers(0, 900, (1, S.window)))
    for state in h[[0, 5, -1]]:
        every = np.arange(S.known + 1)
        logs = lm_scoring.log_probability(model.weights, model.leaves, S, np.repeat(state[None], len(every), 0), every)
        present = (model.leaves.inside >= 0) | (model.leaves.leaf < S.own) | (every == S.known)
        assert np.exp(logs[present]).sum() == pytest.approx(1, abs=1e-3)
    rare = model.leaves.rank == S.known
    assert (10 ** model.leaves.share[rare]).sum() == pytest.approx(1, abs=1e-6)


def test_no_look_ahead():
    rng = np.random.default_rng(1)
    model = _model(_texts(rng, (3000,)))
    x = rng.integers(0, 900, (2, S.window))
    x[1] = x[0]
    x[1, 20:] = rng.integers(0, 900, S.window - 20)
    h, _ = lm_scoring.hidden(model.weights, x)
    h = h.reshape(2, S.window, -1)
    assert np.allclose(h[0, :20], h[1, :20], atol=1e-5) and not np.allclose(h[0, 20:], h[1, 20:], atol=1e-3)


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    s = lm_scoring.Settings(vocabulary=300, known=200, own=8, clusters=6, dim=4, hidden=6, window=7, end_id=299)
    texts = _texts(rng, (200, 50), 290)
    model = _model(texts, s, learn=False)
    x, y, real = lm_scoring.Windows(texts, model.leaves.rank, s, s.window).batch(slice(0, 12))
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def loss():
        h, _ = lm_scoring.hidden(w, x)
        return -lm_scoring.log_probability(w, model.leaves, s, h, y.ravel())[real.ravel()].mean()

    g = lm_scoring.gradients(w, model.leaves, s, x, y, real)
    for name, v in w.items():
        for at in rng.choice(v.size, 5, replace=False):
            keep = v.flat[at]
            v.flat[at] = keep + 1e-4
            more = loss()
            v.flat[at] = keep - 1e-4
            less = loss()
            v.flat[at] = keep
            assert g[name].flat[at] == pytest.approx((more - less) / 2e-4, abs=2e-5), name


def test_scores_do_not_depend_on_company():
    rng = np.random.default_rng(3)
    texts = _texts(rng, (1, 10, 33, 400, 1000))
    model = _model(texts)
    together = model.score(texts)
    assert together == pytest.approx([model.score([t])[0] for t in texts], rel=1e-5)


def test_learns_what_follows():
    """After training on texts where an id tells the next one, unseen texts of the kind score better than by counts."""
    rng = np.random.default_rng(4)
    step = rng.permutation(200)

    def text(n):
        out = [int(rng.integers(200))]
        while len(out) < n:
            out.append(int(step[out[-1]]) if rng.random() < 0.8 else int(rng.integers(200)))
        return np.asarray(out, np.uint16)

    texts = [text(300) for _ in range(300)]
    model, plain = _model(texts), _model(texts, learn=False)
    unseen = [text(300) for _ in range(20)]
    assert model.score(unseen).mean() > plain.score(unseen).mean() + 30


def test_small_table_of_words(spark, odd_dir, docs_of):
    """The base score is the same however few words travel as a table."""
    from strandwork.llm import entry

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    path = entry.tokenizer_path("word_bpe_49k.json")
    got = [{r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm_scoring.score(docs, path, s=lm_scoring.Settings(top=top, longest=longest)).collect()} for top, longest in ((1 << 17, 64), (3, 4))]
    assert got[0] == got[1]


def test_clusters_go_together(monkeypatch):
    """Clusters of several sizes in few runs: the same as a softmax over each row's own cluster, number by number."""
    rng = np.random.default_rng(5)
    s = lm_scoring.Settings(vocabulary=700, known=600, own=8, clusters=11, dim=4, hidden=6, window=7, end_id=699)
    model = _model([np.arange(698, dtype=np.uint16), *_texts(rng, (4000, 50), 690)], s)
    w, leaves = model.weights, model.leaves
    assert len(set(leaves.sizes.tolist())) > 1 and leaves.sizes.sum() == 592
    h = rng.standard_normal((6000, s.dim)).astype(np.float32)
    y = rng.integers(0, s.known + 1, len(h))
    times = []
    real = lm_scoring._exp
    monkeypatch.setattr(lm_scoring, "_exp", lambda *x: (times.append(1), real(*x))[1])
    got = lm_scoring.log_probability(w, leaves, s, h, y)
    assert len(times) <= 9  # not one a cluster

    def share(z, at):
        z = z.astype(np.float64)
        return z[at] - np.log(np.exp(z - z.max()).sum()) - z.max()

    for i in [*range(0, 6000, 7)]:
        want = share(h[i] @ w["U"] + w["b"], leaves.leaf[y[i]])
        if leaves.inside[y[i]] >= 0:
            c = leaves.leaf[y[i]] - s.own
            n = leaves.sizes[c]
            want += share(h[i] @ w["D"][c, :, :n] + w["e"][c, :n], leaves.inside[y[i]])
        assert got[i] == pytest.approx(want, abs=1e-3)
