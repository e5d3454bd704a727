"""Near copies against the exact Jaccard of all pairs."""

import random

import corpus_pipeline
from strandwork.llm import near_groups
from tests.conftest import SMALL
from tests.llm import brute


def _low(docs, similarity=0.8):
    """Smallest id of each row's group, by the shingle sets of all pairs."""
    sets = [set(x.tolist()) for x in near_groups.shingles_of([t.encode() for _, t in docs])]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) / len(a | b) >= similarity):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(docs))]


def _copies(rng, base, edits):
    words = list(base)
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"e{rng.getrandbits(40)}"
    return " ".join(words)


def test_pairs_about_the_limit(spark):
    rng = random.Random(3)
    docs = []
    for k in range(150):  # pairs alike by 0.66 to 0.94, about half of them by 0.8 or more
        base = [f"w{rng.getrandbits(40)}" for _ in range(200)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, _copies(rng, base, 1 + k % 9))]
    docs += [(1000, "a b c d e a b c d e a b c d e"), (1001, "a b c d e"), (1002, "x y"), (1003, "")]
    want = {d for (d, _), low in zip(docs, _low(docs)) if d == low}
    assert 220 < len(want) < 270
    got = near_groups.keep_first(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    assert {r[0] for r in got.collect()} == want


def _run(fp, root=None):
    """What one run of equal keys gives, in two batches."""
    import numpy as np
    import pyarrow as pa

    n = len(fp)
    columns = [np.full(n, 7), np.arange(n), np.full(n, 100, np.int32), np.zeros(n, np.int32), fp[:, 0].view(np.int64), fp[:, 1].view(np.int64)] + ([] if root is None else [root])
    names = ["key", "row", "n", "pos", "f0", "f1", "root"][: len(columns)]
    whole = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)
    found = near_groups._candidates(near_groups.candidate_bits(0.8), 0.8, root is not None)([whole[: n // 2], whole[n // 2 :]])
    return [tuple(p.values()) for batch in found for p in batch.to_pylist()]


def test_large_runs():
    """In a large run, copies of each other that are no copies of the middle one meet in the second round."""
    import numpy as np

    rng = np.random.default_rng(1)
    same = 2048
    base = rng.integers(0, 2**63, (1, 2), dtype=np.uint64)
    fp = np.repeat(base, same + 400, axis=0)
    far = np.arange(same, len(fp))
    fp[far] ^= rng.integers(0, 2**63, (len(far), 2), dtype=np.uint64) & rng.integers(0, 2**63, (len(far), 2), dtype=np.uint64)
    fp[far[200:]] = fp[far[:200]] ^ np.uint64(1)  # each row's copy comes 200 rows later
    copies = set(zip(far[:200].tolist(), far[200:].tolist()))
    first = _run(fp)
    middle = {d for _, d, _ in first if d is not None}
    assert len(middle) == 1 and not copies & {(s, d) for s, d, _ in first}
    assert {s for s, _, _ in first} | middle == set(range(len(fp)))
    root = np.where(np.arange(len(fp)) < same, 0, np.arange(len(fp)))
    second = set(_run(fp, root))
    assert copies <= second
    limit = near_groups.candidate_bits(0.8)
    apart = near_groups._apart(fp, fp)
    i, j = np.nonzero(np.triu((apart <= limit) & (root[:, None] != root[None, :]), 1))
    assert second == set(zip(i.tolist(), j.tolist()))


def test_sizes_and_places():
    """A pair may be alike if it can still have enough in common: checked against all numbers of common shingles."""
    import numpy as np

    n, i, m, j = (x.ravel() for x in np.meshgrid(*[np.arange(0, 14)] * 4))
    inside = (i <= n) & (j <= m) & (n + m > 0)
    n, i, m, j = (x[inside] for x in (n, i, m, j))
    most = np.minimum(n - i, m - j)
    assert (near_groups._may_fit(n, i, m, j, 0.8) == (most >= 0.8 * (n + m - most) - 1e-9)).all()


def test_simhash_links(spark):
    """The pipeline's stage loses no link of op4 (four bits), whatever the Jaccard: against brute force over both."""
    real = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").where("doc_id < 60 or doc_id in (362, 425, 452, 794)")
    docs = [tuple(r) for r in real.select("doc_id", "text").collect()]
    docs += [(2000 + k, "ab cd ef " * 50 + " ".join(f"w{k}{i}" for i in range(12))) for k in range(3)]  # what repeats decides the bits
    docs += [(3000, ""), (3001, None), (3002, "x"), (3003, "x")]
    sets = [brute.shingles(t, 5) for _, t in docs]
    prints = [brute.simhash(t or "") for _, t in docs]
    bits = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    alike = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or len(a & b) >= 0.8 * len(a | b)]
    ids = [d for d, _ in docs]
    want, without = ({d for d, low in zip(ids, brute.lowest(ids, links)) if d == low} for links in (bits + alike, alike))
    assert want < without and {2001, 2002} <= without - want and min(without - want) < 2000
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert {r[0] for r in corpus_pipeline.near_copies(spark, frame, "").select("doc_id").collect()} == want
