"""Every query of the corpus operators against its brute-force version."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from strandwork.llm import entry
from tests.llm import brute

Q = entry.queries()


def test_op1(spark, any_dir, docs_of):
    docs = sorted((r[0], r[1] or "") for r in docs_of(any_dir))
    got = {r.doc_id: r for r in Q["op1_document_fingerprints"](spark, any_dir).collect()}
    assert sorted(got) == [i for i, _ in docs]
    shown = {t: "".join(f"{h & (2**64 - 1):016x}" for h in brute.sketch(t)) for _, t in docs}
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        edited = brute.edited(text, following)
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == shown[text]
        assert r.near_edited == pytest.approx(brute.jaccard(brute.sketch(text), brute.sketch(edited)))
        assert r.near_next == pytest.approx(brute.jaccard(brute.sketch(text), brute.sketch(following)))


def test_op2(spark, any_dir, docs_of):
    docs = [(r[0], r[1] or "") for r in docs_of(any_dir)]
    got = {r.doc_id: r for r in Q["op2_suffix_array_dedup"](spark, any_dir).collect()}
    for (i, text), spans in zip(docs, brute.repeats([t for _, t in docs])):
        kept = brute.cut(text, spans)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(text.encode()), len(text.encode()) - len(kept), len(spans)), i
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_op3_shape(spark, any_dir, docs_of):
    docs = docs_of(any_dir)
    got = Q["op3_toxicity"](spark, any_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in docs)
    by_text = defaultdict(set)
    texts = {r[0]: r[1] or "" for r in docs}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        by_text[texts[r.doc_id]].add(r.score)
    assert all(max(x) - min(x) < 1e-12 for x in by_text.values())


def test_op4(spark, any_dir, docs_of):
    docs = [(r[0], r[1] or "") for r in docs_of(any_dir)]
    got = {r.doc_id: r for r in Q["op4_simhash_near_dedup"](spark, any_dir).collect()}
    prints = [brute.simhash(t) for _, t in docs]
    for (i, _), fp, low in zip(docs, prints, brute.classes(prints, [i for i, _ in docs], 4)):
        assert (got[i].fingerprint, got[i].component_id) == (f"{fp:016x}", low)


def test_op5(spark, any_dir, docs_of):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(entry.tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in Q["op5_bpe_encoding_decoding"](spark, any_dir).collect()}
    for i, text, *_ in docs_of(any_dir):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), i
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), i
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op6(spark, any_dir, docs_of):
    want = brute.warc([(r[0], r[2]) for r in docs_of(any_dir, "pages")])
    got = {r.page_id: tuple(r)[1:] for r in Q["op6_warc"](spark, any_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    assert got == want


def test_op7(spark, any_dir, docs_of):
    docs = [(r[0], r[1]) for r in docs_of(any_dir)]
    want = brute.unigrams(docs)
    got = {r.doc_id: r for r in Q["op7_lm_scoring"](spark, any_dir).collect()}
    assert sorted(got) == sorted(want)
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0


def test_op8(spark, any_dir, docs_of):
    got = {r.doc_id: r for r in Q["op8_quality_rules"](spark, any_dir).collect()}
    for i, text, *_ in docs_of(any_dir):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text), i
        assert r.line_share == pytest.approx(brute.line_share(text))
        for n in (3, 5, 8, 10):
            assert r[f"share_{n}"] == pytest.approx(brute.shares(text, n)), (i, n)
        assert not (r.kept and r.base_failed)


def test_op9(spark, any_dir, docs_of):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(entry.tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = Q["op9_best_fit_packing"](spark, any_dir).collect()
    of, bins = defaultdict(list), defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text, *_ in docs_of(any_dir):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        parts = sorted(of[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 2048)))
        for r in parts:
            part = ids[2048 * r.piece : 2048 * (r.piece + 1)]
            assert (r.start, r.length, r.ids_crc32) == (2048 * r.piece, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 2


def test_op10(spark, any_dir, docs_of):
    docs = docs_of(any_dir)
    got = {r.doc_id: r for r in Q["op10_secret_scans"](spark, any_dir).collect()}
    live = brute.live([(r[1], r[3], r[2]) for r in docs])
    for (i, text, *_), more in zip(docs, live):
        base = brute.secrets(text)
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[3] == k for s in base) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(brute.said(base).encode()).hexdigest()
        assert r.spans == brute.said({*base, *more}), i


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty_dir, name):
    assert Q[name](spark, empty_dir).collect() == []
