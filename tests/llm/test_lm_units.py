"""Units of the attention model: subword ids joined by what the training rows' words have together."""

from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from strandwork.llm import entry, lm_scoring, units
from strandwork.llm._common import lower_bytes
from strandwork.llm.packing import encoder
from tests.conftest import SMALL

PATH = entry.tokenizer_path("word_bpe_49k.json")
S = lm_scoring.Settings()
ODD = ["x", "naïve,", "it's", "日本語", "a<|endoftext|>b", "²3", "É", "foo_bar", "　x　", "12ab'll", "…", "-", "ét", " "]


def _texts():
    return [(t or "").encode() for t in pq.read_table(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")["text"].to_pylist()]


def _ids(words):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder(PATH)(words)]


def _cut(values, counts):
    return [x.tolist() for x in np.split(values, np.cumsum(counts)[:-1])]


def _spread(ids, made):
    """Units as the ids that they were joined of."""
    pair = {first + i: divmod(int(k), units._KEY) for first, table in made for i, k in enumerate(table)}
    out = list(ids)
    while any(i in pair for i in out):
        out = [x for i in out for x in (pair.get(i) or (i,))]
    return out


def test_words_are_spelled_as_by_the_tokenizer():
    words = [w.encode() for w in ODD] + list({w for t in _texts() for w in lower_bytes(t).split()})
    spell = lm_scoring.Speller(PATH)
    assert spell.plain
    assert _cut(*spell(words)) == _ids(words)
    spell.plain = False
    assert _cut(*spell(words[:300])) == _ids(words[:300])
    assert [len(x) for x in spell([])] == [0, 0]


def test_units_stand_for_their_ids():
    rng = np.random.default_rng(0)
    chunks = [rng.integers(0, 6, rng.integers(0, 9)).tolist() for _ in range(400)] + [[1] * 7, []]
    flat, counts = np.concatenate([np.asarray(c, np.int64) for c in chunks]), np.asarray([len(c) for c in chunks])
    made = units.learn_units(flat, counts, rng.integers(1, 50, len(chunks)), 100, [4, 3, 2])
    assert [(first, len(table)) for first, table in made] == [(100, 4), (104, 3), (107, 2)]
    joined = _cut(*units.join(flat, counts, made))
    assert [_spread(c, made) for c in joined] == chunks
    assert sum(map(len, joined)) < 0.8 * len(flat)
    # whatever stands beside a chunk
    assert joined == [units.join(np.asarray(c, np.int64), np.asarray([len(c)]), made)[0].tolist() for c in chunks]


def test_most_frequent_pair_first():
    made = units.learn_units(np.asarray([1, 2, 3, 2, 3, 1, 2]), np.asarray([3, 2, 2]), np.asarray([1, 1, 5]), 10, [1])
    assert made[0][1].tolist() == [1 * units._KEY + 2]
    assert units.learn_units(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 10, [5]) == []


def test_model_reads_fewer_places_than_ids(monkeypatch):
    """Texts take a quarter fewer places than the tokenizer's ids at least, whole as before; words that are forgotten come back
    the same."""
    texts = _texts()
    times = Counter(w for t in texts for w in lower_bytes(t).split())
    common = lm_scoring.frequent(PATH, dict(times.most_common(5000)), S)

    def read(parts):
        table, out = lm_scoring.Words(PATH, common), []
        for part in parts:
            number, sizes = table(part)
            assert sizes.tolist() == [len(lower_bytes(t).split()) for t in part]
            for i in range(len(part)):
                mine = number[sizes[:i].sum() : sizes[: i + 1].sum()]
                out.append([int(x) for n in mine for x in table.values[table.at[n] : table.at[n] + table.counts[n]]])
        return out

    some = texts[:60]
    got = read([some])
    want = [sum(_ids(lower_bytes(t).split()), []) for t in some]
    assert [_spread(g, common.joins) for g in got] == want
    assert sum(map(len, got)) < 0.75 * sum(map(len, want))
    monkeypatch.setattr(lm_scoring, "OTHERS_BYTES", 0)
    assert read([some[:20], some[20:40], some[40:]]) == got
