"""BPE encoding and decoding by a pair occurrence index.

A text falls into chunks where one space or line feed stands between two visible characters: no pre-token crosses
such a place, so chunks can be encoded apart and, being mostly words, once each; plain ASCII chunks are cut into their
pre-tokens at once. The strings of a partition that weren't met before are encoded together, block by block (300,000
bytes of new strings at most, so that memory is bounded): an index maps each pair of neighbouring symbols to all its
positions in the block; active ranks are taken in ascending order (a merge only makes pairs of higher rank), all
positions of a pair are merged, and the lists of the neighbouring pairs are updated. Results are kept in a table of
bounded bytes that is emptied when full, which changes speed only. Decoding looks up the bytes of each id.

Edge cases: null and empty texts give no ids; special tokens written in a text become their ids, as the tokenizers
library does by default; rows are independent, so repeated rows and ties get equal answers; an empty table gives an
empty result. Memory is bounded by the longest text plus the table of chunks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm._common import arrow_map, flat_index, spans_by_size, text_bytes
from strandwork.llm._spans import SpanTable

#: Below U+0180, letters and numbers are the same in every Unicode version; beyond, the library splits.
_UNUSUAL = re.compile(r"[^\x00-\u017f]|[\x1c-\x1f\x85\xa0]")
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES = 1 << 20
#: Bytes by class: 1 letters, 2 digits, 3 other visible characters, 0 what may come before a chunk, 4 all others.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[0x20, 0x0A]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[ord("'")] = 4
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_C2_SPACE = np.zeros(256, bool)  # U+0085 and U+00A0
_C2_SPACE[[0x85, 0xA0]] = True
_WIDE = np.zeros(256, bool)
_WIDE[[0xE1, 0xE2, 0xE3]] = True


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairIndexBPE:
    """A byte-level BPE read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        to_byte = {c: b for b, c in byte_symbols().items()}
        self.to_byte = to_byte
        self.byte_id = [vocab[c] for _, c in sorted(byte_symbols().items())]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        every = vocab | self.special
        self.bytes_of = [b""] * (max(every.values()) + 1)
        for token, i in every.items():
            self.bytes_of[i] = token.encode() if i in self.special.values() else bytes(to_byte[c] for c in token)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or spec["normalizer"] or model.get("end_of_word_suffix"):
            raise ValueError("only plain byte-level vocabularies are read here")
        self.pre = pre_tokenizers.ByteLevel(add_prefix_space=pre["add_prefix_space"], use_regex=pre["use_regex"])
        import regex

        self.split = regex.compile(_PRETOKEN).findall
        self.table = SpanTable(self._learn, np.uint32)
        sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.size_of, self.at_of = sizes, np.cumsum(sizes) - sizes
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def encode_pretokens(self, pretokens: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token, all merged side by side."""
        sym: list[int] = []
        byte_id = self.byte_id
        for p in pretokens:
            sym += [byte_id[b] for b in p]
            sym.append(-1)  # no merge crosses it
        n = len(sym)
        sym.append(-1)
        following, before = list(range(1, n + 2)), list(range(-1, n))
        merges, where, active = self.merges, {}, []
        for i, pair in enumerate(zip(sym, sym[1:])):
            if (at := where.get(pair)) is not None:
                at.append(i)
            elif pair in merges:
                where[pair] = [i]
                active.append((*merges[pair], pair))
        heapq.heapify(active)
        while active:
            _, new, pair = heapq.heappop(active)
            a, b = pair
            for i in sorted(where.pop(pair)):
                j = following[i]
                if sym[i] != a or sym[j] != b:
                    continue  # an earlier merge took one of the two
                sym[i], sym[j] = new, -2
                k = following[i] = following[j]
                before[k] = i
                h = before[i]
                for at, near in ((h, (sym[h], new)), (i, (new, sym[k]))):
                    if (places := where.get(near)) is not None:
                        places.append(at)
                    elif near in merges:
                        where[near] = [at]
                        heapq.heappush(active, (*merges[near], near))
        out: list[list[int]] = []
        ids: list[int] = []
        for s in sym[:n]:
            if s >= 0:
                ids.append(s)
            elif s == -1:
                out.append(ids)
                ids = []
        return out

    def _pretokenize(self, chunk: bytes) -> list[bytes]:
        text = chunk.decode("utf-8", "replace")
        if _UNUSUAL.search(text):
            return [bytes(map(self.to_byte.__getitem__, p)) for p, _ in self.pre.pre_tokenize_str(text)]
        return [p.encode() for p in self.split(text)]

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        values, counts = [np.zeros(0, np.uint32)], []
        for a, b in spans_by_size([len(c) for c in chunks], 300_000):
            pieces = [self._pretokenize(c) for c in chunks[a:b]]
            fresh = list({p for ps in pieces for p in ps})
            known = dict(zip(fresh, self.encode_pretokens(fresh)))
            made = [known[ps[0]] if len(ps) == 1 else [i for p in ps for i in known[p]] for ps in pieces]
            counts += map(len, made)
            values.append(np.fromiter((i for ids in made for i in ids), np.uint32))
        return np.concatenate(values), np.asarray(counts, np.int64)

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        buf = np.frombuffer(b"".join(texts), np.uint8)
        n = len(buf)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not n:
            return [b""] * len(texts)
        # a chunk starts at a space or line feed between two visible characters, and with each text
        visible = ~_SPACE[buf]
        visible[1:-1] &= ~((buf[:-2] == 0xC2) & _C2_SPACE[buf[1:-1]])
        wide = _WIDE[buf]  # some of these three-byte characters are white space
        after = wide | ((buf == 0xC2) & np.append(_C2_SPACE[buf[1:]], False)) | ~visible
        before = ~visible
        before[2:] |= wide[:-2]
        before[1:] |= (buf[:-1] == 0xC2) & _C2_SPACE[buf[1:]]
        cut = np.zeros(n + 1, bool)
        cut[1 : n - 1] = ((buf[1:-1] == 0x20) | (buf[1:-1] == 0x0A)) & ~before[:-2] & ~after[2:]
        cut[0] = cut[n] = True
        cut[text_ends] = True
        special = {}
        for content, i in self.special.items():
            raw, mark = buf.tobytes(), content.encode()
            at = raw.find(mark)
            while at >= 0:
                inside = np.searchsorted(text_ends, [at, at + len(mark) - 1], side="right")
                if inside[0] == inside[1] and at not in special:
                    cut[at + 1 : at + len(mark)] = False
                    cut[at] = cut[at + len(mark)] = True
                    special[at] = i
                at = raw.find(mark, at + (len(mark) if at in special else 1))
        # plain chunks are cut further, between runs of letters, digits and signs and after a line feed
        kind = _CLASS[buf]
        odd = (kind == 4) | ((kind == 0) & ~cut[:-1])
        odd[list(special)] = True
        edges = np.flatnonzero(cut)
        whole = np.unique(np.searchsorted(edges, np.flatnonzero(odd), side="right") - 1)
        cut[1:n] |= ((kind[1:] != kind[:-1]) & (kind[:-1] > 0)) | (buf[:-1] == 0x0A)
        cut[flat_index(edges[whole] + 1, edges[whole + 1] - edges[whole] - 1)] = False
        edges = np.flatnonzero(cut)
        starts, stops = edges[:-1], edges[1:]
        if special:
            plain = ~np.isin(starts, list(special))
            ids, counts = self.table.lookup(buf, starts[plain], stops[plain])
            every = np.ones(len(starts), np.int64)
            every[plain] = counts
            flat = np.zeros(int(every.sum()), np.uint32)
            flat[np.repeat(plain, every)] = ids
            flat[np.repeat(~plain, every)] = [special[int(s)] for s in starts[~plain]]
            ids, counts = flat, every
        else:
            ids, counts = self.table.lookup(buf, starts, stops)
        done = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, text_ends)]
        raw = ids.astype("<u4", copy=False).tobytes()
        return [raw[4 * x : 4 * y] for x, y in zip([0, *done[:-1].tolist()], done.tolist())]

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of some ids; bytes that are no UTF-8 become replacement characters."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        made = self.blob[flat_index(self.at_of[i], self.size_of[i])].tobytes()
        try:
            made.decode()
        except UnicodeDecodeError:
            return made.decode("utf-8", "replace").encode()
        return made


_LOADED: dict[str, PairIndexBPE] = {}


def load(path: str) -> PairIndexBPE:
    if path not in _LOADED:
        _LOADED[path] = PairIndexBPE(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``id_col, n_tokens`` and any of ``ids`` (binary, little-endian unsigned 32-bit), ``decoded``, ``ids_sha256``,
    ``decoded_sha256`` for every row of ``docs``. Nothing is shuffled; ``path`` is read where the tasks run."""
    kinds = {"ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    id_kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in spans_by_size([len(t) for t in texts], BLOCK_BYTES):
                ids = bpe.encode_batch(texts[a:b])
                decoded = [bpe.decode(x) for x in ids] if any(o.startswith("decoded") for o in outputs) else None
                made = {
                    "ids": lambda: pa.array(ids, pa.binary()),
                    "decoded": lambda: pa.array(decoded, pa.binary()).cast(pa.string()),
                    "ids_sha256": lambda: pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    "decoded_sha256": lambda: pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                }
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(x) // 4 for x in ids], pa.int64()), *(made[o]() for o in outputs)], ["id", "n_tokens", *outputs])

    schema = f"id {id_kind}, n_tokens bigint" + "".join(f", {o} {kinds[o]}" for o in outputs)
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)
