"""LM scoring: a causal self-attention model over subword ids, trained in numpy.

The model. Ids come from a public tokenizer; pairs of them that frequent words of the training texts have most often are
joined to ids of their own, round by round (``units``), so that a text has fewer places. The ``known`` most frequent ids have
embeddings of their own, all others share one. A causal attention layer, from every second place and to pairs of places, and
a small feed-forward layer at each place lead to a state; a softmax in two steps (first over the ``own`` most frequent ids and
over clusters, then over the ids of the cluster) gives the next id's probability. Clusters are made of ids with like counts and
neighbours, small ones of frequent ids. Ids outside the known ones share a leaf by their counts. ``score`` is the sum of
log10 p(id | context) over a text's ids and its end: a proper distribution over id sequences. Texts are cut in overlapping
context windows and every id is scored once, with the window that gives it the most context, in batches under a causal mask.

Training. Counts and neighbour profiles cover every training text in full, and so do windows: each id of a training
text is the target of exactly one window, in one of ``rounds`` rounds (texts take turns). In a round the tasks that hold
its texts each take gradient steps from common weights, block of texts by block of texts, and the weights are averaged:
steps grow with the corpus, the model and a task's memory don't.

The base score is a unigram model over words; its counts cover every training text. The ``top`` most frequent words
travel to the tasks as a table (a fixed bound); all other words of all texts meet their counts in a join.

Edge cases: a null or empty text is its end alone; with nothing to learn from, the weights stay as they were drawn
and counts are their priors; repeated rows are scored (and learnt from) one by one; a null id is not a training row's
mark - such rows are held in; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm._common import Scratch, arrow_map, flat_index, lower_bytes, materialize, spans_by_size, text_bytes
from strandwork.llm.packing import _PRETOKEN as PRETOKEN
from strandwork.llm.packing import _UNUSUAL as UNUSUAL
from strandwork.llm.packing import encoder
from strandwork.llm.units import join, learn_units

BLOCK_BYTES = 1 << 19
SCORED = 256  # windows to a batch
BLOCK_ROWS = 2048  # rows whose shares are made together
END_WORD = "\n"  # no word has a line feed


@dataclass(frozen=True)
class Settings:
    vocabulary: int = 53_504  # the tokenizer's ids and the units joined of them
    first_unit: int = 49_408
    joins: tuple = (512,) * 8  # units to a round of joining
    end_id: int = 49_407
    known: int = 8192
    own: int = 32  # known ids that are leaves of the first softmax
    clusters: int = 64
    widest: int = 160  # ids that a cluster has at most, where there are clusters enough
    profile: int = 6  # numbers to a neighbour profile, each side
    dim: int = 16
    hidden: int = 32
    window: int = 64
    stride: int = 56
    rounds: int = 3
    batch: int = 192  # windows to a gradient step, from ``first_batch`` on one more with each step
    first_batch: int = 16
    block: int = 1 << 18  # ids whose windows are shuffled together
    rate: float = 2e-2
    top: int = 1 << 17
    longest: int = 64  # bytes of a word in the table of frequent words
    seed: int = 5


def held_out(ids: list, fold: int = 1, folds: int = 5) -> np.ndarray:
    return np.asarray([i is not None and zlib.crc32(str(i).encode()) % folds == fold for i in ids], bool)


# --- the model ----------------------------------------------------------------------------------------


@dataclass
class Leaves:
    """Where ids are found. A rank is an id's place among the known ids; ``known`` stands for all others, and the
    start of a text is ``known + 1`` (as an input only)."""

    rank: np.ndarray  # of each id
    leaf: np.ndarray  # of each rank: what the first softmax has for it
    inside: np.ndarray  # of each rank: its place in its cluster, -1 for those without one
    sizes: np.ndarray  # of each cluster
    share: np.ndarray  # log10 of each id's share of its leaf's last step (0 for known ids)

    @property
    def tops(self) -> int:
        return int(self.leaf.max()) + 1


def arrange(count: np.ndarray, profile: np.ndarray, s: Settings) -> Leaves:
    """Leaves for ids with these counts and neighbour profiles."""
    order = np.argsort(-count, kind="stable")[: max(min(s.known, int((count > 0).sum())), s.own + s.clusters)]
    rank = np.full(s.vocabulary, s.known)
    rank[order] = np.arange(len(order))
    leaf, inside = np.zeros(s.known + 1, np.int64), np.full(s.known + 1, -1)
    leaf[: s.own] = np.arange(s.own)
    leaf[len(order) :] = s.own + s.clusters  # all others
    x = profile[order] / np.maximum(count[order], 1)[:, None]
    mass = count[order] + 0.5
    bands = [k for k in s.own * 4 ** np.arange(1, min(4, s.clusters)) if k < len(order)]
    groups = np.split(np.arange(s.own, len(order)), np.asarray(bands, np.int64) - s.own)
    while len(groups) < s.clusters:  # that with the most work (its ids times how often they come) is halved across its longest direction
        work = [(len(g) > s.widest, mass[g].sum() * len(g) * (len(g) > 1)) for g in groups]
        g = groups.pop(max(range(len(groups)), key=work.__getitem__))
        y = x[g] - x[g].mean(axis=0)
        _, v = np.linalg.eigh(y.T @ y)
        by = np.argsort(y @ v[:, -1], kind="stable")
        groups += [g[by[: len(g) // 2]], g[by[len(g) // 2 :]]]
    for c, g in enumerate(groups):
        leaf[g], inside[g] = s.own + c, np.arange(len(g))
    rare = np.where(rank == s.known, count + 0.5, 0)
    share = np.zeros(s.vocabulary)
    share[rank == s.known] = np.log10(rare[rank == s.known] / max(rare.sum(), 1e-9))
    return Leaves(rank, leaf, inside, np.asarray([len(g) for g in groups]), share)


def draw(s: Settings, leaves: Leaves, count: np.ndarray) -> dict[str, np.ndarray]:
    """Fresh weights; biases are the logarithms of the counts."""
    rng = np.random.default_rng(s.seed)
    d, width = s.dim, int(leaves.sizes.max())

    def w(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    by_rank = np.bincount(leaves.rank, count + 0.5, s.known + 1)
    top = np.log(np.bincount(leaves.leaf, by_rank, leaves.tops))
    deep = np.full((s.clusters, width), -1e9)  # places beyond a cluster's ids have no share
    member = np.flatnonzero(leaves.inside >= 0)
    deep[leaves.leaf[member] - s.own, leaves.inside[member]] = np.log(by_rank[member])
    return {
        "E": w(s.known + 2, d, scale=0.3), "P": w(s.window, d, scale=0.05), "S": w(d, d, scale=0.1), "QKV": w(d, 3 * d, scale=d**-0.5), "O": w(d, d, scale=0.1),
        "A": w(2 * d, s.hidden, scale=(2 * d) ** -0.5), "B": w(s.hidden, d, scale=0.05), "U": w(d, leaves.tops, scale=0.05), "b": (top - top.max()).astype(np.float32),
        "D": w(s.clusters, d, width, scale=0.05), "e": deep.astype(np.float32),
    }


_MASK: dict[int, np.ndarray] = {}


def hidden(w: dict, x: np.ndarray) -> tuple:
    """Last layer for a batch of windows of ranks, and what its gradient needs."""
    n, t = x.shape
    m, d = (t + 1) // 2, w["O"].shape[0]
    if m not in _MASK:
        _MASK[m] = np.triu(np.full((m, m), -1e9, np.float32), 1)
    # the feed-forward layer sees the last id as it is and what attention made of the context
    both = np.empty((n, t, 2 * d), w["E"].dtype)
    h0 = both[..., :d]
    np.add(w["E"][x], w["P"][:t], out=h0)
    flat = both.reshape(-1, 2 * d)
    # attention goes from every second place, and to pairs of places: one of these and the one before it
    old = np.zeros((n, m, d), h0.dtype)
    old[:, 1:] = h0[:, 1 : 2 * m - 1 : 2]
    pair = (old.reshape(-1, d) @ w["S"]).reshape(n, m, d)
    pair += h0[:, ::2]
    qkv = (pair.reshape(-1, d) @ w["QKV"]).reshape(n, m, 3 * d)
    q, k, v = qkv[..., :d], qkv[..., d : 2 * d], qkv[..., 2 * d :]
    q *= np.float32(d**-0.5)
    a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
    a += _MASK[m]
    _exp(a)
    total = (a.reshape(-1, m) @ np.ones(m, a.dtype)).reshape(n, m, 1)
    c = a @ np.ascontiguousarray(v)
    c /= total
    both[:, ::2, d:] = c
    both[:, 1::2, d:] = c[:, : t // 2]
    r = flat @ w["A"]
    np.maximum(r, 0, out=r)
    h = r @ w["B"]
    h += flat[:, :d]
    h += flat[:, d:] @ w["O"]
    return h, (x, q, k, v, a, total, both, r, old, pair, c)


def _exp(z: np.ndarray) -> None:
    """exp(z) in place; only where numbers would get out of hand are they held down."""
    if z.size and z.max() > 80:
        np.minimum(z, 80, out=z)
    np.exp(z, out=z)


def _with_bias(w: dict, name: str, bias: str) -> np.ndarray:
    """A layer with its bias as one more row."""
    return np.concatenate([w[name], w[bias][..., None, :]], axis=-2)


def _by_cluster(leaves: Leaves, s: Settings, leaf: np.ndarray, deep: np.ndarray):
    """Rows ``deep`` in the order of their targets' clusters (small ones first), and runs of clusters: the rows' places in that
    order, the most ids that one of its clusters has, and ``cluster, first, last`` of each. A run has ``BLOCK_ROWS`` rows at most
    or one cluster."""
    by_size = np.argsort(leaves.sizes, kind="stable")
    place = np.empty(s.clusters, np.int16)
    place[by_size] = np.arange(s.clusters)
    cluster = place[leaf[deep] - s.own]
    deep = deep[np.argsort(cluster, kind="stable")]
    edges = np.concatenate([[0], np.cumsum(np.bincount(cluster, minlength=s.clusters))]).tolist()
    runs: list[tuple[int, list]] = []
    for k, (c, size) in enumerate(zip(by_size.tolist(), leaves.sizes[by_size].tolist())):
        a, b = edges[k], edges[k + 1]
        if a == b:
            continue
        if not runs or b - runs[-1][1][0][1] > BLOCK_ROWS or size > 1.25 * runs[-1][0]:
            runs.append((size, []))
        runs[-1][1].append((c, a, b))
        runs[-1] = size, runs[-1][1]
    return deep, [(slice(parts[0][1], parts[-1][2]), width, parts) for width, parts in runs]


def _inside(layers: np.ndarray, hd: np.ndarray, rows: slice, width: int, parts: list) -> np.ndarray:
    """What the clusters' layers make of a run's rows."""
    z = np.empty((rows.stop - rows.start, width), hd.dtype)
    for c, a, b in parts:
        np.matmul(hd[a:b], layers[c, :, :width], out=z[a - rows.start : b - rows.start])
    return z


def _log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log of the softmax of each row's place ``at``; ``z`` is used up."""
    _exp(z)
    picked = z.ravel()[np.arange(len(z)) * z.shape[1] + at]
    return np.log(np.maximum(picked, 1e-35)) - np.log(np.maximum(z @ np.ones(z.shape[1], np.float32), 1e-35))


def log_probability(w: dict, leaves: Leaves, s: Settings, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of rank y[i] after state h[i]."""
    out = np.empty(len(y), np.float64)
    leaf, inside = leaves.leaf[y], leaves.inside[y]
    h = np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1)
    top, layers = _with_bias(w, "U", "b"), _with_bias(w, "D", "e")
    for a in range(0, len(y), BLOCK_ROWS):
        out[a : a + BLOCK_ROWS] = _log_share(h[a : a + BLOCK_ROWS] @ top, leaf[a : a + BLOCK_ROWS])
    deep, runs = _by_cluster(leaves, s, leaf, np.flatnonzero(inside >= 0))
    hd, ind = h[deep], inside[deep]
    for rows, width, parts in runs:
        out[deep[rows]] += _log_share(_inside(layers, hd, rows, width, parts), ind[rows])
    return out


def _slopes(z: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``z`` becomes a multiple of (softmax of each row, less one at its place ``at``); the result is what each row is still to be
    multiplied with to be ``weight`` times that."""
    _exp(z)
    total = np.maximum(z @ np.ones(z.shape[1], z.dtype), 1e-35)
    z.ravel()[np.arange(len(z)) * z.shape[1] + at] -= total
    return (weight / total)[:, None]


def gradients(w: dict, leaves: Leaves, s: Settings, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> dict:
    """Gradients of the mean negative log probability of the real targets (``y`` where ``real``)."""
    h, (x, q, k, v, a, sums, both, r, old, pair, c) = hidden(w, x)
    a /= sums
    n, t = x.shape
    m, d = pair.shape[1:]
    flat = both.reshape(-1, 2 * d)
    weight = real.ravel().astype(h.dtype)
    weight /= max(float(weight.sum()), 1.0)
    target = y.ravel()
    leaf = leaves.leaf[target]
    h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)
    dh, over, top = np.empty((len(h), d), h.dtype), _with_bias(w, "U", "b"), 0
    for i in range(0, len(h), BLOCK_ROWS):
        some = slice(i, i + BLOCK_ROWS)
        z = h[some] @ over
        scale = _slopes(z, weight[some], leaf[some])
        top = top + (h[some] * scale).T @ z
        np.multiply(z @ over[:d].T, scale, out=dh[some])
    inside = leaves.inside[target]
    deep, runs = _by_cluster(leaves, s, leaf, np.flatnonzero((inside >= 0) & (weight > 0)))
    hd, ind, wd = h[deep], inside[deep], weight[deep]
    dhd = np.empty((len(deep), d), hd.dtype)
    layers = _with_bias(w, "D", "e")
    dlayers = np.zeros_like(layers)
    for rows, width, parts in runs:
        z = _inside(layers, hd, rows, width, parts)
        scale = _slopes(z, wd[rows], ind[rows])
        scaled = hd[rows] * scale
        for one, i, j in parts:
            some = slice(i - rows.start, j - rows.start)
            np.matmul(scaled[some].T, z[some], out=dlayers[one, :, :width])
            np.matmul(z[some], layers[one, :d, :width].T, out=dhd[i:j])
        dhd[rows] *= scale
    dh[deep] += dhd
    g = {"U": top[:d], "b": top[d], "D": dlayers[:, :d], "e": dlayers[:, d]}
    g["B"] = r.T @ dh
    dr = dh @ w["B"].T
    dr *= r > 0
    g["A"] = flat.T @ dr
    dboth = dr @ w["A"].T
    g["O"] = flat[:, d:].T @ dh
    each = (dh @ w["O"].T + dboth[:, d:]).reshape(n, t, d)
    dc = np.ascontiguousarray(each[:, ::2])
    dc[:, : t // 2] += each[:, 1::2]
    ds = dc @ np.ascontiguousarray(v.transpose(0, 2, 1))
    ds -= ((dc * c).reshape(-1, d) @ np.ones(d, dc.dtype)).reshape(n, m, 1)
    ds *= a
    dqkv = np.empty((n, m, 3 * d), dc.dtype)
    np.multiply(ds @ np.ascontiguousarray(k), np.float32(d**-0.5), out=dqkv[..., :d])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., d : 2 * d])
    np.matmul(a.transpose(0, 2, 1), dc, out=dqkv[..., 2 * d :])
    dqkv = dqkv.reshape(-1, 3 * d)
    g["QKV"] = pair.reshape(-1, d).T @ dqkv
    dpair = dqkv @ w["QKV"].T
    g["S"] = old.reshape(-1, d).T @ dpair
    dh += dboth[:, :d]
    dh0 = dh.reshape(n, t, d)
    dh0[:, ::2] += dpair.reshape(n, m, d)
    dh0[:, 1 : 2 * m - 1 : 2] += (dpair @ w["S"].T).reshape(n, m, d)[:, 1:]
    g["P"] = np.zeros_like(w["P"])
    g["P"][:t] = dh0.sum(axis=0)
    at = (x.reshape(-1, 1) * d + np.arange(d, dtype=x.dtype)).ravel()
    g["E"] = np.bincount(at, dh.ravel(), w["E"].size).astype(dh.dtype).reshape(w["E"].shape)
    return g


class Trainer:
    """Adam steps from common weights, over one block of texts after another."""

    def __init__(self, w: dict, leaves: Leaves, s: Settings, seed: int, rate: float):
        self.w = {k: v.copy() for k, v in w.items()}
        self.m, self.u = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        self.spare = {k: (np.empty_like(v), np.empty_like(v)) for k, v in w.items()}
        self.leaves, self.s, self.rate, self.steps, self.windows = leaves, s, rate, 0, 0
        self.rng = np.random.default_rng(seed)

    def learn(self, texts_ids: list[np.ndarray]) -> None:
        """Steps over all windows of some texts: every id is a target once."""
        s = self.s
        cut = Windows(texts_ids, self.leaves.rank, s, s.window)
        order = self.rng.permutation(len(cut.start))
        self.windows += len(order)
        a = 0
        while a < len(order):
            some = order[a : a + min(s.batch, s.first_batch + self.steps)]
            a += len(some)
            self._step(gradients(self.w, self.leaves, s, *cut.batch(some)))

    def _step(self, g: dict) -> None:
        self.steps += 1
        now = self.rate * min(1.0, self.steps / 20) / (1 + self.steps / 200) ** 0.5
        first, second = np.float32(now / (1 - 0.9**self.steps)), np.float32((1 - 0.99**self.steps) ** -0.5)
        for k, v in self.w.items():
            m, u, (x, y) = self.m[k], self.u[k], self.spare[k]
            np.subtract(g[k], m, out=x)
            x *= np.float32(0.1)
            m += x
            np.multiply(g[k], g[k], out=x)
            x -= u
            x *= np.float32(0.01)
            u += x
            np.sqrt(u, out=x)
            x *= second
            x += np.float32(1e-7)
            np.multiply(m, first, out=y)
            y /= x
            v -= y


class Windows:
    """Texts' ids cut in windows of ``s.window`` ranks, one every ``stride``; a window's inputs are the ranks before its
    targets, the start of a text before its first."""

    def __init__(self, texts_ids: list[np.ndarray], rank: np.ndarray, s: Settings, stride: int):
        sizes = np.fromiter(map(len, texts_ids), np.int64, len(texts_ids))
        self.flat = np.concatenate(texts_ids)
        self.begins = np.cumsum(sizes) - sizes
        pad = np.zeros(s.window, np.int32)
        y = rank[self.flat].astype(np.int32)
        x = np.concatenate([[0], y[:-1]]).astype(np.int32)
        x[self.begins] = s.known + 1
        self.x, self.y = np.concatenate([x, pad]), np.concatenate([y, pad])
        count = 1 + np.maximum(0, -(-(sizes - s.window) // stride))
        owner = np.repeat(np.arange(len(sizes)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        self.start = (self.begins[owner] + number * stride).astype(np.int32)
        self.left = np.minimum(s.window, sizes[owner] - number * stride)
        self.skip = np.where(number > 0, s.window - stride, 0)  # targets that the window before has scored
        self.column = np.arange(s.window, dtype=np.int32)

    def batch(self, some) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, targets, and which of them are real and not in the window before."""
        at = self.start[some, None] + self.column
        return self.x[at], self.y[at], (self.column < self.left[some, None]) & (self.column >= self.skip[some, None])


@dataclass
class Model:
    weights: dict
    leaves: Leaves
    settings: Settings

    def score(self, texts_ids: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each id sequence (none is empty); each of its ids is scored once."""
        s = self.settings
        if not texts_ids:
            return np.zeros(0)
        cut = Windows(texts_ids, self.leaves.rank, s, s.stride)
        each = np.empty(len(cut.flat))
        for a in range(0, len(cut.start), SCORED):
            x, y, real = cut.batch(slice(a, a + SCORED))
            real = np.flatnonzero(real)
            h, _ = hidden(self.weights, x)
            place = (cut.start[a : a + SCORED, None] + cut.column).ravel()[real]
            each[place] = log_probability(self.weights, self.leaves, s, h[real], y.ravel()[real])
        return np.add.reduceat(each / np.log(10) + self.leaves.share[cut.flat], cut.begins)


# --- learning -----------------------------------------------------------------------------------------


def _projection(s: Settings) -> np.ndarray:
    return np.random.default_rng(s.seed).standard_normal((s.profile, s.vocabulary)).astype(np.float32)


@dataclass
class Frequent:
    """The most frequent words of the training rows: ``log10(c + 0.5)`` and the units of each (``counts[i]`` of ``values``),
    and how units are joined."""

    words: list[bytes]
    logs: np.ndarray
    values: np.ndarray
    counts: np.ndarray
    joins: list


class Speller:
    """The tokenizer's ids of words in small letters, as ``encoder`` has them. Words with plain characters only are cut by the
    encoder's pattern and their parts go to the tokenizer's model itself; others, and all of them if the model alone doesn't
    give the tokenizer's ids for ``PROBE``, go to the encoder."""

    PROBE = ["hello", "na\u00efve", "12", "x_y", ",;", "it's", "\u00c9t\u00e9", "zqxjkv"]
    PARTS = 1 << 16  # parts whose ids are kept

    def __init__(self, path: str):
        self.encode = encoder(path)
        self.model, self.parts, self.plain = self.encode.tokenizer.model, {}, True
        # the characters that stand for bytes in such vocabularies
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letter = {x: 256 + i for i, x in enumerate(sorted(set(range(256)) - set(own)))}
        probe = [w.encode() for w in self.PROBE]
        self.plain = [[*x] for x in self._pieces(probe)] == [np.frombuffer(x, "<u4").tolist() for x in self.encode(probe)]

    def _part(self, part: str) -> list[int]:
        known = self.parts.get(part)
        if known is None:
            text = part if part.isascii() else part.lower().encode().decode("latin-1").translate(self.letter)
            known = [token.id for token in self.model.tokenize(text)]
            if len(self.parts) < self.PARTS:
                self.parts[part] = known
        return known

    def _pieces(self, words: list[bytes]) -> list:
        """A list of ids for each word, None for those that aren't plain."""
        found = []
        for word in words:
            text = word.decode("utf-8", "replace")
            found.append(None if UNUSUAL.search(text) else [i for part in PRETOKEN.findall(text) for i in self._part(part)])
        return found

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        found = self._pieces(words) if self.plain else [None] * len(words)
        rest = [i for i, x in enumerate(found) if x is None]
        for a, b in spans_by_size([len(words[i]) for i in rest], BLOCK_BYTES):
            for i, ids in zip(rest[a:b], self.encode([words[i] for i in rest[a:b]])):
                found[i] = np.frombuffer(ids, "<u4").tolist()
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts


_SPELLERS: dict = {}


def _subwords(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if path not in _SPELLERS:
        _SPELLERS[path] = Speller(path)
    return _SPELLERS[path](words)


def frequent(path: str, times: dict[bytes, int], s: Settings) -> Frequent:
    """``times`` are the frequent words' counts; the pairs of ids that they have most often become units."""
    words, n = list(times), np.fromiter(times.values(), np.float64, len(times))
    values, counts = _subwords(path, words)
    joins = learn_units(values, counts, n, s.first_unit, list(s.joins))
    values, counts = join(values, counts, joins)
    return Frequent(words, np.log10(n + 0.5), values.astype("<u2"), counts, joins)


class _Numbers(dict):
    """Numbers words as they come; ``fresh`` are those that weren't there."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Words:
    """Words of texts by number: ``number < known`` are the frequent ones, others are learnt when they come and forgotten
    beyond ``OTHERS_BYTES``."""

    def __init__(self, path: str, common: Frequent):
        self.path, self.common, self.known = path, common, len(common.words)
        self.clear()

    def clear(self) -> None:
        self.numbers, self.others, self.bytes = _Numbers(self.common.words), [], 0
        self.values, self.counts = self.common.values, self.common.counts
        self.at = np.cumsum(self.counts) - self.counts

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of some texts, and how many words each text has."""
        if self.bytes > OTHERS_BYTES:
            self.clear()
        words = [lower_bytes(t).split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        number = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        if fresh := self.numbers.fresh:
            values, counts = join(*_subwords(self.path, fresh), self.common.joins)
            self.at = np.concatenate([self.at, len(self.values) + np.cumsum(counts) - counts])
            self.values = np.concatenate([self.values, values.astype("<u2")])
            self.counts = np.concatenate([self.counts, counts])
            self.others += fresh
            self.bytes += sum(map(len, fresh)) + 170 * len(fresh)  # what Python and the arrays hold besides
            self.numbers.fresh = []
        return number, sizes


TOKENS = "held_out boolean, turn int, ids binary, n_tokens bigint, n_known bigint, base double, rare array<struct<word:string,k:bigint>>"
#: Bytes of the words that a task knows besides the frequent ones.
OTHERS_BYTES = 32 << 20


def tokenize(rows: DataFrame, path: str, s: Settings, common, ends: int) -> DataFrame:
    """``rows`` (``id, text``) as ``id, held_out, turn`` (the round that learns from it), ``ids`` (units as little-endian unsigned
    16-bit integers, the end included) and what the base score needs: ``n_tokens``, of frequent words and the end ``n_known``
    and ``base`` (logarithms of counts), and all other words. ``common`` is a broadcast ``Frequent``, ``ends`` the end's count."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        table, done = Words(path, common.value), 0
        logs, known = common.value.logs, len(common.value.words)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in spans_by_size([len(t) for t in texts], BLOCK_BYTES):
                n = b - a
                number, sizes = table(texts[a:b])
                counts = table.counts[number]
                upto = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
                ids = np.insert(table.values[flat_index(table.at[number], counts)], upto, s.end_id).astype("<u2", copy=False)
                edges = np.concatenate([[0], upto + np.arange(1, n + 1)]).astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(2 * edges), pa.py_buffer(ids)])
                owner = np.repeat(np.arange(n), sizes)
                often = number < known
                n_known = np.bincount(owner[often], minlength=n) + (ends > 0)
                base = np.bincount(owner[often], logs[number[often]], n) + math.log10(ends + 0.5)
                left, k = np.unique(owner[~often] << 32 | number[~often] - known, return_counts=True)
                words = pa.array([table.others[i] for i in (left & 0xFFFFFFFF).tolist()], pa.binary()).cast(pa.string())
                first = np.searchsorted(left >> 32, np.arange(n + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays([words, pa.array(k.astype(np.int64))], ["word", "k"]))
                turn = (done + np.arange(n)) % s.rounds
                done += n
                arrays = [batch.column(0)[a:b], pa.array(held_out(batch.column(0)[a:b].to_pylist())), pa.array(turn, pa.int32()), made, pa.array(sizes + 1), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), rare]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "held_out", "turn", "ids", "n_tokens", "n_known", "base", "rare"])

    return arrow_map(rows, run, f"id {kind}, {TOKENS}")


#: Distinct words that a task counts before it hands them on; the engine adds up what comes more than once.
COUNTED = 120_000


def _count_words(batches):
    """Words of training rows, summed as far as ``COUNTED`` distinct ones go."""
    import pyarrow as pa

    counts: Counter = Counter()

    def flush():
        words, n = list(counts), list(counts.values())
        counts.clear()
        for a in range(0, max(len(words), 1), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 20_000], pa.binary()).cast(pa.string()), pa.array(n[a : a + 20_000], pa.int64())], ["word", "n"])

    for batch in batches:
        for text, out in zip(text_bytes(batch.column(1)), held_out(batch.column(0).to_pylist()).tolist()):
            if not out:
                counts.update(lower_bytes(text).split())
                counts[END_WORD.encode()] += 1
                if len(counts) > COUNTED:
                    yield from flush()
    yield from flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all training rows of ``docs`` (``id, text``); the end is a word too."""
    return arrow_map(docs, _count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _least_count(counts: DataFrame, most: int) -> int:
    """A count that ``most`` words at most reach; the driver sees a histogram of a few hundred classes only."""
    step = F.floor(F.log2("n") * 16)
    found = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    least, words = 1 << 62, 0
    for r in found:
        words += r["words"]
        if words > most:
            break
        least = r["n"]
    return least


def gather(tokens: DataFrame, s: Settings) -> DataFrame:
    """Of the training rows: for every id its count and neighbour profile (``id``, ``n``, ``data``), summed by task."""

    def run(batches):
        import pyarrow as pa

        r = _projection(s)
        count = np.zeros(s.vocabulary, np.int64)
        profile = np.zeros((2 * s.profile, s.vocabulary))
        for batch in batches:
            sizes = [len(x) for x in batch.column(0).to_pylist()]
            every = batch.column(0).to_pylist()
            for a, b in spans_by_size(sizes, BLOCK_BYTES):
                flat = np.frombuffer(b"".join(every[a:b]), "<u2").astype(np.int64)
                count += np.bincount(flat, minlength=s.vocabulary)
                for k in range(s.profile):
                    profile[k, :] += np.bincount(flat[:-1], r[k, flat[1:]], s.vocabulary)
                    profile[s.profile + k, :] += np.bincount(flat[1:], r[k, flat[:-1]], s.vocabulary)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(count[seen]), pa.array([x.tobytes() for x in profile[:, seen].T.astype("<f4")], pa.binary())], ["id", "n", "data"])

    return arrow_map(tokens.where("not held_out").select("ids"), run, "id int, n bigint, data binary")


def learn(tokens: DataFrame, s: Settings = Settings()) -> Model:
    """The model of the training rows of ``tokens`` (from ``tokenize``)."""
    spark = tokens.sparkSession
    keep = Scratch(spark)
    seen = keep(gather(tokens, s), "lm-gathered")
    # numbers of fixed size: at most one row to an id of the vocabulary reaches the driver
    count, profile = np.zeros(s.vocabulary), np.zeros((s.vocabulary, 2 * s.profile))
    for i, n, data in _summed(seen):
        count[i], profile[i] = n, np.frombuffer(data, "<f4")
    keep.drop()
    leaves = arrange(count, profile, s)
    weights = draw(s, leaves, count)
    for k in range(s.rounds):
        handed = spark.sparkContext.broadcast((weights, leaves))

        def run(batches, handed=handed, k=k):
            import pyarrow as pa

            mine, held, size = Trainer(*handed.value, s, s.seed + k, s.rate / (1 + k)), [], 0
            for batch in batches:
                for ids in batch.column(0).to_pylist():
                    held.append(np.frombuffer(ids, "<u2"))
                    size += len(held[-1])
                    if size >= s.block:
                        mine.learn(held)
                        held, size = [], 0
            if held:
                mine.learn(held)
            if mine.windows:
                yield _packed({name: (mine.windows, v) for name, v in mine.w.items()})

        turn = tokens.where("not held_out").where(F.col("turn") == k).select("ids")
        weights = _averaged(arrow_map(turn, run, WEIGHTS), weights)
        handed.unpersist()
    return Model(weights, leaves, s)


WEIGHTS = "name string, n bigint, data binary"


def _packed(found: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([v.astype("<f4").tobytes() for _, v in found.values()], pa.binary())], ["name", "n", "data"])


def _mean(batches):
    """Means of rows with equal names, weighted by ``n``."""
    total: dict[str, list] = {}
    for batch in batches:
        for name, n, data in zip(*(c.to_pylist() for c in batch.columns[:3])):
            one = total.setdefault(name, [0, 0.0])
            one[0] += n
            one[1] = one[1] + n * np.frombuffer(data, "<f4").astype(np.float64)
    if total:
        yield _packed({name: (n, v / max(n, 1)) for name, (n, v) in total.items()})


def _averaged(found: DataFrame, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Means of the tasks' weights, by the number of windows that they saw: in three steps, so that no task reads the weights
    of all tasks, and the driver gets one row to a weight."""
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    for most in (64, 8):
        found = arrow_map(found.withColumn("part", F.spark_partition_id() % most).repartition(parts, "name", "part"), _mean, WEIGHTS)
    out = dict(weights)
    for name, _, data in arrow_map(found.repartition(len(weights), "name"), _mean, WEIGHTS).collect():
        out[name] = np.frombuffer(data, "<f4").reshape(weights[name].shape).copy()
    return out


def _summed(seen: DataFrame):
    """``id, n, data`` summed over tasks, ids dealt out by their value."""

    def run(batches):
        import pyarrow as pa

        total: dict[int, list] = {}
        for batch in batches:
            for i, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(data, "<f4").astype(np.float64)
                if i in total:
                    total[i][0] += n
                    total[i][1] += x
                else:
                    total[i] = [n, x]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1].astype("<f4").tobytes() for v in total.values()], pa.binary())], ["id", "n", "data"])

    parts = max(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return arrow_map(seen.repartition(parts, "id"), run, "id int, n bigint, data binary").toLocalIterator()


# --- scoring ------------------------------------------------------------------------------------------


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = materialize(word_counts(rows), "lm-words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bottom = math.log10(n + 0.5 * (v + 1))
    ends = counts.where(F.col("word") == END_WORD).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    short = counts.where(F.octet_length("word") <= s.longest)  # the table is bounded in bytes as well
    known = {r[0].encode(): r[1] for r in short.where(F.col("n") >= _least_count(short, s.top)).collect()}
    common = spark.sparkContext.broadcast(frequent(path, known, s))
    keep = Scratch(spark)
    tokens = keep(tokenize(rows, path, s, common, ends), "lm-tokens")
    common.unpersist()
    handed = spark.sparkContext.broadcast(learn(tokens, s))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = [np.frombuffer(x, "<u2") for x in batch.column(1).to_pylist()]
            scores = [handed.value.score(ids[a:b]) for a, b in spans_by_size([len(x) for x in ids], BLOCK_BYTES // 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(np.concatenate([np.zeros(0), *scores]))], ["id", "held_out", "n_tokens", "n_known", "base", "rare", "score"])

    schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, rare array<struct<word:string,k:bigint>>, score double"
    some = tokens.select("id", "ids", "held_out", "n_tokens", "n_known", "base", "rare")
    scored = materialize(arrow_map(some, run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    keep.drop()
    # words beyond the table meet their counts; words that were never seen count 0
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.k").join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("hits"))
    out = scored.drop("rare").join(rare, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("hits", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(bottom)).alias("base_score"),
        "score",
    )
