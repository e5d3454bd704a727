"""Statistical models of sequences: training is weighted counting, scoring is one expression per row.

Fitted models are small tables (symbols x places x contexts, whatever the data), handed to the rows as literals or
broadcast; nothing that grows with the input is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.scalar import let, log_sum, reverse_complement
from strandwork.operators.kmers import position_counts, probabilities
from strandwork.operators.words import PIECE, arrow_map, coded, pieces, summed


def _by_place(seq: Column, alphabet: str, table) -> Column:
    """Sum of ``table[place][symbol]``; null where the sequence ends too early or has another symbol."""
    if not len(table):
        return F.lit(0.0)
    terms = [F.get(F.lit([float(x) for x in row]), F.nullif(F.instr(F.lit(alphabet), F.nullif(F.substring(seq, i + 1, 1), F.lit(""))), F.lit(0)) - 1) for i, row in enumerate(table)]
    return reduce(lambda a, b: a + b, terms)


def _parts(texts):
    """The texts of a series (null: empty) in lists of a piece each, so that no array grows with a batch."""
    texts = texts.fillna("").tolist()
    for s in pieces(np.fromiter(map(len, texts), np.int64, len(texts))):
        yield texts[s]


@dataclass
class PWM:
    """Independent places of one length; ``logs[place][symbol]``."""

    alphabet: str
    logs: list[list[float]]

    @classmethod
    def fit(cls, df: DataFrame, seq: str, alphabet: str, ess: float = 0.0, weight: Column | None = None) -> PWM:
        rows = probabilities(position_counts(df, seq, weight), alphabet, ["pos"], ess).collect()  # places x symbols
        logs = [[-math.inf] * len(alphabet) for _ in range(1 + max((r["pos"] for r in rows), default=-1))]
        for r in rows:
            if r["prob"] > 0 and r["sym"] in alphabet:
                logs[r["pos"]][alphabet.index(r["sym"])] = math.log(r["prob"])
        return cls(alphabet, logs)

    def score(self, seq: Column) -> Column:
        """Sum over the matrix's places from the sequence's start on; null if the sequence is shorter than the matrix or a
        symbol there isn't in the alphabet."""
        return _by_place(seq, self.alphabet, self.logs)

    def score_both_strands(self, seq: Column, forward: float = 0.5) -> Column:
        return log_sum(F.array(self.score(seq) + math.log(forward), self.score(reverse_complement(seq)) + math.log(1 - forward)))

    def window_scores(self, seq: Column) -> Column:
        """Scores of all windows of a longer sequence, each symbol looked up by its code; null for windows with symbols
        outside the alphabet."""
        m, n = len(self.alphabet), len(self.logs)
        flat = F.lit([x for row in self.logs for x in row])

        def each(codes):
            def at(i):
                return reduce(lambda a, b: a + b, [F.get(flat, F.when(F.get(codes, i + j) >= 0, F.get(codes, i + j) + j * m)) for j in range(n)])

            return F.when(F.size(codes) >= n, F.transform(F.sequence(F.lit(0), F.size(codes) - n), at)).otherwise(F.array().cast("array<double>"))

        return let(F.transform(F.split(F.coalesce(seq, F.lit("")), ""), lambda c: F.when(c != "", F.instr(F.lit(self.alphabet), c) - 1)), each)

    def _scan(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all windows of some texts (nan: it holds another symbol), and the bounds of each text's windows."""
        n, m = len(self.logs), len(self.alphabet)
        codes, lengths = coded(texts, self.alphabet)
        table = np.append(np.asarray(self.logs, float).reshape(n, m), np.full((n, 1), np.nan), axis=1)
        count = np.maximum(lengths - n + 1, 0)
        begins = np.cumsum(lengths) - lengths
        first = np.cumsum(count) - count
        at = np.repeat(begins - first, count) + np.arange(int(count.sum()))
        total = np.zeros(len(at))
        for j in range(n):
            total += table[j][codes[at + j]]
        return total, first, first + count

    def best_window(self, seq: Column) -> Column:
        """Struct of score and (negative) place of the best window of a longer sequence; null if there is none. In Arrow
        batches: a sequence's windows are one numpy array."""
        import pandas as pd

        model = self

        @F.pandas_udf("score double, minus int")
        def best(texts):
            rows = []
            for some in _parts(texts):
                scores, first, last = model._scan(some)
                for a, b in zip(first.tolist(), last.tolist()):
                    known = a < b and not np.isnan(scores[a:b]).all()
                    k = int(np.nanargmax(scores[a:b])) if known else 0
                    rows.append((scores[a + k], -k) if known else (np.nan, 1))
            return pd.DataFrame(rows, columns=["score", "minus"])

        found = best(seq)
        return F.when(found["minus"] <= 0, found)

    def zoops(self, seq: Column, share: float = 0.5) -> Column:
        """Log likelihood ratio of zero or one occurrence, all places alike, against uniform symbols. Windows with symbols
        outside the alphabet hold no occurrence."""
        import pandas as pd

        model = self
        whole = len(self.logs) * math.log(len(self.alphabet)) + math.log(share)

        @F.pandas_udf("double")
        def ratio(texts):
            out = []
            for some in _parts(texts):
                scores, first, last = model._scan(some)
                for a, b in zip(first.tolist(), last.tolist()):
                    x = scores[a:b]
                    x = x[~np.isnan(x)] + whole - math.log(max(b - a, 1))
                    top = max(math.log(1 - share), x.max(initial=-math.inf))
                    out.append(top + math.log(math.exp(math.log(1 - share) - top) + np.exp(x - top).sum()))
            return pd.Series(out, dtype="float64")

        return ratio(seq)


@dataclass
class Markov:
    """Homogeneous (or, with a period, cyclic) Markov model: ``logs[(phase, context + symbol)]`` for each order."""

    alphabet: str
    order: int
    logs: list[dict[str, float]]
    period: int = 1

    @classmethod
    def fit(cls, df: DataFrame, seq: str, alphabet: str, order: int, ess: float = 0.0, weight: str | None = None, period: int = 1) -> Markov:
        """One pass: the words of all lengths up to ``order + 1`` are counted together, as numbers, where the rows are. A task
        sends period x alphabet size ** (order + 1) rows of a length at most, and so many reach the driver."""
        m = len(alphabet)
        rows = df.select(F.col(seq).alias("seq"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).where("seq is not null")

        def run(batches):
            import pyarrow as pa

            sums = [np.zeros(period * m ** (k + 1)) for k in range(order + 1)]
            for texts, mass in ((t[s], w[s]) for t, w in ((b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)) for b in batches) for s in pieces(np.fromiter(map(len, t), np.int64, len(t)))):
                codes, lengths = coded(texts, alphabet)
                codes, w = codes.astype(np.int64), np.repeat(mass, lengths)
                place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                word, good = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
                for k in range(order + 1):  # the word that ends here
                    word = np.concatenate([np.zeros(k, np.int64), codes[: len(codes) - k]]) * m**k + word
                    good &= np.concatenate([np.zeros(min(k, len(codes)), bool), codes[: max(len(codes) - k, 0)] >= 0])[: len(codes)] & (place >= k)
                    hit = np.flatnonzero(good)
                    sums[k] += np.bincount(place[hit] % period * m ** (k + 1) + word[hit], w[hit], len(sums[k]))
            for k, x in enumerate(sums):
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(x[at])], ["k", "code", "n"])

        found = arrow_map(rows, run, "k bigint, code bigint, n double").groupBy("k", "code").agg(F.sum("n").alias("n")).collect()
        counts = [np.zeros((period * m**k, m)) for k in range(order + 1)]
        for r in found:
            counts[r["k"]].reshape(-1)[r["code"]] = r["n"]
        logs = []
        for k, x in enumerate(counts):
            table = {}
            for row in np.flatnonzero(x.sum(axis=1)):
                phase, context = divmod(int(row), m**k)
                name = "".join(alphabet[context // m**j % m] for j in reversed(range(k)))
                total = x[row].sum() + ess
                table |= {f"{phase}{name}{c}": math.log((n + ess / m) / total) for c, n in zip(alphabet, x[row].tolist()) if n + ess > 0}
            logs.append(table)
        return cls(alphabet, order, logs, period)

    def score(self, seq: Column) -> Column:
        """Sum of log conditional probabilities; the first symbols have shorter contexts. Words that were never seen count
        as minus infinity; null if a symbol isn't in the alphabet. In Arrow batches: words are numbers, and their logs are
        looked up for all sequences of a batch at once."""
        import pandas as pd

        m, order, period, alphabet = len(self.alphabet), self.order, self.period, self.alphabet
        tables = [np.asarray([t.get(f"{phase}{''.join(w)}", -math.inf) for phase in range(period) for w in product(alphabet, repeat=k + 1)]) for k, t in enumerate(self.logs)]

        def some_scores(texts):
            codes, lengths = coded(texts, alphabet)
            begins = np.cumsum(lengths) - lengths
            place = np.arange(len(codes)) - np.repeat(begins, lengths)
            plain = np.maximum(codes, 0).astype(np.int64)
            each, word = np.zeros(len(codes)), np.zeros(len(codes), np.int64)
            for k in range(order + 1):
                word = np.concatenate([np.zeros(k, np.int64), plain[: len(codes) - k]]) * m**k + word if k <= len(codes) else word
                here = np.flatnonzero(place == k if k < order else place >= k)
                each[here] = tables[k][place[here] % period * m ** (k + 1) + word[here]]
            out, other = np.zeros(len(texts)), np.zeros(len(texts), bool)
            full = np.flatnonzero(lengths)
            if len(full):
                out[full] = np.add.reduceat(each, begins[full])
                other[full] = np.add.reduceat((codes < 0).astype(np.int64), begins[full]) > 0
            return np.where(other, np.nan, out)

        @F.pandas_udf("double")
        def total(texts):
            scores = [some_scores(some) for some in _parts(texts)]
            return pd.Series(np.concatenate([np.zeros(0), *scores])).where(texts.notna().to_numpy())

        found = total(seq)
        return F.when(~F.isnan(found), found)


@dataclass
class Dependent:
    """Places with parents of their own (a fixed acyclic structure): ``logs[place]`` maps the parents' symbols, then the
    place's, to a log probability."""

    alphabet: str
    parents: list[tuple[int, ...]]
    logs: list[dict[str, float]]

    @classmethod
    def fit(cls, df: DataFrame, seq: str, alphabet: str, parents: list[tuple[int, ...]], ess: float = 0.0, weight: Column | None = None) -> Dependent:
        """One aggregation over (place, parents' symbols, symbol); each parents' value has ``ess`` pseudo-counts."""
        s = F.col(seq)
        cells = F.array(*(F.struct(F.lit(i).alias("place"), F.concat(*(F.substring(s, p + 1, 1) for p in up), F.lit("")).alias("context"), F.substring(s, i + 1, 1).alias("sym")) for i, up in enumerate(parents)))
        rows = df.where(F.length(s) >= len(parents)).select((weight if weight is not None else F.lit(1.0)).alias("w"), F.explode(cells).alias("x")).groupBy("x.place", "x.context", "x.sym").agg(F.sum("w").alias("n")).collect()
        counts: list[dict] = [{} for _ in parents]
        for r in rows:
            if r["sym"] in alphabet and set(r["context"]) <= set(alphabet):
                counts[r["place"]].setdefault(r["context"], {})[r["sym"]] = r["n"]
        m, logs = len(alphabet), []
        for level in counts:
            logs.append({c + a: math.log((row.get(a, 0.0) + ess / m) / (sum(row.values()) + ess)) for c, row in level.items() for a in alphabet if row.get(a, 0.0) + ess > 0})
        return cls(alphabet, parents, logs)

    @classmethod
    def markov(cls, df: DataFrame, seq: str, alphabet: str, length: int, order: int, ess: float = 0.0, weight: Column | None = None) -> Dependent:
        return cls.fit(df, seq, alphabet, [tuple(range(max(0, i - order), i)) for i in range(length)], ess, weight)

    @classmethod
    def learn(cls, df: DataFrame, seq: str, alphabet: str, ess: float = 1.0, weight: Column | None = None) -> Dependent:
        """The best tree of parents by mutual information (one parent a place at most), then its probabilities. Pair counts
        come from one aggregation; the tree is found on the driver."""
        from strandwork.operators.clustering import spanning_forest
        from strandwork.operators.kmers import mutual_information

        pairs = [(r["i"], r["j"], r["mi"]) for r in mutual_information(df.select(seq), seq).collect()]
        n = 1 + max((j for _, j, _ in pairs), default=0)
        near: dict[int, list[int]] = {}
        for i, j, _ in spanning_forest(pairs):
            near.setdefault(i, []).append(j)
            near.setdefault(j, []).append(i)
        parents: list = [None] * n
        for root in range(n):
            todo = [] if parents[root] is not None else [(root, ())]
            while todo:
                i, up = todo.pop()
                if parents[i] is None:
                    parents[i] = up
                    todo += [(j, (i,)) for j in near.get(i, []) if parents[j] is None]
        return cls.fit(df, seq, alphabet, parents, ess, weight)

    def score(self, seq: Column) -> Column:
        """Log probability; minus infinity for what was never seen, null for shorter sequences and other symbols."""
        m = len(self.alphabet)
        terms = []
        for i, up in enumerate(self.parents):
            table = F.lit([self.logs[i].get("".join(w), -math.inf) for w in product(self.alphabet, repeat=len(up) + 1)])
            code = F.lit(0)
            for p in (*up, i):
                code = code * m + F.nullif(F.instr(F.lit(self.alphabet), F.nullif(F.substring(seq, p + 1, 1), F.lit(""))), F.lit(0)) - 1
            terms.append(F.get(table, code))
        return reduce(lambda a, b: a + b, terms)


def fit_on_windows(df: DataFrame, seq: str, length: int, fit, weight: str = "weight"):
    """A model of one length trained on all windows of longer sequences: ``fit(windows)`` gets ``seq`` and ``weight``, equal
    windows as one row."""
    from strandwork.operators.weights import window_weights

    return fit(window_weights(df, seq, length, weight).withColumnRenamed("kmer", "seq"))


def product_score(seq: Column, parts: list[tuple]) -> Column:
    """Sum of models' scores on slices: (model, start, length)."""
    return reduce(lambda a, b: a + b, [model.score(F.substring(seq, start + 1, length)) for model, start, length in parts])


def fit_gaussians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, mean, sd, log_likelihood`` of a Gaussian to each group (maximum likelihood, which needs moments only)."""
    m = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return m.withColumn("log_likelihood", -F.col("n") * (F.log("sd") + 0.5 * math.log(2 * math.pi) + 0.5))


def uniform_score(seq: Column, symbols: int) -> Column:
    return -F.length(seq) * math.log(symbols)


@dataclass
class Mixture:
    """A mixture of PWMs, trained by EM: each step is one pass over the different sequences, in Arrow batches."""

    parts: list[PWM]
    shares: list[float]

    def scores(self, seq: Column) -> list[Column]:
        return [p.score(seq) + math.log(s) for p, s in zip(self.parts, self.shares)]

    def score(self, seq: Column) -> Column:
        return log_sum(F.array(*self.scores(seq)))

    @classmethod
    def fit(cls, df: DataFrame, seq: str, alphabet: str, components: int, steps: int, ess: float = 4.0, seed: int = 0) -> Mixture:
        start = F.pmod(F.xxhash64(F.col(seq), F.lit(seed)), F.lit(components))
        rows = summed(df.select(F.col(seq).alias("seq"), start.cast("int").alias("start")), ["seq", "start"], F.lit(1.0)).persist()
        try:
            model, m = None, len(alphabet)
            for _ in range(steps):
                found = arrow_map(rows, lambda batches, model=model: _mixed(batches, alphabet, components, model), "c int, at bigint, x double").groupBy("c", "at").agg(F.sum("x").alias("x"), F.count("*").alias("n")).collect()
                length = max((r["at"] // m + 1 for r in found if r["at"] >= 0), default=0)
                counts, mass = np.zeros((components, length, m)), np.zeros(components)
                for r in found:
                    if r["at"] < 0:
                        mass[r["c"]] = r["x"]
                    else:
                        counts[r["c"]].reshape(-1)[r["at"]] = r["x"]
                parts = []
                for x in counts:
                    total = x.sum(axis=1, keepdims=True) + ess
                    p = np.where(total == 0, 1.0 / m, (x + ess / m) / np.where(total == 0, 1.0, total))
                    parts.append(PWM(alphabet, [[math.log(v) if v > 0 else -math.inf for v in row] for row in p.tolist()]))
                model = cls(parts, (mass / mass.sum()).tolist())
        finally:
            rows.unpersist()
        return model


def _mixed(batches, alphabet: str, components: int, model: Mixture | None):
    """Sums of responsibilities by component and (place, symbol), and of each component (at -1). Without a model a component
    has nine tenths of the sequences that ``start`` gives to it; rows without a score have none."""
    import pyarrow as pa

    m = len(alphabet)
    counts, mass = np.zeros((components, 0)), np.zeros(components)
    for batch in batches:
        texts, start, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for s in pieces(np.fromiter((len(t or "") for t in texts), np.int64, len(texts))):
            some = [t or "" for t in texts[s]]
            codes, lengths = coded(some, alphabet)
            if model is None:
                share = np.full((components, len(some)), 0.1 / max(components - 1, 1))
                share[start[s], np.arange(len(some))] = 0.9
            else:
                share = np.zeros((components, len(some)))
                size = len(model.parts[0].logs)
                fit = np.flatnonzero((lengths >= size) & [t is not None for t in texts[s]])
                square = codes[(np.cumsum(lengths) - lengths)[fit][:, None] + np.arange(size)]
                good = (square >= 0).all(axis=1)
                fit, square = fit[good], square[good]
                scores = np.stack([np.asarray(p.logs).reshape(size, m)[np.arange(size), square].sum(axis=1) + math.log(w) for p, w in zip(model.parts, model.shares)])
                share[:, fit] = np.exp(scores - np.logaddexp.reduce(scores, axis=0))
            share = share * n[s]
            mass += share.sum(axis=1)
            held = [t is not None for t in texts[s]]
            longest = max(int(lengths.max(initial=0)), int(any(held)))
            if counts.shape[1] < longest * m:
                counts = np.pad(counts, ((0, 0), (0, longest * m - counts.shape[1])))
            at = (np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) * m + codes
            known = codes >= 0
            for c in range(components):
                counts[c] += np.bincount(at[known], np.repeat(share[c], lengths)[known], counts.shape[1])
    for c in range(components):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(1 + counts.shape[1], c, np.int32)), pa.array(np.arange(-1, counts.shape[1])), pa.array(np.concatenate([mass[c : c + 1], counts[c]]))], ["c", "at", "x"])


@dataclass
class HMM:
    """Discrete hidden Markov model; numpy arrays ``start``, ``move`` and ``emit`` (states x symbols)."""

    alphabet: str
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def _emissions(self, text: str) -> np.ndarray:
        """Emission probabilities of each place (places x states); a symbol outside the alphabet tells nothing (ones)."""
        codes = np.asarray([self.alphabet.find(c) for c in text], np.int64)
        out = self.emit.T[codes]
        out[codes < 0] = 1.0
        return out

    def forward(self, text: str | None) -> float:
        """log probability, scaled by place."""
        if not text:
            return 0.0
        total, a = 0.0, None
        for e in self._emissions(text):
            a = e * (self.start if a is None else a @ self.move)
            s = a.sum()
            if s == 0:
                return -math.inf
            total += math.log(s)
            a = a / s
        return total

    def viterbi(self, text: str | None) -> tuple[float, list[int]]:
        if not text:
            return 0.0, []
        with np.errstate(divide="ignore"):
            start, move, emit = np.log(self.start), np.log(self.move), np.log(self._emissions(text))
        v, back = start + emit[0], []
        for e in emit[1:]:
            every = v[:, None] + move
            back.append(every.argmax(axis=0))
            v = every.max(axis=0) + e
        path = [int(v.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return float(v.max()), path[::-1]

    def counts(self, text: str, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of one sequence, by forward and backward passes; zeros if the model can't make it. Symbols
        outside the alphabet add to no emission."""
        e = self._emissions(text)
        n, k = e.shape
        a, b, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
        for t in range(n):
            a[t] = e[t] * (self.start if t == 0 else a[t - 1] @ self.move)
            scale[t] = a[t].sum()
            if scale[t] == 0:
                return np.zeros(k), np.zeros((k, k)), np.zeros(self.emit.shape), -math.inf
            a[t] /= scale[t]
        for t in range(n - 2, -1, -1):
            b[t] = self.move @ (e[t + 1] * b[t + 1]) / scale[t + 1]
        post = a * b
        move = a[:-1].T @ (e[1:] * b[1:] / scale[1:, None]) * self.move
        codes = np.asarray([self.alphabet.find(c) for c in text])
        emit = np.stack([post[codes == c].sum(axis=0) for c in range(len(self.alphabet))], axis=1)
        return weight * post[0], weight * move, weight * emit, weight * float(np.log(scale).sum())

    def _blocks(self, texts: list[str]):
        """Places of texts, lengths (falling) and codes (places x texts, -1 where there is none) of blocks of texts of about
        one length."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        first = 0
        while first < len(order):
            longest = len(texts[order[first]])
            some = order[first : first + max(1, PIECE // max(longest * len(self.start), 1))]
            codes, lengths = coded([texts[i] for i in some], self.alphabet)
            square = np.full((longest, len(some)), -1, np.int64)
            square[np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(np.arange(len(some)), lengths)] = codes
            yield np.asarray(some), lengths, square
            first += len(some)

    def _forward(self, lengths: np.ndarray, codes: np.ndarray):
        """Scaled forward probabilities (places x texts x states) and their scales; those of impossible texts are zero."""
        emit = np.vstack([self.emit.T, np.ones(len(self.start))])  # a symbol outside the alphabet tells nothing
        n, size = codes.shape
        a, scale = np.zeros((n, size, len(self.start))), np.ones((n, size))
        for t in range(n):
            live = int(np.searchsorted(-lengths, -t, "left"))  # texts longer than t
            x = emit[codes[t, :live]] * (self.start if t == 0 else a[t - 1, :live] @ self.move)
            s = x.sum(axis=1)
            scale[t, :live] = s
            a[t, :live] = x / np.where(s > 0, s, 1.0)[:, None]
        return a, scale

    def forwards(self, texts: list[str]) -> np.ndarray:
        """``forward`` of many texts: the same place of all texts of a block at once."""
        out = np.zeros(len(texts))
        for which, lengths, codes in self._blocks(texts):
            with np.errstate(divide="ignore"):
                out[which] = np.log(self._forward(lengths, codes)[1]).sum(axis=0)
        return out

    def all_counts(self, texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The sum of ``counts`` over many texts, the same place of all texts of a block at once."""
        k, m = len(self.start), len(self.alphabet)
        start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, m)), 0.0
        given = np.vstack([self.emit.T, np.ones(k)])
        for which, lengths, codes in self._blocks(texts):
            a, scale = self._forward(lengths, codes)
            able = (scale > 0).all(axis=0)
            if not able.all():
                total = -math.inf
                which, lengths, codes, a, scale = which[able], lengths[able], codes[:, able], a[:, able], scale[:, able]
            if not len(which) or not len(codes):
                continue
            w = weights[which]
            b = np.ones(a.shape)
            for t in range(len(codes) - 2, -1, -1):
                live = int(np.searchsorted(-lengths, -(t + 1), "left"))
                after = given[codes[t + 1, :live]] * b[t + 1, :live] / scale[t + 1, :live, None]
                b[t, :live] = after @ self.move.T
                move += (a[t, :live] * w[:live, None]).T @ after * self.move
            post = a * b * w[:, None]
            start += post[0, lengths > 0].sum(axis=0)
            known = codes >= 0
            for i in range(k):
                emit[i] += np.bincount(codes[known], post[:, :, i][known], m)
            total += float((np.log(scale).sum(axis=0) * w).sum())
        return start, move, emit, total

    def scores(self, df: DataFrame, seq: str, out: str = "score") -> DataFrame:
        """``df`` with the forward score of each sequence, in Arrow batches; nothing is shuffled."""
        import pandas as pd

        model = self

        @F.pandas_udf("double")
        def forward(texts):
            every = texts.fillna("").tolist()
            different = list(dict.fromkeys(every))
            found = dict(zip(different, model.forwards(different).tolist()))
            return pd.Series([found[t] for t in every], dtype="float64")

        return df.withColumn(out, forward(seq))

    def baum_welch(self, df: DataFrame, seq: str, steps: int) -> HMM:
        """Each step's expected counts are summed where the rows are; one small table per task reaches the driver."""
        rows = summed(df.where(F.length(seq) > 0).select(F.col(seq).alias("seq")), ["seq"], F.lit(1.0)).persist()
        try:
            return self._trained(rows, steps)
        finally:
            rows.unpersist()

    def _trained(self, rows: DataFrame, steps: int) -> HMM:
        model = self
        for _ in range(steps):

            def run(batches, model=model):
                import pyarrow as pa

                total = None
                for batch in batches:
                    found = model.all_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy())
                    total = found if total is None else tuple(x + y for x, y in zip(total, found))
                if total is not None:
                    flat = np.concatenate([np.ravel(x) for x in total])
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["i", "x"])

            found = arrow_map(rows, run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
            flat = np.asarray([r["x"] for r in found])
            if not len(flat):
                return model
            k, m = len(model.start), len(model.alphabet)
            start, move, emit = flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : k + k * k + k * m].reshape(k, m)
            model = HMM(model.alphabet, start / start.sum(), move / np.maximum(move.sum(axis=1, keepdims=True), 1e-300), emit / np.maximum(emit.sum(axis=1, keepdims=True), 1e-300))
        return model


@dataclass
class Generative:
    """A classifier of one model and one prior to each class."""

    models: list
    log_priors: list[float]

    @classmethod
    def fit(cls, df: DataFrame, fit_one, classes: int, weight: str = "weight") -> Generative:
        mass = {r["class_id"]: r["w"] for r in df.groupBy("class_id").agg(F.sum(weight).alias("w")).collect()}
        total = sum(mass.values())
        return cls([fit_one(df.where(F.col("class_id") == c)) for c in range(classes)], [math.log(mass.get(c, 0) / total) if mass.get(c) else -math.inf for c in range(classes)])

    def scores(self, seq: Column) -> list[Column]:
        return [m.score(seq) + p for m, p in zip(self.models, self.log_priors)]

    def ratio(self, seq: Column) -> Column:
        """Score of class 0 less that of class 1."""
        a, b = self.scores(seq)
        return a - b


@dataclass
class LogLinear:
    """Discriminative classifier of two classes over places x symbols: ``beta`` mixes conditional likelihood,
    likelihood and prior as (1, 0, 0), (0, 0.5, 0.5) and so on do; here the conditional part with a Gaussian prior."""

    alphabet: str
    weights: np.ndarray
    bias: float

    def score(self, seq: Column) -> Column:
        """Positive for class 0; null as for matrices."""
        return _by_place(seq, self.alphabet, self.weights) + self.bias

    @classmethod
    def fit(cls, df: DataFrame, seq: str, alphabet: str, length: int, steps: int = 60, prior: float = 0.01) -> LogLinear:
        """Gradient steps; each gradient is one aggregation over places and symbols. Rows that are shorter than ``length`` or
        have other symbols there aren't learnt from."""
        df = df.where(F.length(seq) >= length).where(F.translate(F.substring(seq, 1, length), alphabet, "") == "")
        model = cls(alphabet, np.zeros((length, len(alphabet))), 0.0)
        n = df.agg(F.sum("weight")).first()[0] or 1.0
        for step in range(steps):
            p = 1 / (1 + F.exp(-model.score(F.col(seq))))
            slope = (F.when(F.col("class_id") == 0, 1.0).otherwise(0.0) - p) * F.col("weight")
            cells = position_counts(df, seq, slope).collect()
            g = np.zeros_like(model.weights)
            for r in cells:
                if r["pos"] < length and r["sym"] in alphabet and r["cnt"] is not None:  # rows without a score teach nothing
                    g[r["pos"], alphabet.index(r["sym"])] += r["cnt"] / n
            rate = 4.0 / (1 + step / 20)
            model = cls(alphabet, model.weights + rate * (g - prior * model.weights / n), model.bias + rate * float(g[0].sum()))
        return model


#: Learning principles as shares of conditional likelihood, likelihood and prior.
PRINCIPLES = {"ML": (0.0, 1.0, 0.0), "MAP": (0.0, 0.5, 0.5), "MCL": (1.0, 0.0, 0.0), "MSP": (0.5, 0.0, 0.5)}


@dataclass
class GenDisMix:
    """A classifier of one matrix to each class, trained by any mixture of conditional likelihood, likelihood and prior.

    ``theta`` (classes x places x symbols) and ``xi`` (classes) are logarithms up to a constant: a class's places and the
    classes' shares are their softmax.
    """

    alphabet: str
    theta: np.ndarray
    xi: np.ndarray

    @staticmethod
    def _logs(x: np.ndarray) -> np.ndarray:
        x = x - x.max(axis=-1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))

    def scores(self, seq: Column) -> list[Column]:
        """Log of the joint probability of class and sequence; null as for matrices."""
        return [_by_place(seq, self.alphabet, m) + float(c) for m, c in zip(self._logs(self.theta), self._logs(self.xi))]

    def score(self, seq: Column) -> Column:
        """Of two classes, the first's score less the second's."""
        a, b = self.scores(seq)[:2]
        return a - b

    def _slopes(self, batches, beta):
        """The data's part of the objective, then by (class, place, symbol) what pushes the matrices."""
        import pyarrow as pa

        logs, shares = self._logs(self.theta), self._logs(self.xi)
        classes, length, m = logs.shape
        out = np.zeros(1 + classes * length * m)
        for batch in batches:
            texts, own, w = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            square = coded(texts, self.alphabet)[0].reshape(len(texts), length).astype(np.int64)
            s = np.stack([logs[k][np.arange(length), square].sum(axis=1) + shares[k] for k in range(classes)])
            every = np.logaddexp.reduce(s, axis=0)
            mine = s[own, np.arange(len(texts))]
            out[0] += (w * (beta[0] * (mine - every) + beta[1] * mine)).sum()
            at = (square + np.arange(length) * m).ravel()
            for k in range(classes):
                push = w * (beta[0] * ((own == k) - np.exp(s[k] - every)) + beta[1] * (own == k))
                out[1 + k * length * m : 1 + (k + 1) * length * m] += np.bincount(at, np.repeat(push, length), length * m)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out)], ["i", "x"])

    @classmethod
    def fit(cls, df: DataFrame, seq: str, alphabet: str, length: int, classes: int = 2, beta=PRINCIPLES["MSP"], prior: str = "dirichlet", strength: float = 4.0, weight: str = "weight", steps: int = 40) -> GenDisMix:
        """Each value and gradient of the objective is one pass over the different sequences of each class, in Arrow batches.

        ``prior``: ``dirichlet`` (``strength`` pseudo-counts to a class, spread over the symbols of each place), ``gaussian``
        (variance ``strength``), ``laplace`` (scale ``strength``) or ``none``.
        """
        from strandwork.operators.clustering import after, any_of, minimise, small_change

        s = F.col(seq)
        rows = df.where(F.length(s) >= length).where(F.translate(F.substring(s, 1, length), alphabet, "") == "").where(F.col("class_id").between(0, classes - 1))
        rows = rows.select(F.substring(s, 1, length).alias("seq"), F.col("class_id").alias("c"), F.col(weight).cast("double").alias("w"))
        rows = summed(rows, ["seq", "c"], F.col("w")).persist()
        total = rows.agg(F.sum("w")).first()[0] or 1.0
        m, shape = len(alphabet), (classes, length, len(alphabet))
        seen: dict[bytes, tuple[float, np.ndarray]] = {}

        def split(x):
            return x[: classes * length * m].reshape(shape), x[classes * length * m :]

        def both(x):
            if x.tobytes() not in seen:
                theta, xi = split(x)
                model = cls(alphabet, theta, xi)
                found = arrow_map(rows, lambda batches: model._slopes(batches, beta), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
                flat = np.zeros(1 + classes * length * m)
                for r in found:
                    flat[r["i"]] = r["x"]
                v, n = float(flat[0]), flat[1:].reshape(shape)
                logs, shares = cls._logs(theta), cls._logs(xi)
                mass = n.sum(axis=2, keepdims=True)
                g, gx = n - mass * np.exp(logs), mass[:, 0, 0] - mass[:, 0, 0].sum() * np.exp(shares)
                b = beta[2]
                if prior == "dirichlet":
                    pc = strength / m
                    v += b * (pc * logs.sum() + strength * shares.sum())
                    g += b * (pc - pc * m * np.exp(logs))
                    gx += b * (strength - strength * classes * np.exp(shares))
                elif prior == "gaussian":
                    v -= b * ((theta**2).sum() + (xi**2).sum()) / (2 * strength)
                    g, gx = g - b * theta / strength, gx - b * xi / strength
                elif prior == "laplace":
                    v -= b * (np.abs(theta).sum() + np.abs(xi).sum()) / strength
                    g, gx = g - b * np.sign(theta) / strength, gx - b * np.sign(xi) / strength
                seen.clear()
                seen[x.tobytes()] = -v / total, -np.concatenate([g.ravel(), gx]) / total
            return seen[x.tobytes()]

        start = np.zeros(classes * length * m + classes)
        try:
            best = minimise(lambda x: both(x)[0], lambda x: both(x)[1], start, "lbfgs", any_of(after(steps), small_change(1e-10)))
        finally:
            rows.unpersist()
        theta, xi = split(best)
        return cls(alphabet, theta, xi)
