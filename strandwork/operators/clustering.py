"""Distances, clustering, alignment and small graph algorithms.

What depends on rows is DataFrame work; what depends on a bounded number of objects (centres, motifs, places) runs on
the driver in numpy.
"""

from __future__ import annotations

import math
import time

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.scalar import p_norm


def nearest_centre(vector: Column, centres: list[list[float]]) -> Column:
    """Struct of the least Euclidean distance and the centre's number."""
    return F.array_min(F.array(*(F.struct(p_norm(vector, F.lit([float(x) for x in c])).alias("d"), F.lit(i).alias("centre")) for i, c in enumerate(centres))))


def kmeans_step(df: DataFrame, vector: str, centres: list[list[float]]) -> DataFrame:
    """``centre, n, place, mean``: one Lloyd step in long form."""
    near = df.select(vector, nearest_centre(F.col(vector), centres).alias("near")).select("near.centre", F.posexplode(vector).alias("place", "x"))
    return near.groupBy("centre", "place").agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double")).alias("mean"))


def kmeans(df: DataFrame, vector: str, centres: list[list[float]], steps: int = 20) -> list[list[float]]:
    """Lloyd's algorithm from given centres until they stay; centres are k x dimensions numbers."""
    for _ in range(steps):
        new = [list(c) for c in centres]
        for r in kmeans_step(df, vector, centres).collect():
            new[r["centre"]][r["place"]] = r["mean"]
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def agglomerate(distance: np.ndarray, linkage: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (left, right, distance, size); new clusters are numbered from n on."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    n = len(d)
    label, size, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        out.append((label[i], label[j], float(d[i, j]), size[i] + size[j]))
        if linkage == "single":
            row = np.minimum(d[i], d[j])
        elif linkage == "complete":
            row = np.maximum(np.where(np.isinf(d[i]), -np.inf, d[i]), np.where(np.isinf(d[j]), -np.inf, d[j]))
            row[np.isinf(d[i]) & np.isinf(d[j])] = np.inf
        else:
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        label[i], size[i] = n + step, size[i] + size[j]
    return out


def newick(merges: list[tuple[int, int, float, int]], names: list[str]) -> str:
    text = dict(enumerate(names))
    for k, (a, b, d, _) in enumerate(merges):
        text[len(names) + k] = f"({text.pop(a)},{text.pop(b)}):{d:g}"
    return ",".join(text.values()) + ";"


def cut_tree(merges: list[tuple[int, int, float, int]], n: int, limit: float) -> list[int]:
    """Cluster number of each object when merges beyond ``limit`` are undone."""
    root = list(range(n + len(merges)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, b, d, _) in enumerate(merges):
        if d <= limit:
            root[find(a)] = root[find(b)] = n + k
    seen: dict[int, int] = {}
    return [seen.setdefault(find(i), len(seen)) for i in range(n)]


def all_pairs(df: DataFrame, id_col: str, distance, blocks: int = 16) -> DataFrame:
    """``a, b, d`` for a < b: all pairs are what is asked for, and they are dealt to pairs of blocks of objects, so that no
    task holds them all. ``distance`` reads the columns of both as ``l_*`` and ``r_*``."""
    mine = F.pmod(F.xxhash64(id_col), F.lit(blocks))
    dealt = df.withColumn("__mine", mine).withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keyed = dealt.withColumn("__x", F.least("__mine", "__other")).withColumn("__y", F.greatest("__mine", "__other"))
    names = [*df.columns, "__mine"]
    left, right = (keyed.select("__x", "__y", *(F.col(c).alias(f"{p}_{c}") for c in names)) for p in "lr")
    both = left.join(right, ["__x", "__y"]).where((F.col(f"l_{id_col}") < F.col(f"r_{id_col}")) & ((F.col("l___mine") != F.col("r___mine")) | (F.col("__x") == F.col("__y"))))
    return both.select(F.col(f"l_{id_col}").alias("a"), F.col(f"r_{id_col}").alias("b"), distance.alias("d"))


def align(a: str, b: str, match: float = 0, mismatch: float = 1, gap: float = 1, kind: str = "global", opening: float = 0) -> tuple[float, str, str]:
    """Least-cost alignment: ``global``, ``semi`` (free ends of b), ``free`` (free ends of both) or ``local``
    (costs below zero are gains); ``opening`` is paid once a gap. Ties: diagonal only if strictly better, then left."""
    n, m = len(a), len(b)
    inf = math.inf
    best = np.full((3, n + 1, m + 1), inf)  # match, gap in b (up), gap in a (left)
    came = np.zeros((3, n + 1, m + 1), np.int8)
    best[0, 0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if kind == "local" or (kind in ("semi", "free") and i == 0) or (kind == "free" and j == 0):
                best[0, i, j], came[0, i, j] = 0, -1
            if i and j:
                before = best[:, i - 1, j - 1]
                k = int(before.argmin())
                cost = before[k] + (match if a[i - 1] == b[j - 1] else mismatch)
                if cost < best[0, i, j]:
                    best[0, i, j], came[0, i, j] = cost, k
            if i:
                costs = best[:, i - 1, j] + gap + np.asarray([opening, 0, opening])
                k = int(costs.argmin())
                if costs[k] < best[1, i, j]:
                    best[1, i, j], came[1, i, j] = costs[k], k
            if j:
                costs = best[:, i, j - 1] + gap + np.asarray([opening, opening, 0])
                k = int(costs.argmin())
                if costs[k] < best[2, i, j]:
                    best[2, i, j], came[2, i, j] = costs[k], k
    ends = {"global": [(n, m)], "semi": [(n, j) for j in range(m + 1)], "free": [(n, j) for j in range(m + 1)] + [(i, m) for i in range(n + 1)], "local": [(i, j) for i in range(n + 1) for j in range(m + 1)]}[kind]
    cost, i, j, layer = min((best[layer, i, j], i, j, layer) for i, j in ends for layer in (2, 1, 0))
    x, y = "", ""
    total = float(cost)
    while (i or j) and not (layer == 0 and came[0, i, j] == -1):
        before = int(came[layer, i, j])
        if layer == 0:
            i, j = i - 1, j - 1
            x, y = a[i] + x, b[j] + y
        elif layer == 1:
            i -= 1
            x, y = a[i] + x, "-" + y
        else:
            j -= 1
            x, y = "-" + x, b[j] + y
        layer = before
    return total, x, y


def align_costs(a: list[str], b: list[str], match: float = 0, mismatch: float = 1, gap: float = 1, kind: str = "global", opening: float = 0) -> np.ndarray:
    """The costs that ``align`` gives for many pairs, cell by cell for all pairs at once (shorter ones are padded, which
    changes no cell before their ends)."""
    out = np.zeros(len(a))
    order = sorted(range(len(a)), key=lambda i: (len(a[i]), len(b[i])))
    first = 0
    while first < len(order):
        most = max(1, (1 << 18) // (len(b[order[first]]) + 1))
        some = order[first : first + most]
        widest = max(len(b[i]) for i in some)
        while len(some) > 1 and len(some) * (widest + 1) > 1 << 19:
            some = some[: len(some) // 2]
            widest = max(len(b[i]) for i in some)
        out[some] = _costs([a[i] for i in some], [b[i] for i in some], match, mismatch, gap, kind, opening)
        first += len(some)
    return out


def _costs(a: list[str], b: list[str], match, mismatch, gap, kind, opening) -> np.ndarray:
    def padded(texts, fill):
        out = np.full((max(map(len, texts)), len(texts)), fill, np.int64)
        for k, t in enumerate(texts):
            out[: len(t), k] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        return out

    x, y = padded(a, -1), padded(b, -2)
    n, m, size = len(x), len(y), len(a)
    la, lb = np.asarray([len(t) for t in a]), np.asarray([len(t) for t in b])
    best = np.full((m + 1, 3, size), np.inf)  # the row before: match, gap in b (up), gap in a (left)
    total = np.full(size, np.inf)
    for i in range(n + 1):
        row = np.full((m + 1, 3, size), np.inf)
        for j in range(m + 1):
            cell = row[j]
            if i == j == 0 or kind == "local" or (kind in ("semi", "free") and i == 0) or (kind == "free" and j == 0):
                cell[0] = 0
            if i and j:
                cell[0] = np.minimum(cell[0], best[j - 1].min(axis=0) + np.where(x[i - 1] == y[j - 1], match, mismatch))
            if i:
                up = best[j]
                cell[1] = np.minimum(np.minimum(up[0], up[2]) + opening, up[1]) + gap
            if j:
                left = row[j - 1]
                cell[2] = np.minimum(np.minimum(left[0], left[1]) + opening, left[2]) + gap
            ends = {"global": (i == la) & (j == lb), "semi": (i == la) & (j <= lb), "free": ((i == la) & (j <= lb)) | ((j == lb) & (i <= la)), "local": (i <= la) & (j <= lb)}[kind]
            if ends.any():
                total = np.where(ends, np.minimum(total, cell.min(axis=0)), total)
        best = row
    return total


def align_columns(df: DataFrame, a: str, b: str, out: str = "cost", **how) -> DataFrame:
    """``df`` with the alignment cost of two columns, in Arrow batches; the pairs of a batch are aligned together."""

    @F.pandas_udf("double")
    def cost(x, y):
        import pandas as pd

        pairs = list(zip(x.fillna("").tolist(), y.fillna("").tolist()))
        different = list(dict.fromkeys(pairs))
        costs = dict(zip(different, align_costs([p for p, _ in different], [q for _, q in different], **how).tolist()))
        return pd.Series([costs[p] for p in pairs], dtype="float64")

    return df.withColumn(out, cost(a, b))


def spanning_forest(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Maximum spanning forest: heaviest edges first, none that closes a ring."""
    root: dict[int, int] = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    out = []
    for a, b, w in sorted(edges, key=lambda e: -e[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b, w))
    return out


def optimal_branching(weight: np.ndarray, root: int) -> list[int]:
    """Parent of each node in the heaviest arborescence (``weight[parent, child]``); the root's is -1."""
    n = len(weight)
    w = weight.astype(float).copy()
    np.fill_diagonal(w, -np.inf)
    w[:, root] = -np.inf
    parent = [-1 if v == root else int(w[:, v].argmax()) for v in range(n)]
    for start in range(n):
        path, v = [], start
        while v != -1 and v not in path:
            path.append(v)
            v = parent[v]
        if v == -1:
            continue
        ring = path[path.index(v) :]
        inside, outside = set(ring), [u for u in range(n) if u not in ring]
        small = np.full((len(outside) + 1, len(outside) + 1), -np.inf)
        enter, leave = {}, {}
        for i, u in enumerate(outside):
            for j, x in enumerate(outside):
                small[i, j] = w[u, x]
            gain = [(w[u, r] - w[parent[r], r], r) for r in ring]
            small[i, -1], enter[i] = max(gain)
            small[-1, i], leave[i] = max((w[r, u], r) for r in ring)
        below = optimal_branching(small, outside.index(root))
        out = list(parent)
        for j, x in enumerate(outside):
            p = below[j]
            out[x] = -1 if p == -1 else (leave[j] if p == len(outside) else outside[p])
        out[enter[below[-1]]] = outside[below[-1]]
        assert inside
        return out
    return parent


def longest_path(weight: np.ndarray) -> list[int]:
    """Heaviest path through all nodes, by dynamic programming over subsets (few nodes)."""
    n = len(weight)
    best = {(1 << i, i): (0.0, -1) for i in range(n)}
    for mask in range(1, 1 << n):
        for i in range(n):
            if (mask, i) not in best:
                continue
            for j in range(n):
                if not mask >> j & 1:
                    key, value = (mask | 1 << j, j), best[mask, i][0] + weight[i, j]
                    if key not in best or value > best[key][0]:
                        best[key] = value, i
    mask = (1 << n) - 1
    i = max(range(n), key=lambda k: best[mask, k][0])
    path = []
    while i != -1:
        path.append(i)
        mask, i = mask ^ 1 << i, best[mask, i][1]
    return path[::-1]


def leaf_order(merges: list[tuple[int, int, float, int]], distance: np.ndarray) -> list[int]:
    """The order of a tree's leaves, among those that turning its branches gives, with the least sum of distances between
    neighbours: by dynamic programming over the ends of each branch (a bounded number of objects)."""
    n = len(distance)
    # of each branch: (left end, right end) -> cost and the order
    best: dict[int, dict] = {i: {(i, i): (0.0, [i])} for i in range(n)}
    for k, (a, b, _, _) in enumerate(merges):
        found: dict = {}
        for one, other in ((best[a], best[b]), (best[b], best[a])):
            for (u, v), (x, left) in one.items():
                for (w, z), (y, right) in other.items():
                    cost = x + distance[v, w] + y
                    if (u, z) not in found or cost < found[u, z][0]:
                        found[u, z] = cost, left + right
        best[n + k] = found
        del best[a], best[b]
    return min((cost, order) for tree in best.values() for cost, order in tree.values())[1]


def topological_order(children: dict) -> list:
    """Nodes of a directed graph, each before its children; raises where there is a ring."""
    waiting = dict.fromkeys(children, 0)
    for below in children.values():
        for c in below:
            waiting[c] = waiting.get(c, 0) + 1
    ready, out = [x for x, k in waiting.items() if not k], []
    while ready:
        x = ready.pop(0)
        out.append(x)
        for c in children.get(x, ()):
            waiting[c] -= 1
            if not waiting[c]:
                ready.append(c)
    if len(out) < len(waiting):
        raise ValueError("the graph has a ring")
    return out


# --- optimisation: a stop is a function of the state (step, change, gradient, move, seconds, value) ------


def after(steps: int):
    return lambda s: s["step"] >= steps


def small_change(limit: float):
    return lambda s: abs(s["change"]) < limit


def small_gradient(limit: float):
    return lambda s: float(np.linalg.norm(s["gradient"])) < limit


def small_step(limit: float):
    return lambda s: s["move"] < limit


def time_over(seconds: float):
    return lambda s: s["seconds"] >= seconds


def value_below(limit: float):
    return lambda s: s["value"] < limit


def any_of(*stops):
    return lambda s: any([f(s) for f in stops])


def all_of(*stops):
    return lambda s: all([f(s) for f in stops])


def repeatedly(stop, times: int):
    """Holds when ``stop`` has held so often in a row."""
    seen = [0]

    def f(s):
        seen[0] = seen[0] + 1 if stop(s) else 0
        return seen[0] >= times

    return f


def minimise(f, gradient, x: np.ndarray, method: str = "lbfgs", stop=None, memory: int = 10) -> np.ndarray:
    """Steepest descent (``steepest``), conjugate gradients (``cg_fr``, ``cg_prp``, and ``cg``, which restarts), ``bfgs``,
    ``dfp`` or ``lbfgs``, with backtracking line search, until ``stop`` holds."""
    stop = stop or any_of(after(200), small_change(1e-8))
    x = np.asarray(x, float)
    g, value, began = gradient(x), f(x), time.monotonic()
    way, s, y, inverse = -g, [], [], np.eye(len(x))
    step = 0
    while True:
        if g @ way >= 0:
            way = -g
        rate = 1.0
        while f(x + rate * way) > value + 1e-4 * rate * (g @ way) and rate > 1e-14:
            rate /= 2
        new = x + rate * way
        g_new, value_new = gradient(new), f(new)
        dx, dg = new - x, g_new - g
        if method.startswith("cg"):
            share = g_new @ g_new if method == "cg_fr" else g_new @ dg
            share /= max(g @ g, 1e-300)
            way = -g_new + (max(0.0, share) if method == "cg" else share) * way
        elif method == "lbfgs":
            s, y = [*s, dx][-memory:], [*y, dg][-memory:]
            q, alphas = g_new.copy(), []
            for a, b in zip(reversed(s), reversed(y)):
                alphas.append(a @ q / (a @ b + 1e-300))
                q -= alphas[-1] * b
            q *= s[-1] @ y[-1] / (y[-1] @ y[-1] + 1e-300)
            for a, b, al in zip(s, y, reversed(alphas)):
                q += a * (al - b @ q / (a @ b + 1e-300))
            way = -q
        elif method in ("bfgs", "dfp"):
            curve = dx @ dg
            if curve > 1e-12:
                if method == "bfgs":
                    left = np.eye(len(x)) - np.outer(dx, dg) / curve
                    inverse = left @ inverse @ left.T + np.outer(dx, dx) / curve
                else:
                    turned = inverse @ dg
                    inverse = inverse + np.outer(dx, dx) / curve - np.outer(turned, turned) / (dg @ turned)
            way = -inverse @ g_new
        else:
            way = -g_new
        step += 1
        state = {"step": step, "change": value - value_new, "gradient": g_new, "move": float(np.linalg.norm(dx)), "seconds": time.monotonic() - began, "value": value_new}
        x, g, value = new, g_new, value_new
        if stop(state):
            return x
