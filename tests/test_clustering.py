"""Distances, trees, alignments, graphs and optimisers against plain enumeration."""

import random
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.operators import clustering as C
from strandwork.operators import kmers, motifs, sets
from strandwork.functions import scalar as S


def _points(n=30, d=3, seed=0):
    return np.random.default_rng(seed).normal(size=(n, d)) + np.repeat(np.eye(d) * 6, n // d, axis=0)


def test_kmeans(spark):
    x = _points()
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, v array<double>")
    start = [[float(v) for v in x[i]] for i in (0, 1, 15)]
    centres = np.asarray(start)
    for _ in range(20):
        near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.stack([x[near == k].mean(0) if (near == k).any() else centres[k] for k in range(3)])
    assert np.allclose(C.kmeans(df, "v", start), centres)


@pytest.mark.parametrize("linkage", ["single", "average", "complete"])
def test_agglomerate(linkage):
    x = _points(12, 3, 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    how = {"single": np.min, "average": np.mean, "complete": np.max}[linkage]
    groups = {i: (i,) for i in range(len(x))}
    for k, (a, b, dist, size) in enumerate(C.agglomerate(d, linkage)):
        best = min(how(d[np.ix_(p, q)]) for p, q in combinations(groups.values(), 2))
        assert dist == pytest.approx(best) == pytest.approx(how(d[np.ix_(groups[a], groups[b])]))
        groups[len(x) + k] = groups.pop(a) + groups.pop(b)
        assert size == len(groups[len(x) + k])
    merges = C.agglomerate(d, linkage)
    cut = C.cut_tree(merges, len(x), merges[-3][2])  # all but the last two merges
    assert len(set(cut)) == 3


def test_newick_and_leaf_order():
    d = np.asarray([[0, 1, 6, 7], [1, 0, 5, 8], [6, 5, 0, 2], [7, 8, 2, 0]], float)
    merges = C.agglomerate(d, "average")
    assert C.newick(merges, list("abcd")) == "((a,b):1,(c,d):2):6.5;"
    order = C.leaf_order(merges, d)
    assert sorted(order) == [0, 1, 2, 3]
    trees = [p + q for p in ([0, 1], [1, 0]) for q in ([2, 3], [3, 2])] + [q + p for p in ([0, 1], [1, 0]) for q in ([2, 3], [3, 2])]
    best = min(sum(d[a, b] for a, b in zip(t, t[1:])) for t in trees)
    assert sum(d[a, b] for a, b in zip(order, order[1:])) == best


def _cheapest(a, b, kind, opening):
    """Least cost by recursion over prefixes, with what the last step was."""
    free_a, free_b = kind == "free", kind in ("semi", "free")

    @lru_cache(None)
    def cost(i, j, last):
        if i == 0 and j == 0:
            return 0 if last == "m" else float("inf")
        if last == "m":
            if (i == 0 and free_b) or (j == 0 and free_a):
                return 0
            return min(cost(i - 1, j - 1, x) for x in "mud") + (a[i - 1] != b[j - 1]) if i and j else float("inf")
        if last == "u":
            return min(cost(i - 1, j, x) + 1 + (0 if x == "u" else opening) for x in "mud") if i else float("inf")
        return min(cost(i, j - 1, x) + 1 + (0 if x == "d" else opening) for x in "mud") if j else float("inf")

    ends = {"global": [(len(a), len(b))], "semi": [(len(a), j) for j in range(len(b) + 1)], "free": [(len(a), j) for j in range(len(b) + 1)] + [(i, len(b)) for i in range(len(a) + 1)]}[kind]
    return min(cost(i, j, x) for i, j in ends for x in "mud")


@pytest.mark.parametrize("kind", ["global", "semi", "free"])
@pytest.mark.parametrize("opening", [0, 2])
def test_align(kind, opening):
    rng = random.Random(opening)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 7))) for _ in range(2))
        cost, x, y = C.align(a, b, kind=kind, opening=opening)
        assert cost == _cheapest(a, b, kind, opening), (a, b)
        assert len(x) == len(y)
        if kind == "global":
            assert x.replace("-", "") == a and y.replace("-", "") == b


def test_align_local():
    rng = random.Random(5)
    for _ in range(40):
        a, b = ("".join(rng.choice("AC") for _ in range(rng.randint(1, 6))) for _ in range(2))
        cost, x, y = C.align(a, b, match=-1, mismatch=1, gap=1, kind="local")
        parts = [(a[i:j], b[k:m]) for i in range(len(a) + 1) for j in range(i, len(a) + 1) for k in range(len(b) + 1) for m in range(k, len(b) + 1)]
        assert cost == min(C.align(p, q, match=-1, mismatch=1, gap=1)[0] for p, q in parts)
        assert x.replace("-", "") in a and y.replace("-", "") in b


def test_spanning_forest():
    rng = random.Random(1)
    edges = [(i, j, rng.random()) for i, j in combinations(range(6), 2)]
    best = 0.0
    for tree in combinations(edges, 5):
        root = list(range(6))
        for a, b, _ in tree:
            ra, rb = root[a], root[b]
            root = [ra if r == rb else r for r in root]
        if len(set(root)) == 1:
            best = max(best, sum(w for *_, w in tree))
    assert sum(w for *_, w in C.spanning_forest(edges)) == pytest.approx(best)


def test_optimal_branching():
    from itertools import product

    rng = np.random.default_rng(2)
    for _ in range(30):
        w = rng.normal(size=(5, 5))
        best = -np.inf
        for parents in product(range(5), repeat=4):
            every = [-1, *parents]
            if any(every[v] == v for v in range(1, 5)):
                continue
            ok = True
            for v in range(1, 5):
                seen, u = set(), v
                while u != 0 and u not in seen:
                    seen.add(u)
                    u = every[u]
                ok &= u == 0
            if ok:
                best = max(best, sum(w[every[v], v] for v in range(1, 5)))
        found = C.optimal_branching(w, 0)
        assert found[0] == -1 and sum(w[found[v], v] for v in range(1, 5)) == pytest.approx(best)


def test_longest_path_and_order():
    w = np.random.default_rng(3).normal(size=(5, 5))
    path = C.longest_path(w)
    best = max(sum(w[a, b] for a, b in zip(p, p[1:])) for p in permutations(range(5)))
    assert sum(w[a, b] for a, b in zip(path, path[1:])) == pytest.approx(best)
    order = C.topological_order({"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": []})
    assert order.index("a") < order.index("b") < order.index("d") and order.index("c") < order.index("d")
    with pytest.raises(ValueError):
        C.topological_order({"a": ["b"], "b": ["a"]})


@pytest.mark.parametrize("method", ["steepest", "cg", "cg_fr", "cg_prp", "lbfgs", "bfgs", "dfp"])
def test_minimise(method):
    a = np.asarray([[3.0, 0.5, 0], [0.5, 2.0, 0.3], [0, 0.3, 1.0]])
    b = np.asarray([1.0, -2.0, 0.5])
    x = C.minimise(lambda v: v @ a @ v / 2 - b @ v, lambda v: a @ v - b, np.zeros(3), method, stop=C.any_of(C.after(500), C.small_change(1e-14)))
    assert np.allclose(x, np.linalg.solve(a, b), atol=1e-4)


def test_stops():
    state = {"step": 3, "change": 1e-3, "gradient": np.asarray([3.0, 4.0]), "move": 0.1, "seconds": 5.0, "value": 2.0}
    assert C.after(3)(state) and not C.after(4)(state)
    assert C.small_change(1e-2)(state) and not C.small_change(1e-4)(state)
    assert C.small_gradient(5.1)(state) and not C.small_gradient(4.9)(state)
    assert C.small_step(0.2)(state) and C.time_over(4)(state) and C.value_below(3)(state)
    assert C.any_of(C.after(9), C.time_over(4))(state) and not C.all_of(C.after(9), C.time_over(4))(state)
    often = C.repeatedly(C.small_change(1e-2), 2)
    assert not often(state) and often(state)


def test_de_bruijn():
    for n in (1, 2, 3, 4):
        text = kmers.de_bruijn("ACGT", n)
        assert sorted({(text + text[: n - 1])[i : i + n] for i in range(len(text))}) == sorted("".join(w) for w in __import__("itertools").product("ACGT", repeat=n))
        assert len(text) == 4**n


def test_distances(spark):
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(_points(12))], "id bigint, v array<double>")
    x = _points(12)
    got = {(r["a"], r["b"]): r["d"] for r in C.all_pairs(df, "id", S.array_pearson(F.col("l_v"), F.col("r_v")), 3).collect()}
    assert set(got) == set(combinations(range(12), 2))
    assert all(v == pytest.approx(np.corrcoef(x[a], x[b])[0, 1]) for (a, b), v in got.items())


def test_profiles_and_clusters():
    from strandwork.operators.models import PWM

    rng = np.random.default_rng(1)

    def pwm(text, noise):
        p = np.full((len(text), 4), 0.05) + rng.random((len(text), 4)) * noise
        for i, c in enumerate(text):
            p[i, "ACGT".index(c)] += 1
        return PWM("ACGT", np.log(p / p.sum(1, keepdims=True)).tolist())

    found = {"a1": pwm("ACGTA", 0.01), "a2": pwm("ACGTA", 0.02), "b1": pwm("TTGGC", 0.01), "b2": pwm("TTGGC", 0.02)}
    assert motifs.profile_distance(found["a1"], found["a1"], 5) == pytest.approx(0)
    groups = motifs.clustered(found, 0.3, order=5)
    assert groups["a1"] == groups["a2"] != groups["b1"] == groups["b2"]


def test_matrix_search(spark):
    a = np.asarray([[8, 1, 1, 0], [0, 9, 0, 1], [1, 1, 7, 1.0]])
    table = [("x", i, "ACGT"[j], float(a[i, j])) for i in range(3) for j in range(4)] + [("y", i, "ACGT"[j], float(a[::-1, ::-1][i, j])) for i in range(3) for j in range(4)]
    got = {r["motif"]: (r["strand"], r["offset"], r["d"]) for r in motifs.search(spark.createDataFrame(table, "motif string, pos int, sym string, cnt double"), a, least=3).collect()}
    assert got == {"x": ("+", 0, 0.0), "y": ("-", 0, 0.0)}
    wide, at = motifs.matrix_distance(a, a[1:], least=2, uniform_border=True)
    assert at == 1 and wide > 0


def test_union_find(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 2), (5, 6)], "a bigint, b bigint")
    assert sets.merged_sets(pairs, "a", "b") == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
