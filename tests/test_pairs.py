"""Searches over pairs of large blocks against NumPy over whole arrays, with small tiles."""

import numpy as np
import pandas as pd
import pytest

from cairn.operators import density, knn, pairs
from cairn.operators.steps import Steps


def rows(pos, x, **fields):
    return pairs.Rows({"pos": np.asarray(pos, np.int64).tobytes(), "vec": np.asarray(x, float).tobytes()} | {k: np.asarray(v, float).tobytes() for k, v in fields.items()})


def apart(x, metric="euclidean"):
    with np.errstate(all="ignore"):
        return density.distances(x, x, metric)


def reach(x, k=3):
    d = apart(x)
    core = np.sort(np.where(np.eye(len(x), dtype=bool), np.inf, d), axis=1)[:, k - 1]
    return core, np.maximum(d, np.maximum(core[:, None], core[None]))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("grid, odd", [(False, False), (True, False), (True, True)])
def test_nearest(monkeypatch, metric, grid, odd):
    """With ties, with rows that are no numbers, and with fewer rows than asked for."""
    monkeypatch.setattr(pairs, "TILE", 16)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(101, 5))
    x = np.round(x, 0) if grid else x + 1000
    if odd:
        x[3], x[5, 2] = np.nan, np.inf
    pos, a, b, d = rng.permutation(500)[:101], np.arange(60), np.arange(60, 101), apart(x, metric)
    for k in (1, 7, 120):
        one, two = pairs.nearest(rows(pos[a], x[a]), rows(pos[b], x[b]), k, metric)
        (own,) = pairs.nearest(rows(pos[a], x[a]), None, k, metric)
        for found, left, right in ((one, a, b), (two, b, a), (own, a, a)):
            got = {p: (g.near.tolist(), g.distance.tolist()) for p, g in found.frame("", pos[left]).groupby("pos")}
            for i in left:
                want = sorted((d[i, j], pos[j]) for j in right if j != i and np.isfinite(d[i, j]))[:k]
                ids, far = got.get(pos[i], ([], []))
                assert ids == [p for _, p in want] and far == pytest.approx([w for w, _ in want], abs=1e-9)


def order_of(tree, n):
    """The leaves in an order in which each part of the tree stands together, and the edge that joins each to the next."""
    own, groups, gap = list(range(n)), {i: [i] for i in range(n)}, {}
    for r, (a, b, w) in enumerate(tree[["a", "b", "w"]].itertuples(index=False)):
        p, q = own[a], own[b]
        gap[groups[p][-1]] = (r, w, a, b)
        for v in groups[q]:
            own[v] = p
        groups[p] += groups.pop(q)
    (order,) = groups.values()
    return order, np.array([gap.get(v, (-1, -np.inf, -1, -1)) for v in order], float)


@pytest.mark.parametrize("grid", [False, True])
def test_edges_below_a_tree_and_out_of_parts(monkeypatch, grid):
    monkeypatch.setattr(pairs, "TILE", 16)
    rng, n = np.random.default_rng(1), 120
    x = rng.normal(size=(n, 3))
    x = np.round(x * 2, 0) if grid else x
    core, w = reach(x)
    every = [(i, j, w[i, j]) for i in range(n) for j in range(i + 1, n)]
    lightest = lambda e: density._kruskal(pd.DataFrame(sorted(set(e)), columns=["a", "b", "w"]))
    tree = lightest([every[i] for i in rng.choice(len(every), 500, replace=False)] + [(i, i + 1, w[i, i + 1]) for i in range(n - 1)])
    order, gaps = order_of(tree, n)
    at = {v: p for p, v in enumerate(order)}
    want = set()
    for i, j, v in every:
        path = gaps[min(at[i], at[j]) : max(at[i], at[j])]
        if (v, i, j) < tuple(path[np.argmax(path[:, 0])][1:]):
            want.add((i, j, v))
    cuts = [slice(0, 40), slice(40, 61), slice(61, n)]
    block = [rows(order[c], x[order[c]], core=core[order[c]], **{g: gaps[c, k] for k, g in enumerate(pairs.GAP)}) for c in cuts]
    tops = np.stack([pairs._highest(gaps[c].T) for c in cuts]).T
    got = [e for lo in range(3) for hi in range(lo, 3) for e in pairs._below(block[lo], None if lo == hi else block[hi], tops[:, lo + 1 : hi], "euclidean", lambda g: g).itertuples(index=False, name=None)]
    assert len(got) == len(set(got)) and set(got) == want
    assert set(lightest(list(tree[["a", "b", "w"]].itertuples(index=False, name=None)) + got)["w"].tolist()) == set(lightest(every)["w"].tolist())
    part = rng.integers(-1, 4, n)
    some = np.nonzero(part >= 0)[0]
    found = pairs._leaving(rows(some, x[some], core=core[some], part=part[some]), rows(range(n), x, core=core, part=part), "euclidean").set_index("part")
    for p in range(4):
        best = min((w[i, j], min(i, j), max(i, j)) for i in some[part[some] == p] for j in np.nonzero(part != p)[0])
        assert tuple(found.loc[p, ["w", "a", "b"]]) == best


def test_spanning_tree_of_clumps_apart(spark):
    """Nearest neighbours join no two clumps, and rows that are no numbers are at no distance; the tree is that of all pairs. Pairs of
    blocks keep no trees of their own, whose edges are as many as blocks times points."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.round(rng.normal(c * 9, 1, (30, 2)), 1) for c in range(4)])
    x[7], x[50, 1] = np.nan, np.inf
    x = x[rng.permutation(len(x))]
    core, w = reach(x)
    want = density._kruskal(pd.DataFrame([(i, j, w[i, j]) for i in range(len(x)) for j in range(i + 1, len(x))], columns=["a", "b", "w"]))
    points = spark.createDataFrame([("t", len(x), i, v.tolist()) for i, v in enumerate(x)], "tree string, n long, pos long, embedding array<double>").repartition(3)
    with Steps(spark) as steps:
        cored = steps.cut(density.core_distances(points, [3], block=16))
        assert {r.pos: r.cores[0] for r in cored.collect()} == pytest.approx(dict(enumerate(core)))
        got = density._searched(cored, steps, [""], "euclidean", 16, density.EDGES).toPandas()
    key = lambda e: sorted(zip(e.a, e.b, e.w, strict=True))
    assert key(got) == key(want)


def test_queries_of_their_own(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 4)), 1)
    items = spark.createDataFrame([(i * 2, v.tolist()) for i, v in enumerate(x)], "row_idx long, embedding array<double>")
    d = apart(x)
    for queries, of in ((None, range(90)), (items.filter("row_idx < 40"), range(20))):
        got = {(r.query_idx // 2, r.rank): (r.neighbor_idx // 2, r.distance) for r in knn.knn(items, 3, "euclidean", queries, block=20).collect()}
        assert got == {(i, k + 1): (j, v) for i in of for k, (v, j) in enumerate(sorted((d[i, j], j) for j in range(90) if j != i)[:3])}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_precision_of_tiles(metric):
    """Tiles are single where that tells distances apart, double where rows are far out or nearly equal; the neighbours are the same."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6))
    close = np.array([1, 2, 3, 4, 5, 6.0]) + np.round(rng.normal(size=x.shape) * 1e-3, 4)
    far = x + 1e5 if metric == "euclidean" else close
    for v, single in ((x, True), (far, False)):
        a, b = rows(np.arange(350), v[:350]), rows(np.arange(350, 700), v[350:])
        assert (pairs.Product(a.x, b.x, metric).left.dtype == np.float32) is single
        got = pairs.nearest(a, b, 3, metric)[0]
        d = pairs.Product(v[:350], v[350:], metric).exact(*np.divmod(np.arange(350 * 350), 350)).reshape(350, 350)
        order = np.argsort(d, axis=1, kind="stable")[:, :3]
        assert (got.ids == order + 350).all() and (got.d == np.take_along_axis(d, order, 1)).all()
    copies = np.repeat(x[:100], 7, 0)[:600]
    same = pairs.Product(copies, copies, metric)
    assert same.left.dtype == np.float64  # copies: the distances of a sample are 0


def test_few_candidates_of_a_mask():
    rng = np.random.default_rng(6)
    for shape in ((16, 24), (5, 7), (1, 8), (3, 16)):
        mask = rng.random(shape) < 0.05
        mask.flat[-1] = True
        for m in (mask, np.asfortranarray(mask)):
            assert [p.tolist() for p in pairs.places(m)] == [p.tolist() for p in np.nonzero(m)]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_only_neighbours_leave_a_search(spark, metric):
    """However many blocks a row is searched in, as many rows leave the search as it has neighbours."""
    x = np.random.default_rng(5).normal(size=(300, 4)).astype(np.float32)
    points = spark.createDataFrame([(t, 300, i, [float(c) for c in v]) for t in "ab" for i, v in enumerate(x)], "tree string, n long, pos long, embedding array<float>")
    d = apart(x.astype(float), metric)
    want = {(t, i, j, d[i, j]) for t in "ab" for i in range(300) for _, j in sorted((d[i, j], j) for j in range(300) if j != i)[:7]}
    found = pairs.near_pairs(points, 7, metric, 32).collect()
    assert len(found) == len(want) == 2 * 300 * 7
    assert {(r.tree, r.pos, r.near) for r in found} == {w[:3] for w in want}
    some = pairs.near_across(points.filter("pos % 50 = 0 AND tree = 'b'"), points, 7, metric, 32).collect()
    assert len(some) == 6 * 7
    assert {(r.tree, r.pos, r.near) for r in some} == {w[:3] for w in want if w[0] == "b" and w[1] % 50 == 0}


@pytest.mark.parametrize("metric, samples", [("euclidean", 5), ("euclidean", 20), ("cosine", 5)])
def test_copies_meet_without_rounds(spark, monkeypatch, metric, samples):
    """Rows with more copies than neighbours are joined through their first ones; the lightest tree results, ties too."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(12, 3)), 14, axis=0)
    x[-3:] = rng.normal(size=(3, 3))
    x = x[rng.permutation(len(x))]
    points = spark.createDataFrame([("t", len(x), i, [float(c) for c in v]) for i, v in enumerate(x)], "tree string, n long, pos long, embedding array<double>")

    def none(*_):
        raise AssertionError("a round over all pairs")

    monkeypatch.setattr(pairs, "leaving_edges", none)
    with Steps(spark) as steps:
        cored = steps.cut(density.core_distances(points, [samples], metric, 32))
        got = density._searched(cored, steps, [""], metric, 32, density.EDGES).toPandas()
    core, w = reach(x, samples) if metric == "euclidean" else (None, None)
    if metric == "cosine":
        d = apart(x, metric)
        core = np.sort(np.where(np.eye(len(x), dtype=bool), np.inf, d), axis=1)[:, samples - 1]
        w = np.maximum(d, np.maximum(core[:, None], core[None]))
    a, b, best = density._lightest(w)
    assert sorted(zip(got.a, got.b, strict=True)) == sorted(zip(a, b, strict=True))
    assert sorted(got.w) == pytest.approx(sorted(best), abs=1e-9)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("away, odd", [(0, False), (1e6, False), (0, True)])
def test_measured(monkeypatch, metric, away, odd):
    """Distances by a product are those by differences, far from the origin, between copies and of rows that are no numbers too."""
    monkeypatch.setattr(pairs, "TILE", 16)
    x = np.random.default_rng(2).normal(size=(90, 5)) + away
    x[7], x[50] = x[3], x[3] + 1e-7
    if odd:
        x[3], x[5, 2] = np.nan, np.inf
    with np.errstate(all="ignore"):
        want = density.distances(x, x, metric, None)
    got, cross = np.full((90, 90), -1.0), np.full((60, 30), -1.0)
    for i, j, d in pairs.measured(rows(range(90), x), None, metric):
        got[i, j] = d
    for i, j, d in pairs.measured(rows(range(60), x[:60]), rows(range(30), x[60:]), metric):
        cross[i, j] = d
    assert got == pytest.approx(want, rel=1e-7, abs=1e-12) and cross == pytest.approx(want[:60, 60:], rel=1e-7, abs=1e-12)
    for k in (1, 3, 64):
        with np.errstate(all="ignore"):
            power = np.where(want > 0, want ** -float(k), 0.0)
            assert pairs.inverse_powers(want, k) == pytest.approx(power, rel=1e-12)
