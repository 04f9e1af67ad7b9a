"""Hulls of solids with known measures, against brute force, and the samples taken of large sets."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import hulls, metadata

CUBE = np.array(list(itertools.product((0.0, 1.0), repeat=3)))


def flat_area(q):
    """Area of the hull of points in two dimensions, by a sweep along both sides."""
    q = sorted(map(tuple, q))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    ring = []
    for half in (q, q[::-1]):
        side = []
        for x in half:
            while len(side) > 1 and turn(side[-2], side[-1], x) <= 0:
                side.pop()
            side.append(x)
        ring += side[:-1]
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def brute_measures(p):
    """Volume and area from all triples whose plane has every point on one side."""
    faces = {}
    for i, j, k in itertools.combinations(range(len(p)), 3):
        n = np.cross(p[j] - p[i], p[k] - p[i])
        if np.linalg.norm(n) < 1e-12:
            continue
        n = n / np.linalg.norm(n)
        h = (p - p[i]) @ n
        if (h <= 1e-9).all() or (h >= -1e-9).all():
            n = n if (h <= 1e-9).all() else -n
            u = (p[j] - p[i]) / np.linalg.norm(p[j] - p[i])
            faces[tuple(np.round([*n, n @ p[i]], 6) + 0.0)] = n, np.nonzero(np.abs(h) <= 1e-9)[0], u
    volume = area = 0.0
    centre = p.mean(0)
    for n, at, u in faces.values():
        s = flat_area(np.c_[p[at] @ u, p[at] @ np.cross(n, u)])
        area += s
        volume += s * (n @ (p[at[0]] - centre)) / 3
    return volume, area


def test_hulls_equal_brute_force():
    rng = np.random.default_rng(0)
    for n in (4, 5, 8, 20, 30):
        for p in (rng.normal(size=(n, 3)), np.round(rng.uniform(-2, 2, (n, 3)))):
            try:
                got = hulls.measures(*hulls.quickhull(p))
            except hulls.Flat:
                assert np.linalg.matrix_rank(p - p[0]) < 3 or len(np.unique(p, axis=0)) < 4
                continue
            assert got == pytest.approx(brute_measures(np.unique(p, axis=0)))


def frame(spark, items):
    return spark.createDataFrame([(k, *map(float, v)) for k, p in items.items() for v in p], "item string, x double, y double, z double").repartition(5)


@pytest.mark.parametrize("part", [20_000, 40])
def test_planted_solids(spark, part):
    rng = np.random.default_rng(1)
    ball = rng.normal(size=(3000, 3))
    ball = ball / np.linalg.norm(ball, axis=1, keepdims=True)
    filled = np.concatenate([CUBE * 3 - 1, rng.uniform(-1, 2, (500, 3))])
    octa = np.concatenate([np.eye(3), -np.eye(3), rng.uniform(-0.2, 0.2, (100, 3))])
    items = {"cube": CUBE, "filled": filled, "ball": ball, "octahedron": octa, "square": CUBE[:4], "line": np.outer(np.arange(9), [1, 2, 3]), "dot": np.ones((5, 3)), "odd": np.concatenate([CUBE, [[np.nan, 0, 0]]]), "flat": np.c_[rng.uniform(size=(200, 2)), np.zeros(200)]}
    got = {r.item: r for r in hulls.convex_hulls(frame(spark, items), "item", part).collect()}
    assert set(got) == set(items)
    for k, v, a, n in (("cube", 1, 6, 8), ("filled", 27, 54, 8), ("octahedron", 4 / 3, 4 * 3**0.5, 6)):
        assert (got[k].convex_hull_volume, got[k].convex_hull_area, got[k].n_corners, got[k].hull_failed) == (pytest.approx(v), pytest.approx(a), n, 0)
    assert 0.99 < got["ball"].convex_hull_volume / (4 / 3 * np.pi) < 1 and 0.99 < got["ball"].convex_hull_area / (4 * np.pi) < 1
    for k in ("square", "line", "dot", "odd", "flat"):
        assert got[k].hull_failed == 1 and got[k].convex_hull_volume is None
    # What the hull says feeds the sizes.
    sized = hulls.convex_hulls(frame(spark, {"cube": CUBE}), "item").withColumns({"mesh_volume": F.lit(None).cast("double"), "bbox_volume": F.lit(0.0), "is_watertight": F.lit(0)})
    assert sized.select(metadata.size_volume("auto").alias("v")).first().v == pytest.approx(1.0)


def test_too_many_corners_fail(spark):
    assert [r.hull_failed for r in hulls.convex_hulls(frame(spark, {"cube": CUBE}), "item", 4, 7).collect()] == [1]
    assert hulls.convex_hulls(frame(spark, {"cube": CUBE}).limit(0), "item").count() == 0


def test_samples(spark):
    rng = np.random.default_rng(2)
    items = {"large": rng.uniform(0, 1, (3000, 3)), "small": CUBE}
    p = frame(spark, items)
    for how in ("random", "voxel"):
        one, two = ({tuple(r) for r in hulls.hull_sample(x, "item", 100, how).collect()} for x in (p, p.repartition(2)))
        assert sum(r[0] == "small" for r in one) == 8 and 60 <= sum(r[0] == "large" for r in one) <= 100
        assert {r[0] for r in one} == {"large", "small"}
        assert sorted((k, *np.round(v, 9)) for k, *v in one) == sorted((k, *np.round(v, 9)) for k, *v in two)
    assert {tuple(r) for r in hulls.hull_sample(p, "item", 100, "random").collect()} <= {tuple(r) for r in p.collect()}
    # Cubes of the mean keep to the shape: the sample's hull has most of the volume.
    v = hulls.convex_hulls(hulls.hull_sample(p, "item", 500), "item").filter("item = 'large'").first().convex_hull_volume
    assert 0.6 < v < 1
    with pytest.raises(ValueError):
        hulls.hull_sample(p, "item", 5, "none")
