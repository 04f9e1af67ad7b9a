"""Camera distances against plain loops, and tables of many files."""

import math

import numpy as np
import pytest

from cairn.operators import camera, metadata, retrieval_metrics
from cairn.sources import files

UP = (0.0, 1.0, 0.0)


def brute_fill(p, d, r, fov=60.0, w=224, h=224):
    d = d / np.linalg.norm(d)
    right = np.cross(UP, d)
    right = right / np.linalg.norm(right)
    above, half = np.cross(d, right), math.tan(math.radians(fov) / 2)
    depth = r - p @ d
    if (depth <= 1e-9).any():
        return 1.0, True
    x, y = np.floor((p @ right / (depth * half) * (h / w) + 1) / 2 * w), np.floor((1 - p @ above / (depth * half)) / 2 * h)
    side = lambda c, n: max(0, min(c.max(), n - 1) - max(c.min(), 0) + 1)
    return side(x, w) * side(y, h) / (w * h), bool(x.min() <= 0 or y.min() <= 0 or x.max() >= w - 1 or y.max() >= h - 1)


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(0)
    return {"ball": rng.normal(0, 0.2, (60, 3)), "rod": rng.normal(0, 1, (50, 3)) * [0.02, 0.9, 0.02], "dot": np.full((3, 3), 1e-4), "huge": rng.normal(0, 9, (40, 3))}


@pytest.fixture(scope="module")
def points(spark, clouds):
    return spark.createDataFrame([(k, *map(float, v)) for k, p in clouds.items() for v in p], "item string, x double, y double, z double").repartition(4)


@pytest.fixture(scope="module")
def dirs(spark):
    return metadata.fibonacci_sphere(spark, 6)


def directions(dirs):
    return np.array([(r.x, r.y, r.z) for r in dirs.orderBy("i").collect()])


def test_fills(spark, points, clouds, dirs):
    radius = camera.safe_radius(points, "item")
    far = {r.item: r.radius for r in radius.collect()}
    assert far == {k: pytest.approx(max(0.25, 1.05 * np.linalg.norm(p, axis=1).max())) for k, p in clouds.items()}
    got = {(r.item, r.view): (r.fill_ratio, r.touches_border) for r in camera.fills(points, "item", radius, dirs, 50.0, 320, 200).collect()}
    for k, p in clouds.items():
        for i, d in enumerate(directions(dirs)):
            assert got[k, i] == brute_fill(p, d, far[k], 50.0, 320, 200)


def test_a_view_along_up_and_a_point_behind(spark):
    one = spark.createDataFrame([("a", 0.1, 0.0, 0.1), ("b", 0.0, 3.0, 0.0)], "item string, x double, y double, z double")
    eye = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "item string, radius double")
    top = spark.createDataFrame([(0, 0.0, 1.0, 0.0)], "i int, x double, y double, z double")
    got = {r.item: r for r in camera.fills(one, "item", eye, top).collect()}
    assert 0 < got["a"].fill_ratio < 1e-3 and not got["a"].touches_border and got["b"].fill_ratio == 1.0 and got["b"].touches_border


def test_fill_falls_with_distance(spark, points, dirs):
    last = None
    for r in (0.5, 1.0, 2.0, 4.0, 8.0):
        eye = points.select("item").distinct().selectExpr("item", f"{r}D AS radius")
        now = {x.item: x.f for x in camera.fills(points, "item", eye, dirs).groupBy("item").agg({"fill_ratio": "max"}).toDF("item", "f").collect()}
        assert last is None or all(now[k] <= last[k] + 1e-12 for k in now)
        last = now


def brute_tune(p, ds, low, high, r=2.0, lo=0.25, hi=8.0, rounds=12):
    def span(r):
        f = [brute_fill(p, d, r)[0] for d in ds]
        return min(f), max(f)

    a, b = span(r)
    miss = lambda a, b: max(0, b - high) + max(0, low - a)
    best = (miss(a, b), r, a, b)
    if low <= a and b <= high:
        return r, a, b, 0
    for i in range(1, rounds + 1):
        lo, hi = (r, hi) if b > high else (lo, r)
        r = (lo + hi) / 2
        a, b = span(r)
        if miss(a, b) < best[0]:
            best = (miss(a, b), r, a, b)
        if low <= a and b <= high:
            return r, a, b, i
    return *best[1:], rounds


@pytest.mark.parametrize("target", [(0.2, 0.7), (0.4, 0.45)])
def test_autotune(points, clouds, dirs, target):
    got = {r.item: (r.radius, r.fill_min, r.fill_max, r.iterations) for r in camera.autotune(points, "item", dirs, target).collect()}
    assert got == {k: brute_tune(p, directions(dirs), *target) for k, p in clouds.items()}


def test_kept_inside(spark, points, clouds, dirs):
    start = points.select("item").distinct().selectExpr("item", "0.6D AS radius")
    got = {r.item: r for r in camera.kept_inside(points, "item", start, dirs, 0.3, 5, 2.5).collect()}
    for k, p in clouds.items():
        r, n = 0.6, 0
        touching = lambda r: sum(brute_fill(p, d, r)[1] for d in directions(dirs))
        while touching(r) and n < 5 and r < 2.5:
            r, n = min(r * 1.3, 2.5), n + 1
        assert (got[k].radius, got[k].steps, got[k].touching) == (pytest.approx(r), n, touching(r))


def test_small_rules(spark):
    zoom = spark.createDataFrame([("a", "loose", 2.0), ("a", "up", 2.0 + 1e-6), ("b", "loose", 2.0), ("b", "up", 2.1), ("c", "up", 1.0)], "specimen string, scale string, final_radius double")
    assert {r.specimen: r.equal for r in camera.equal_radii(zoom).collect()} == {"a": True, "b": False}
    odd = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", float("nan"), 0.0, 0.0), ("c", float("inf"), 0.0, 0.0), ("d", None, 0.0, 0.0)], "item string, x double, y double, z double")
    assert {r.radius for r in camera.safe_radius(odd, "item").collect()} == {0.25}
    v = odd.select("item", camera.light_direction(odd.x + 0.0, odd.y + 3.0, odd.z + 4.0).alias("v")).filter("item = 'a'").first().v
    assert v == pytest.approx([0.0, -0.6, -0.8])
    assert odd.filter("item = 'a'").select(camera.light_direction(odd.x, odd.y, odd.z).alias("v")).first().v is None


def put(root, **texts):
    for name, text in texts.items():
        path = root / name.replace("__", "/").replace("_csv", ".csv")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_scans_of_mixed_files(spark, tmp_path):
    root = put(tmp_path / "k", knn_1_csv="query_id,neighbor_id,rank\na/1,a/2,1\na/1,b/1,2\n", sub__knn_2_csv="distance,neighbor_id,query_id\n0.5,b/9,b/1\n", knn_3_csv="query_id,neighbor_id\n", knn_4_csv="id\nx\n", knn_5_csv="query_id,neighbor_id\nonly\n", knn_6_csv="", other_csv="query_id\nz\n")
    good, bad = files.scan_tables(spark, root, needed=("query_id", "neighbor_id"))
    assert {(r.query_id, r.neighbor_id, r.rank, r.distance, r._row) for r in good.collect()} == {("a/1", "a/2", "1", None, 0), ("a/1", "b/1", "2", None, 1), ("b/1", "b/9", None, "0.5", 0)}
    assert {r._file.rsplit("/", 1)[1]: r.error.split(":")[0] for r in bad.collect()} == {"knn_4.csv": "ValueError", "knn_5.csv": "ValueError"}
    with pytest.raises(ValueError, match="knn_4"):
        files.read_neighbors(spark, root, needed=("query_id", "neighbor_id"))
    rates, errors = files.match_rates(spark, root)
    assert [tuple(r) for r in rates.collect()] == [("a/1", "a", 2, 1, 0.5)] and errors.count() == 2


def test_merged_file_comes_first(spark, tmp_path):
    root = put(tmp_path / "m", knn_1_csv="query,neighbor\na,b\na,c\n", sub__knn_2_csv="query,neighbor\nb,a\n")
    got = files.read_neighbors(spark, root)
    assert got.count() == 3
    # Without a rank, a score or a distance, rows rank as they stand in their files.
    assert {(r.query_id, r.neighbor_id, r["rank"]) for r in retrieval_metrics.ranked(got.repartition(5)).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "a", 1)}
    put(tmp_path / "m", merged_knn_csv="query,neighbor\nz,y\n")
    assert [(r["query"], r.neighbor) for r in files.read_neighbors(spark, root).collect()] == [("z", "y")]
    with pytest.raises(ValueError, match="no rows"):
        files.read_neighbors(spark, put(tmp_path / "e", knn_1_csv="query,neighbor\n"))


def test_labels_for(spark, tmp_path):
    ids = spark.createDataFrame([(0, "a/1"), (1, "b/1"), (2, "a/2")], "row_idx long, id string")
    got = lambda text: [r.label for r in files.labels_for(ids, spark, None if text is None else put(tmp_path / str(abs(hash(text))), l_csv=text) + "/l.csv").orderBy("row_idx").collect()]
    assert got("a/1,x\na/1,y,more\nb/1\n") == ["y", "", ""]  # the last of repeated ids
    assert got("q,x\n") == ["a", "b", "a"]  # no id is known
    assert got("one\n\n two \nthree\n") == ["one", "two", "three"]
    assert got("one\ntwo\n") == got("\n") == got(None) == ["a", "b", "a"]
    plain = spark.createDataFrame([(0, "a/1"), (1, "b")], "row_idx long, id string")
    assert [r.label for r in files.labels_for(plain, spark, str(tmp_path / "absent")).collect()] == [None, None]


def test_resolution(spark, tmp_path):
    root = put(tmp_path / "r", clusters_csv="x\n", b__clusters_csv="x\n", other_csv="x\n")
    assert files.resolve_file(spark, f"{root}/other.csv", ["clusters.csv"]) == f"{root}/other.csv"  # a file is taken as it is
    with pytest.warns(UserWarning, match="2 files"):
        assert files.resolve_file(spark, root, ["clusters.csv"]).endswith("/r/clusters.csv")
    with pytest.warns(UserWarning, match="oth"):
        assert files.resolve_file(spark, root, ["none.csv"], ("oth*.csv",)).endswith("/r/other.csv")
    with pytest.raises(FileNotFoundError, match="does not exist"):
        files.resolve_file(spark, f"{root}/absent", ["a"])


def test_candidate_ratio_of_few_items(spark):
    c = spark.createDataFrame([(0, 2), (1, 2), (2, 2)], "query_idx long, n long")
    assert [tuple(retrieval_metrics.candidate_ratio(x).first()) for x in (c, c.limit(0))] == [(3, 6, 1.0), (0, 0, 1.0)]
