"""Worked examples of single rules."""

import brute_trees
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import identity, vectors
from cairn.operators import cluster_metrics, explain, hdbscan, metadata, retrieval_metrics, routing
from cairn.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("path, item", [("a/b_view03.png", "a/b"), ("x_view_y_view1.png", "x_view_y"), ("s_loose_view00.png", "s_loose"), ("plain.png", "plain")])
def test_render_id(spark, path, item):
    assert one(spark, identity.render_id(F.lit(path))) == item


def test_normalize(spark):
    assert one(spark, vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


@pytest.mark.parametrize("token, near", [("vol_q2__elong_low", ["vol_q2__elong_high", "vol_q1__elong_low", "vol_q3__elong_low"]), ("vol_q1", ["vol_q0", "vol_q2"]), ("-1", [])])
def test_adjacent(spark, token, near):
    assert one(spark, identity.adjacent_groups(F.lit(token))) == near


def test_group_token_without_axis(spark):
    assert tuple(one(spark, identity.group_token(F.lit("vol_q3__none")))) == (3, None, None)


def test_quantile_bins(spark):
    for xs, want in (([float(i) for i in range(10)], [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]), ([1.0, 1.0, 1.0, 1.0, 2.0], [0, 0, 0, 0, 1])):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
        got = df.crossJoin(metadata.quantile_edges(df, "x", 5)).select("i", metadata.quantile_bin(F.col("x"), F.col("edges")).alias("b")).orderBy("i").collect()
        assert [r.b for r in got] == want


def test_soft_routing(spark):
    groups = ["vol_q1", "vol_q1", "vol_q2", "vol_q0", None, "vol_q5"]
    items = spark.createDataFrame(list(enumerate(groups)), "row_idx long, pregroup_id string")
    for known, want in ((True, [1, 3, 2, 5]), (False, [1, 3, 2, 4])):
        got = routing.candidates(items, pool_k=2, known_first=known).filter("query_idx = 0").orderBy("tier", "candidate_idx").collect()
        assert [r.candidate_idx for r in got] == want


def test_strict_routing_falls_back_to_all(spark):
    items = spark.createDataFrame([(0, "vol_q1"), (1, "vol_q2"), (2, "vol_q2")], "row_idx long, pregroup_id string")
    got = routing.candidates(items, mode="strict").groupBy("query_idx").count().collect()
    assert {r.query_idx: r["count"] for r in got} == {0: 2, 1: 1, 2: 1}


@pytest.mark.parametrize("mode", ["strict", "soft", "off"])
def test_candidates_by_small_blocks_equal_all_pairs(spark, mode):
    groups = ["vol_q1"] * 9 + ["vol_q2", None, "vol_q5", None] + ["vol_q3"] * 4
    items = spark.createDataFrame(list(enumerate(groups)), "row_idx long, pregroup_id string")
    for known in (True, False):
        want = []
        for q, g in enumerate(groups):
            near = [f"vol_q{int(g[-1]) + k}" for k in (-1, 1)] if g else []
            far = lambda x: near.index(x) + 1 if x in near else 4 if x or not known else 5
            rows = sorted((0 if mode == "off" or g is None or x == g else far(x), c) for c, x in enumerate(groups) if c != q)
            own = [r for r in rows if r[0] == 0]
            kept = {"off": rows, "strict": own or rows, "soft": own if len(own) >= 6 else rows[:6]}[mode]
            want += [(q, c, tier) for tier, c in kept]
        got = routing.candidates(items, mode, pool_k=3, known_first=known, block=2)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("named", [4500, 0])
def test_one_group_is_dealt_over_tasks(spark, named):
    n = 4500
    items = spark.range(n).select(F.col("id").alias("row_idx"), F.when(F.col("id") < named, "vol_q1").alias("pregroup_id"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as for tables over it
    try:
        by_task = [r["count"] for r in routing.candidates(items, mode="strict").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(key, was)
    assert sum(by_task) == n * (n - 1)
    assert max(by_task) < sum(by_task) / 2


@pytest.mark.parametrize("mode, named", [("strict", 2200), ("soft", 2200), ("soft", 0)])
def test_lists_are_small_files(spark, tmp_path, mode, named):
    """Candidates follow each other in short cycles, which column files pack into a fifth of a byte a row; in long ones it was about one."""
    n = 2200
    items = spark.range(n).select(F.col("id").alias("row_idx"), F.when(F.col("id") < named, "vol_q1").alias("pregroup_id"))
    routing.candidates(items, mode=mode).write.parquet(str(tmp_path / "lists"))
    got = spark.read.parquet(str(tmp_path / "lists"))
    assert got.count() == got.distinct().count() == n * (n - 1)
    assert sum(f.stat().st_size for f in (tmp_path / "lists").glob("*.parquet")) < 0.3 * n * n


def test_agreement_with_and_without_noise(spark):
    c = spark.createDataFrame([("1", 0), ("2", 0), ("3", 1), ("4", -1)], "id string, cluster_id int")
    y = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", "b")], "id string, label string")
    t = cluster_metrics.contingency(c, y)
    assert round(cluster_metrics.agreement(t).first().ari, 6) == 0.571429
    assert cluster_metrics.purity(t).first().purity == 1.0
    assert cluster_metrics.agreement(cluster_metrics.contingency(c, y, "exclude")).first().ari == 1.0
    assert cluster_metrics.adjusted_mutual_information(cluster_metrics.contingency(c, y, "exclude")).first().ami == pytest.approx(1.0)


def test_size_distances(spark):
    q, c = F.lit(1.0), F.lit(2.0)
    got = [one(spark, routing.size_distance(q, c, m)) for m in ("plain", "ratio_penalty", "margin_gate")]
    assert [round(x, 6) for x in got] == [1, 2.302585, 2.352585]
    assert one(spark, routing.size_distance(F.lit(None).cast("double"), c)) == 0.0
    df = spark.createDataFrame([(0, x) for x in (0.0, 0.0, 0.0, 10.0)], "query_idx int, s double")
    assert sorted(r.v for r in df.select(routing.normalized("s", "robust").alias("v")).collect()) == [0, 0, 0, 4]


def test_match_rates(spark):
    knn = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "qid string, nid string, position int")
    y = spark.createDataFrame([("q", "x"), ("a", "x"), ("b", "x"), ("c", "y")], "id string, label string")
    rows = retrieval_metrics.matched(retrieval_metrics.ranked(knn), y)
    assert retrieval_metrics.rate_at_k(rows, [5]).first().rate == 0.4
    assert round(retrieval_metrics.rate_of_rows(rows).first().rate, 6) == 0.666667
    none = spark.createDataFrame([], "id string, label string")
    assert retrieval_metrics.matched(retrieval_metrics.ranked(knn), none, "equal").filter("match = 1").count() == 3
    assert retrieval_metrics.matched(retrieval_metrics.ranked(knn), none).count() == 0


def planted():
    rng = np.random.default_rng(0)
    centers = np.eye(8)[:3] * 3
    return np.concatenate([*(c + rng.normal(0, 0.05, (40, 8)) for c in centers), rng.uniform(-6, 6, (10, 8))])


@pytest.mark.parametrize("selection", ["eom", "leaf"])
def test_hdbscan_finds_planted_clusters(selection):
    labels, prob = brute_trees.fit(planted(), 10, 5, selection=selection)
    if selection == "eom":
        assert [set(labels[i : i + 40]) for i in (0, 40, 80)] == [{0}, {1}, {2}]
        assert (labels[120:] == -1).sum() >= 8
    assert ((labels == -1) == (prob == 0)).all()


def test_spanning_tree_is_lightest():
    x = planted()[::5]
    core = brute_trees.core_distances(x, 3, "euclidean")
    got = brute_trees.spanning_tree(x, core, "euclidean")[:, 2].sum()
    top = list(range(len(x)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    total = 0.0
    for w, i, j in sorted((max(np.linalg.norm(x[i] - x[j]), core[i], core[j]), i, j) for i in range(len(x)) for j in range(i)):
        if find(i) != find(j):
            top[find(i)] = find(j)
            total += w
    assert got == pytest.approx(total, abs=1e-4)


def test_recursive_and_grouped(spark):
    x = planted()
    items = spark.createDataFrame([(i, f"i{i}", v.tolist(), f"g{i % 2}" if i else None) for i, v in enumerate(x)], "row_idx long, id string, embedding array<double>, pregroup_id string")
    out, report = hdbscan.recursive(items, hdbscan.Config(10, 5), hdbscan.Config(5, 3, selection="leaf"))
    assert out.count() == len(x)
    g = hdbscan.grouped(items, hdbscan.Config(5, 3)).toPandas()
    assert len(g) == len(x) and g[g.pregroup_id == "-1"].skipped.all()


def test_rollout_of_uniform_attention():
    a = [np.full((2, 5, 5), 0.2)] * 2
    assert np.allclose(explain.rollout(a), explain.rollout(a)[0])


def test_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.off").write_text("OFF4 1 0\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n3 0 1 2\n")
    (tmp_path / "m/bad.obj").write_text("nothing\n")
    points, triangles, errors = files.read_meshes(spark, str(tmp_path / "m"))
    assert points.count() == 4 and errors.count() == 1
    assert metadata.mesh_measures(triangles, "specimen_id").first().surface_area == 0.5
    (tmp_path / "f").mkdir()
    np.save(tmp_path / "f/s.npy", np.arange(12.0).reshape(2, 3, 2))
    np.save(tmp_path / "f/t.npy", np.arange(3.0))
    good, bad = files.read_arrays(spark, str(tmp_path / "f"))
    assert good.count() == 6 and bad.count() == 1
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert [tuple(r) for r in files.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "l.txt").write_text("a  big cat\nb\n")
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path / "l.txt"), lenient=True).collect()] == [("a", "big cat")]
    with pytest.raises(Exception, match="a label is missing"):
        files.read_labels(spark, str(tmp_path / "l.txt")).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_fusion_mode_spellings(spark):
    given = ["Shape-Size", "shape size texture", "ShapeOnly", "shape_texture", "shape+size", "other-mode", None]
    want = ["shape+size", "shape+size+texture", "shape_only", "shape+texture", "shape+size", "other_mode", None]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(given)], "i int, m string")
    assert [r.m for r in rows.select("i", identity.fusion_mode(F.col("m")).alias("m")).orderBy("i").collect()] == want


def test_log_features_are_filled_then_logged_then_scaled(spark):
    rows = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 10)], "x double")
    got = sorted(r.x for r in metadata.robust_scaled(rows, ["x"], ("x",)).collect())
    assert [round(v, 3) for v in got] == [-1.585, -0.585, 0.0, 0.415, 1.874]
    odd = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    # 1, 2, 3 and three times their median 2: the quartile range is 0, so nothing is divided.
    assert sorted(r.x for r in metadata.robust_scaled(odd, ["x"]).collect()) == [-1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


@pytest.mark.parametrize("how, want", [("zscore", [1.0, 2.0, 3.0]), ("minmax", [0.0, 0.5, 1.0]), ("robust", [1.0, 2.0, 3.0])])
def test_sizes_that_are_not_finite_take_no_part_in_the_scale(spark, how, want):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, float("nan")), (1, float("inf")), (1, None)], "query_idx int, s double")
    scale = (2 / 3) ** 0.5 if how == "zscore" else 1.0
    got = [r.v for r in rows.select("s", routing.normalized("s", how).alias("v")).collect()]
    assert sorted(round(v, 6) for v in got) == sorted([0.0] * 3 + [round(v / scale, 6) for v in want])


def test_coarse_metrics_average_only_members(spark):
    c = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 1.0), (-1, 0.0)], "cluster_id int, prob double")
    r = cluster_metrics.coarse_metrics(c, 3, "eom").first()
    assert r.prob == 1.0 and r.k == 2 and r.second == 0.5 and r.small_cluster_count == 2 and r.reject_reason == "noise_ratio>0.10" and r.score == float("-inf")
    r = cluster_metrics.coarse_metrics(c.limit(0), 3, "eom").first()
    assert r.k == 0 and r.noise == 1.0 and r.prob == 0.0 and r.invalid


def test_lists():
    assert identity.parse_list("10, 1,,5,1", int, positive=True) == [1, 5, 10]
    assert identity.parse_list("0.5,0.1", float) == [0.5, 0.1]
    for text, how in (("", {}), ("0,1", {"kind": int, "positive": True}), ("a,b", {"allowed": ("a",)})):
        with pytest.raises(ValueError):
            identity.parse_list(text, **how)


def test_in_order(spark):
    ids = spark.createDataFrame([(0, "b"), (1, "c"), (2, "a")], "row_idx long, id string")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert [(r.id, r.v) for r in identity.in_order(ids, rows).orderBy("row_idx").collect()] == [("b", 2), ("c", None), ("a", 1)]


def test_sinks_and_resolution(spark, tmp_path):
    empty = spark.createDataFrame([], "id string, n int")
    for kind in ("csv", "parquet"):
        files.write_table(empty, f"{tmp_path}/empty_{kind}", kind)
    assert spark.read.csv(f"{tmp_path}/empty_csv", header=True).columns == ["id", "n"]
    assert spark.read.parquet(f"{tmp_path}/empty_parquet").columns == ["id", "n"]
    for name in ("in/deep/er/clusters.csv", "in/b/clusters.csv", "in/c/clusters.csv", "in/other.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("label,mean\na,1.5\n")
    root = str(tmp_path / "in")
    assert files.resolve_file(spark, root, ["clusters.csv"]).endswith("/in/b/clusters.csv")
    assert files.resolve_file(spark, root, ["none*.csv"], ("oth?r.*",)).endswith("/in/other.txt")
    with pytest.raises(FileNotFoundError):
        files.resolve_file(spark, root, ["none"])
    assert files.read_rates(spark, f"{root}/b/clusters.csv", ("label", "mean")).first().mean == 1.5
    with pytest.raises(ValueError):
        files.read_rates(spark, f"{root}/b/clusters.csv", ("rate",))


def test_totals_of_odd_tables(spark):
    t = spark.createDataFrame([("a", "g"), ("a", "g"), (None, "g"), ("b", None)], "label string, pregroup_id string")
    assert tuple(retrieval_metrics.prefilter_totals(t).first()) == (4, 2, 0.75, 0.5)
    assert tuple(retrieval_metrics.prefilter_totals(t.limit(0)).first()) == (0, 0, 0.0, 0.0)
    assert tuple(retrieval_metrics.counts_by(t.withColumn("m", F.lit("x")), "m", "label").first()) == ("x", 4, 3)
    c = spark.createDataFrame([(10, 1.0), (30, 2.0), (5, None)], "n long, mean_distance double")
    assert cluster_metrics.weighted_distance(c).first().mean_distance == 1.75
    color = spark.createDataFrame([(True,), (False,), (None,)], "has_color boolean")
    assert [metadata.use_color(color, m).first().use_color for m in ("auto", "off", "force")] == [True, False, True]
    assert not metadata.use_color(color.limit(0)).first().use_color
