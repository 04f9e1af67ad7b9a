"""Fusion grids, drawings of trees, feature matrices, summaries and reports from files to files."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import dendrogram, fusion_grid, hdbscan, metadata, routing
from cairn.operators.steps import Steps
from cairn.plans import commands


def _random_merges(rng, n: int) -> list[tuple]:
    """(r, left, right, distance, size) of a random tree over n leaves."""
    heads, size, out = list(range(n)), {i: 1 for i in range(n)}, []
    for r in range(n - 1):
        a, b = (heads.pop(rng.integers(len(heads))) for _ in range(2))
        size[n + r] = size[a] + size[b]
        heads.append(n + r)
        out.append((r, a, b, float(r + 1), size[n + r]))
    return out


def _drawn(n: int, merges: list[tuple]) -> tuple[dict[int, int], dict[int, float]]:
    """Places of leaves and middles of nodes, by walking the tree."""
    sides, order, stack = {n + r: (a, b) for r, a, b, *_ in merges}, [], [2 * n - 2]
    while stack:
        at = stack.pop()
        if at < n:
            order.append(at)
        else:
            stack += [sides[at][1], sides[at][0]]
    middle = {leaf: 5.0 + 10 * i for i, leaf in enumerate(order)}
    for r, a, b, *_ in merges:
        middle[n + r] = (middle[a] + middle[b]) / 2
    return {leaf: i for i, leaf in enumerate(order)}, middle


@pytest.mark.parametrize("chain", [False, True])
def test_places_and_links_equal_a_walk(spark, chain):
    rng, rows, points, want = np.random.default_rng(5), [], [], {}
    for tree, n in (("a", 23), ("b", 2), ("c", 9)):
        merges = [(r, r + 1 if not r else n + r - 1, 0 if not r else r + 1, float(r + 1), r + 2) for r in range(n - 1)] if chain else _random_merges(rng, n)
        rows += [(tree, n, *m) for m in merges]
        points += [(tree, i, f"{tree}{i}") for i in range(n)]
        want[tree] = n, _drawn(n, merges)
    points.append(("alone", 0, "x"))
    m = spark.createDataFrame(rows, "tree string, n long, r long, left long, right long, distance double, size long")
    leaves, links = dendrogram.layout(m, spark.createDataFrame(points, "tree string, pos long, id string"), span=4)
    places = {r.id: r.place for r in leaves.collect()}
    assert places == {f"{t}{leaf}": i for t, (_, (p, _)) in want.items() for leaf, i in p.items()} | {"x": 0}
    got = {(r.tree, r.r): r for r in links.collect()}
    assert len(got) == len(rows)
    for tree, n, r, a, b, d, _ in rows:
        middle, row = want[tree][1][1], got[tree, r]
        assert (row.x1, row.x2, row.height) == (middle[a], middle[b], d)
        assert (row.y1, row.y2) == tuple(0.0 if x < n else float(x - n + 1) for x in (a, b))


def test_no_merges_draw_no_links(spark):
    m = spark.createDataFrame([], "tree string, n long, r long, left long, right long, distance double, size long")
    leaves, links = dendrogram.layout(m, spark.createDataFrame([("t", 0, "x")], "tree string, pos long, id string"))
    assert [tuple(r) for r in leaves.collect()] == [("t", "x", 0, 5.0)] and links.count() == 0


def test_colours_and_legend(spark):
    m = spark.createDataFrame([("t", 4, 0, 0, 1, 1.0, 2), ("t", 4, 1, 2, 3, 2.0, 2), ("t", 4, 2, 4, 5, 3.0, 4)], "tree string, n long, r long, left long, right long, distance double, size long")
    points = spark.createDataFrame([("t", i, c) for i, c in enumerate("abcd")], "tree string, pos long, id string")
    clusters = spark.createDataFrame([("a", 12), ("b", -1), ("c", 2)], "id string, cluster_id int")
    leaves, _ = dendrogram.layout(m, points, clusters)
    assert {r.id: r.color for r in leaves.collect()} == {"a": "#059669", "b": "#9CA3AF", "c": "#059669", "d": "#111827"}
    assert [r.name for r in dendrogram.legend(leaves).collect()] == ["cluster 2", "cluster 12", "cluster -1 (noise)", "cluster N/A"]


def _grid_brute(pairs, sizes, settings, k, rerank):
    """Lists by setting and query, by loops."""
    out = {}
    for q in {p[0] for p in pairs}:
        pool = sorted(((d, c) for a, c, d in pairs if a == q))[:rerank]
        out["baseline", "baseline", 0.0, q] = [c for _, c in pool[:k]]
        for f, mode, w in settings:
            name, raw = fusion_grid.ALIASES.get(f, f), []
            for _, c in pool:
                x, y = sizes[q].get(name), sizes[c].get(name)
                if x is None or y is None or not math.isfinite(x) or not math.isfinite(y):
                    raw.append(0.0)
                    continue
                a, b = (10**x, 10**y) if f in fusion_grid.LOGARITHMS else (abs(x), abs(y))
                r = abs(math.log(max(a, 1e-8)) - math.log(max(b, 1e-8)))
                gate = 0.05 if max(a, b) / max(min(a, b), 1e-8) > 1.5 else 0.0
                raw.append(abs(x - y) if mode == "plain_distance" else r + gate if mode == "margin_gate" else r)
            low, mid, high = np.percentile(raw, [25, 50, 75])
            scale = high - low if high - low > 1e-8 else mid if mid > 1e-8 else 1.0
            best = sorted((round(d + w * x / scale, 6), i, c) for i, ((d, c), x) in enumerate(zip(pool, raw, strict=True)))
            out[f, mode, w, q] = [c for *_, c in best[:k]]
    return out


def test_grid_equals_loops_over_its_settings(spark):
    rng = np.random.default_rng(3)
    n = 14
    pairs = [(a, b, round(float(rng.random()), 3)) for a in range(n) for b in range(n) if a != b]
    sizes = {i: {"bbox_longest": float(rng.integers(-4, 9)), "log_bbox_volume": float(rng.normal()), "log_bbox_longest": None if i == 3 else float(rng.normal())} for i in range(n)}
    sizes[5]["bbox_longest"], sizes[6]["log_bbox_volume"] = float("inf"), float("nan")
    settings = fusion_grid.grid(["bbox_longest", "log_bbox_volume", "apparent_size_proxy"], list(fusion_grid.MODES), [0.1, 0.5])
    table = spark.createDataFrame([(i, *(s[c] for c in ("bbox_longest", "log_bbox_volume", "log_bbox_longest"))) for i, s in sizes.items()], "row_idx long, bbox_longest double, log_bbox_volume double, log_bbox_longest double")
    got = fusion_grid.grid_ranked(spark.createDataFrame(pairs, "query_idx long, candidate_idx long, distance double"), table, settings, 4, 9)
    lists = {}
    for r in got.orderBy("rank_final").collect():
        lists.setdefault((r.size_feature, r.size_penalty_mode, r.lambda_size, r.query_idx), []).append(r.candidate_idx)
    assert lists == _grid_brute(pairs, sizes, settings, 4, 9)


def test_grid_refuses_what_it_does_not_know():
    for bad in ((["colour"], ["ratio_penalty"], [0.1]), (["bbox_longest"], ["soft"], [0.1]), (["bbox_longest"], ["ratio_penalty"], [])):
        with pytest.raises(ValueError):
            fusion_grid.grid(*bad)
    assert fusion_grid.grid(["bbox_longest"], ["margin_gate"], [0.1, 0.1]) == [("bbox_longest", "margin_gate", 0.1)]


def test_a_ratio_at_the_threshold_has_no_gate(spark):
    rows = spark.createDataFrame([(3.0, 2.0), (2.0, 3.0), (3.1, 2.0), (None, 2.0)], "q double, c double")
    got = [r[0] for r in rows.select(routing.size_distance(F.col("q"), F.col("c"), "margin_gate", logs=False)).collect()]
    assert got == pytest.approx([math.log(1.5), math.log(1.5), math.log(1.55) + 0.05, 0.0])


def test_best_setting_deltas_and_null_labels(spark):
    rows = [("baseline", "baseline", 0.0, "a", "x", 0.5), ("baseline", "baseline", 0.0, "b", None, 0.5), ("f", "m", 0.1, "a", "x", 1.0), ("f", "m", 0.1, "b", None, 0.2), ("f", "m", 0.2, "a", "x", 0.6), ("f", "m", 0.2, "b", None, 0.6)]
    rates = spark.createDataFrame(rows, "size_feature string, size_penalty_mode string, lambda_size double, query_id string, query_label string, rate double")
    best = fusion_grid.grid_best(rates).orderBy("place").collect()
    assert [(r.lambda_size, r.n_category_worse, round(r.delta_mean_match_rate, 6)) for r in best] == [(0.2, 0, 0.1), (0.1, 1, 0.1)]
    assert fusion_grid.grid_by_label(rates).filter("query_label IS NULL").count() == 2


RECORD = "specimen_id string, pregroup_id string, size_metric string, has_color int, bbox_longest double, surface_area double, convex_hull_volume double, convex_hull_area double, equiv_diameter_hull double, aspect_xy double, aspect_xz double, aspect_yz double, elongation_12 double, elongation_13 double, elongation_23 double, mean_r double, mean_g double, mean_b double, std_r double, std_g double, std_b double, flatness_ratio double, thinness_ratio double, is_planar_degenerate int, is_linear_degenerate int, is_planar_like int, is_linear_like int, hull_failed int, volume_failed int, n_points_used_for_hull long, mesh_load_sec double, aabb_sec double, hull_sec double, mesh_volume_sec double, total_sec double"


def _records(spark, rows: list[dict]):
    names = [c.split()[0] for c in RECORD.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], RECORD)


def test_features_of_missing_and_infinite_values(spark):
    rows = [{"specimen_id": s, "bbox_longest": v, "aspect_xy": a, "mean_r": m} for s, v, a, m in (("a", 1.0, 0.0, 1.0), ("b", float("inf"), 2.0, None), ("c", 3.0, None, float("nan")), ("d", -7.0, 6.0, 4.0))]
    got, names = metadata.feature_matrix(_records(spark, rows), color=True)
    f = {r.specimen_id: dict(zip(names, r.features, strict=True)) for r in got.collect()}
    assert len(names) == 17
    longest = np.log1p(np.clip([1.0, 1.0, 3.0, -7.0], 0, None))  # the median of 1, 3 and -7 is 1
    q = np.percentile(longest, [25, 50, 75])
    assert [f[s]["bbox_longest"] for s in "abcd"] == pytest.approx((longest - q[1]) / (q[2] - q[0]))
    red = np.array([1.0, 0.0, 0.0, 4.0])
    q = np.percentile(red, [25, 50, 75])
    assert [f[s]["mean_r"] for s in "abcd"] == pytest.approx((red - q[1]) / (q[2] - q[0]))
    assert {f[s]["surface_area"] for s in "abcd"} == {0.0}
    assert len(metadata.feature_matrix(_records(spark, rows))[1]) == 11


def test_summary_of_ties_missing_times_and_nothing(spark):
    rows = [{"specimen_id": s, "pregroup_id": g, "total_sec": t, "flatness_ratio": f, "hull_failed": 1} for s, g, t, f in (("b", "-1", 70.0, 0.01), ("a", "vol_q1", 70.0, 0.04), ("c", "vol_q1", None, None), ("d", None, float("nan"), 0.5))]
    errors = spark.createDataFrame([("e.ply", "broken")], "path string, error string")
    r = metadata.run_summary(_records(spark, rows), errors).first()
    assert (r.n_success, r.n_skipped, r.n_input_files, r.n_noise, r.n_pregroups_excluding_noise, r.n_hull_failed) == (4, 1, 5, 1, 1, 4)
    assert (r.slowest_specimen_id, r.max_total_sec, r.mean_total_sec, r.n_slow_specimens) == ("a", 70.0, 70.0, 2)
    assert (r.n_flatness_lt_0_02, r.n_flatness_lt_0_05, r.n_flatness_lt_0_10) == (1, 2, 2)
    none = metadata.run_summary(_records(spark, []), slow=0).first()
    assert (none.n_success, none.color_ratio, none.slowest_specimen_id, none.n_slow_specimens) == (0, None, None, 0)


def test_evaluation_from_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("specimen_id,cluster_id\n1,0\n2,0\n3,1\n4,-1\n5,1\n9,1\n")
    (tmp_path / "l.txt").write_text("1 red cup\n2 red cup\n3 blue\n4 blue\n5 red cup\n")
    row = commands.evaluate_clusters(spark, str(tmp_path / "c.csv"), str(tmp_path / "l.txt"), str(tmp_path / "out")).first()
    found = json.loads((tmp_path / "out/metrics.json").read_text())
    assert set(found) == {"ARI", "NMI", "AMI", "Purity", "Homogeneity", "Completeness", "V-measure"} and found["Purity"] == 0.8 and row["V-measure"] == found["NMI"]
    read = lambda name: {tuple(r) for r in spark.read.csv(str(tmp_path / "out" / name), header=True).collect()}
    assert read("category_noise_rate") == {("blue", "2", "1", "0.5"), ("red cup", "3", "0", "0.0")}
    assert read("class_confusion") == {("red cup", "0", "2"), ("blue", "1", "1"), ("red cup", "1", "1"), ("blue", "-1", "1")}


def test_ablation_report_with_a_missing_feature(spark, tmp_path):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, f"{'ab'[i % 2]}/{i}", [float(x) for x in rng.normal(size=4)], f"vol_q{i % 2}") for i in range(20)], "row_idx long, id string, embedding array<double>, pregroup_id string")
    sizes = items.select("row_idx", (F.col("row_idx") % 2 + 1.0).alias("bbox_longest"))
    labels = items.select("id", F.substring("id", 1, 1).alias("label"))
    settings = fusion_grid.grid(["bbox_longest", "aspect_xy"], ["ratio_penalty"], [0.0, 5.0])
    best = commands.fusion_ablation(items, sizes, labels, settings, str(tmp_path), 5, 12)
    first = best.filter("place = 1").first()
    # Sizes tell the labels: a heavy weight lists only those of the query's own, as far as they are among its nearest.
    assert first.lambda_size == 5.0 and first.delta_mean_match_rate > 0.2
    report = json.loads((tmp_path / "best_fusion_config.json").read_text())
    assert report["n_failed_runs"] == 2 and report["n_successful_shape_size_runs"] == 2 and report["best_config"]["lambda_size"] == 5.0
    assert best.filter("lambda_size = 0").first().delta_mean_match_rate == 0
    with pytest.raises(ValueError):
        commands.fusion_ablation(items, sizes, labels, fusion_grid.grid(["aspect_xy"], ["ratio_penalty"], [0.1]), str(tmp_path))
    strict = commands.fusion_ablation(items, sizes, labels, settings, str(tmp_path / "strict"), 5, 12, prefilter="strict")
    assert {r.mean_match_rate for r in strict.collect()} == {1.0}


def test_tree_and_metadata_reports(spark, tmp_path):
    items = spark.createDataFrame([(i, f"i{i}", [float(i // 4 * 10 + i % 4), 0.0]) for i in range(8)], "row_idx long, id string, embedding array<double>")
    leaves = commands.export_trees(items, str(tmp_path / "trees"), hdbscan.Config(2, 1))
    assert sorted(r.place for r in leaves.collect()) == list(range(8))
    assert spark.read.parquet(str(tmp_path / "trees/links")).count() == 7
    rows = [{"specimen_id": str(i), "pregroup_id": "-1" if i == 0 else "vol_q1", "has_color": 1, "size_metric": "hull_volume", "total_sec": 1.0} for i in range(3)]
    commands.metadata_report(_records(spark, rows), str(tmp_path / "meta"))
    found = json.loads((tmp_path / "meta/metadata_summary.json").read_text())
    assert found["size_metric_counts"] == {"hull_volume": 3} and found["use_color_resolved"] and len(found["used_feature_columns"]) == 17
    assert found["mean_hull_sec"] is None and found["n_noise"] == 1


def test_path_sums_of_a_long_chain(spark):
    chain = spark.range(1, 1000).select(F.lit("t").alias("tree"), "id", (F.col("id") + 1).alias("next"), (F.col("id") % 7).alias("weight"))
    with Steps(spark) as steps:
        got = {r.id: r.total for r in dendrogram.path_sums(chain, 1001, steps, span=16).collect()}
    assert got == {i: sum(k % 7 for k in range(i, 1000)) for i in range(1, 1000)}


def test_grid_scales_within_arrays(spark):
    """Each norm scales a query's list as its window does, only one window ranks pairs, and carried columns arrive."""
    from pyspark.sql import functions as F

    from cairn.operators.routing import normalized

    rng = np.random.default_rng(8)
    near = [(q, int(c), round(float(v), 3)) for q in range(6) for c, v in zip(rng.permutation(12)[:7], rng.random(7), strict=True)]
    near += [(9, 1, 0.5), (10, 99, 0.1)]  # one candidate; one without a size
    pairs = spark.createDataFrame(near, "query_idx long, candidate_idx long, distance double").withColumn("match", F.col("candidate_idx") % 2)
    size = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=12).round(2))] + [(11 + 3, None)], "row_idx long, bbox_longest double")
    for norm in ("robust", "zscore", "minmax", "none"):
        got = fusion_grid.grid_ranked(pairs, size, [("bbox_longest", "plain_distance", 0.3)], 5, 7, norm, carry=("match",))
        assert got._jdf.queryExecution().executedPlan().toString().count("- Window [") == 1
        got = {(r.query_idx, r.candidate_idx): (r.distance_final, r.match) for r in got.filter("size_feature <> 'baseline'").collect()}
        both = pairs.join(size.toDF("query_idx", "q"), "query_idx", "left").join(size.toDF("candidate_idx", "c"), "candidate_idx", "left").withColumn("x", F.coalesce(F.abs(F.col("q") - F.col("c")), F.lit(0.0)))
        want = {(r.query_idx, r.candidate_idx): r for r in both.withColumn("v", F.round(F.col("distance") + 0.3 * normalized("x", norm), 6)).collect()}
        assert len(got) == 6 * 5 + 2
        assert all(abs(v - want[p].v) < 2e-6 and m == want[p].match for p, (v, m) in got.items())
        for q in range(6):
            assert max(v for (a, _), (v, _) in got.items() if a == q) <= sorted(r.v for (a, _), r in want.items() if a == q)[4] + 2e-6
