"""Density trees, and what is measured by pairs of blocks, against NumPy over whole arrays."""

import math

import brute_trees
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import cluster_metrics, density, hdbscan, pairs
from cairn.operators.steps import Steps, components, follow, numbered, together

SCHEMA = "tree string, row_idx long, id string, embedding array<double>"


def cloud(seed: int, n: int, dims: int = 3) -> np.ndarray:
    """Clumps of several densities with repeated points, on a grid so that distances tie."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (n // 4, dims)) for c, s in ((0, 0.1), (2, 0.3), (5, 0.2))] + [rng.uniform(-3, 8, (n - 3 * (n // 4), dims))])
    x = np.round(x, 1 if seed % 2 else 3)
    x[:5] = x[5:10]
    return x


def frame(spark, trees):
    return spark.createDataFrame([(name, i * 3, f"{name}{i}", v.tolist()) for name, x in trees.items() for i, v in enumerate(x)], SCHEMA).repartition(5)


def weights(merges):
    return sorted(round(float(m[2]), 6) for m in merges)


@pytest.fixture(scope="module")
def trees():
    return {"a": cloud(1, 64), "b": cloud(2, 40), "two": cloud(3, 10)[:2], "one": cloud(3, 10)[:1]}


@pytest.mark.parametrize("block, most, span", [(1024, 1 << 20, 1 << 16), (9, 0, 16)])
def test_trees(spark, trees, block, most, span):
    """Whatever blocks, contraction and spans are, the spanning tree, the merges and the condensed tree are those of one array."""
    with Steps(spark) as steps:
        points = hdbscan.placed(frame(spark, trees), steps)
        cored = steps.cut(density.core_distances(points, [1, 4], block=block))
        for r in cored.collect():
            want = [brute_trees.core_distances(trees[r.tree], k, "euclidean")[r.pos] for k in (1, 4)]
            assert np.allclose(r.cores, want)
        edges = steps.cut(density.spanning_trees(cored, steps, ["|1", "|4"], block=block, most=most))
        merges = steps.cut(density.single_linkage(edges, steps, span))
        tree = density.condensed(merges.withColumn("least", F.lit(4)), steps, span).toPandas()
        merges, edges = merges.toPandas(), edges.toPandas()
    for name, x in trees.items():
        for k in (1, 4):
            m = merges[merges.tree == f"{name}|{k}"].sort_values("r")
            e = edges[edges.tree == f"{name}|{k}"].sort_values(["w", "a", "b"])
            if len(x) < 2:
                assert not len(m) and not len(e)
                continue
            # The edges, merged one by one in NumPy, give the same merges.
            want = brute_trees.single_linkage(e[["a", "b", "w"]].to_numpy(), len(x))
            assert np.allclose(m[["left", "right", "distance", "size"]].to_numpy(), want)
            assert weights(want) == weights(brute_trees.trees(x, 4, k)[0])
            assert len(set(zip(e.a, e.b, strict=True))) == len(x) - 1
            t = tree[tree.tree == f"{name}|{k}"]
            brute = brute_trees.condense(want, len(x), 4)
            assert sorted((c, round(v, 6), s) for c, v, s in zip(t.child, t.lambda_val, t.child_size, strict=True) if c < len(x)) == sorted((c, round(v, 6), s) for _, c, v, s in brute if c < len(x))
            assert sorted((round(v, 6), s) for c, v, s in zip(t.child, t.lambda_val, t.child_size, strict=True) if c >= len(x)) == sorted((round(v, 6), s) for _, c, v, s in brute if c >= len(x))


def test_many_small_trees(spark):
    """Frames hold many whole groups, and small trees are dealt over the tasks: their bytes would all fit one."""
    rows = spark.range(3000).selectExpr("concat('t', id % 500) AS tree", "id % 2 AS part", "id AS v").repartition(7)
    seen = together(rows, ["tree", "part"], lambda g: g.groupby("group").agg(kinds=("tree", "nunique"), n=("v", "size")).assign(frame=len(g)), "kinds long, n long, frame long", least=40).collect()
    assert len(seen) == 500 and {(r.kinds, r.n) for r in seen} == {(1, 6)} and max(r.frame for r in seen) > 40
    rng = np.random.default_rng(5)
    parts = {f"t{i}": cloud(i, 10 + i % 5) for i in range(60)}
    edges = {t: brute_trees.spanning_tree(x, brute_trees.core_distances(x, 2, "euclidean"), "euclidean") for t, x in parts.items()}
    # With a heavier pair of ends in each tree, which goes.
    rows = [(t, int(a), int(b), float(w)) for t, e in edges.items() for a, b, w in e] + [(t, *sorted(rng.choice(len(x), 2, False).tolist()), 99.0) for t, x in parts.items()]
    with Steps(spark) as steps:
        tree = steps.cut(density.contracted(spark.createDataFrame(rows, "tree string, a long, b long, w double"), steps))
        merges = density.single_linkage(tree, steps)
        assert merges.rdd.getNumPartitions() > 1
        merges = merges.toPandas()
        kept = tree.toPandas()
    for t, x in parts.items():
        assert set(kept[kept.tree == t][["a", "b", "w"]].itertuples(index=False, name=None)) == set(map(tuple, edges[t].tolist()))
        assert np.allclose(merges[merges.tree == t].sort_values("r")[["left", "right", "distance", "size"]], brute_trees.single_linkage(edges[t], len(x)))


def test_groups_are_dealt_after_a_join(spark):
    """With as many partitions as tasks, a join by the same columns must not stand for the dealing: it may become a broadcast, which
    leaves a group's rows in several tasks."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(was, (str(2 * spark.sparkContext.defaultParallelism), "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 4000, 1, 7).selectExpr("concat('t', id % 20) AS tree", "id AS v")
        sized = rows.join(rows.groupBy("tree").agg(F.count("*").alias("k")), "tree")
        seen = together(sized, ["tree"], lambda g: g.groupby("tree", as_index=False).agg(n=("v", "size")), "tree string, n long")
        assert "REPARTITION_BY_NUM" in seen._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.tree, r.n) for r in seen.collect()) == sorted((f"t{i}", 200) for i in range(20))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


CONFIGS = [("eom", False, 0.0), ("leaf", False, 0.0), ("eom", True, 0.0), ("eom", False, 0.6), ("leaf", True, 2.5), ("eom", True, 0.9)]


@pytest.mark.parametrize("span", [1 << 16, 2])
def test_labels(spark, trees, span):
    """Labels and membership under several options, with clusters settled at once or in spans of two."""
    with Steps(spark) as steps:
        points = hdbscan.placed(frame(spark, trees), steps)
        merges = hdbscan.linkage_of(points, [3], "euclidean", steps)
        every = merges.toPandas()
        cond = steps.cut(density.condensed(merges.withColumn("least", F.lit(5)), steps))
        config = spark.createDataFrame([(f"{t}|3", f"{t}/{i}", s == "leaf", root, eps) for t in trees for i, (s, root, eps) in enumerate(CONFIGS)], "tree string, of string, leaf boolean, root_ok boolean, epsilon double")
        got = density.selected(cond, config, steps, span).toPandas()
    for name, x in trees.items():
        if len(x) < 3:
            continue
        m = every[every.tree == f"{name}|3"].sort_values("r")[["left", "right", "distance", "size"]].to_numpy()
        tree = brute_trees.condense(m, len(x), 5)
        for i, (s, root, eps) in enumerate(CONFIGS):
            labels, prob = brute_trees.select(tree, len(x), brute_trees.SimpleNamespace(selection=s, allow_single_cluster=root, epsilon=eps))
            g = got[got.tree == f"{name}/{i}"].set_index("pos")
            assert {p: v for p, v in enumerate(labels) if v >= 0} == g.label.to_dict(), (name, i)
            assert all(abs(g.prob[p] - prob[p]) < 1e-9 for p in g.index)


def test_clusters_of_planted_items(spark):
    x = np.concatenate([np.random.default_rng(0).normal(c, 0.05, (40, 4)) for c in (0, 2, 4)])
    items = frame(spark, {"x": x}).drop("tree")
    got = {r.id: r.cluster_id for r in hdbscan.cluster(items, hdbscan.Config(10, 5)).collect()}
    assert [{got[f"x{i}"] for i in range(k, k + 40)} - {-1} for k in (0, 40, 80)] == [{0}, {1}, {2}]
    assert hdbscan.cluster(items.limit(0)).count() == 0
    assert [tuple(r) for r in hdbscan.cluster(items.filter("id = 'x3'")).collect()] == [("x3", -1, 0.0)]


def test_linkage_cut_and_nearest(spark, trees):
    x, c = trees["a"], hdbscan.Config(5, 3)
    items = frame(spark, {"a": x}).drop("tree")
    core = brute_trees.core_distances(x, 3, "euclidean")
    w = np.maximum(np.maximum(np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 6), core[:, None]), core[None])
    np.fill_diagonal(w, np.inf)
    near = {r.row_idx // 3: (r.nearest // 3, r.distance) for r in hdbscan.mutual_reachability_nearest(items, c).collect()}
    for i in range(len(x)):
        best = min(((w[i, j], min(i, j), max(i, j), j) for j in range(len(x)) if j != i))
        assert near[i] == (best[3], best[0])
    comp = {r.row_idx // 3: r.component // 3 for r in hdbscan.linkage_cut(items, 0.5, c).collect()}
    want = list(range(len(x)))
    for _ in x:
        want = [min([want[i]] + [want[j] for j in np.nonzero(w[i] <= 0.5)[0]]) for i in range(len(x))]
    assert [comp[i] for i in range(len(x))] == want


def test_sweep(spark, trees):
    x = trees["a"]
    items = frame(spark, {"a": x}).drop("tree")
    labels = spark.createDataFrame([(f"a{i}", "AB"[i % 2] if i % 5 else None) for i in range(len(x))], "id string, label string")
    got = hdbscan.sweep(items, [1, 5, 9], [2, 500], labels=labels).toPandas()
    assert len(got) == 12 and got.error.notna().sum() == 8
    bad = got[got.error.notna()]
    assert (bad.final_score == -1).all() and (bad.noise_ratio == 1).all() and (bad.n_clusters == 0).all()
    one = got[(got.min_cluster_size == 5) & (got.min_samples == 2) & (got.selection_method == "leaf")].iloc[0]
    cl = hdbscan.cluster(items, hdbscan.Config(5, 2, selection="leaf")).toPandas()
    assert one.n == len(x) and one.n_clusters == cl[cl.cluster_id >= 0].cluster_id.nunique() and one.noise_ratio == (cl.cluster_id == -1).mean()
    assert abs(one.mean_prob - cl.prob.mean()) < 1e-12


def test_steps(spark):
    with Steps(spark) as steps:
        rows = spark.createDataFrame([("x" if i % 3 else "y", i * 7 % 40) for i in range(40)], "tree string, v long").repartition(6)
        got = numbered(rows, ["tree"], ["v"], steps).collect()
        for t in "xy":
            mine = sorted((r.idx, r.v, r.n) for r in got if r.tree == t)
            assert [m[0] for m in mine] == list(range(len(mine))) and mine == sorted(mine, key=lambda m: m[1]) and {m[2] for m in mine} == {len(mine)}
        for span in (100, 3, 1):
            chain = spark.createDataFrame([("t", i, i + 1) for i in range(17)] + [("t", 20, 30), ("u", 4, 9)], "tree string, id long, next long")
            got = {(r.tree, r.id): r.end for r in follow(chain, 31, steps, span).collect()}
            assert got == {("t", i): 17 for i in range(17)} | {("t", 20): 30, ("u", 4): 9}
        e = spark.createDataFrame([("t", 1, 2), ("t", 2, 3), ("t", 7, 8), ("u", 2, 5), ("u", 5, 2), ("t", 4, 4)], "tree string, a long, b long")
        assert {(r.tree, r.node, r.component) for r in components(e, ["tree"], steps).collect()} == {("t", 1, 1), ("t", 2, 1), ("t", 3, 1), ("t", 7, 7), ("t", 8, 7), ("u", 2, 2), ("u", 5, 2)}


# What is measured by pairs of blocks


@pytest.fixture(scope="module")
def clustered():
    x = cloud(2, 60)
    label = np.random.default_rng(3).choice([-1, 0, 0, 0, 1, 2, 7], len(x))
    label[label == 7] = 2
    label[0] = 9  # alone
    return x, label


def rows_of(spark, x, label):
    return spark.createDataFrame([(i, int(k), v.tolist()) for i, (v, k) in enumerate(zip(x, label, strict=True))], "row_idx long, cluster_id int, embedding array<double>").repartition(4)


@pytest.mark.parametrize("block", [1024, 9])
def test_block_measures(spark, clustered, block):
    x, label = clustered
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    c = rows_of(spark, x, label)
    got = {r.cluster_id: r.mean_distance for r in cluster_metrics.intra_distance(c).collect()}
    for k in set(label) - {-1}:
        m = np.nonzero(label == k)[0]
        want = d[np.ix_(m, m)][np.triu_indices(len(m), 1)].mean() if len(m) > 1 else None
        assert got[k] == pytest.approx(want) if want is not None else got[k] is None
    s = []
    for i in np.nonzero(label >= 0)[0]:
        a = [d[i, j] for j in range(len(x)) if label[j] == label[i] and j != i]
        b = min(d[i, label == k].mean() for k in set(label) - {-1, label[i]})
        s.append((b - np.mean(a)) / max(b, np.mean(a)) if a else 0.0)
    assert cluster_metrics.silhouette(c, block=block).first().silhouette == pytest.approx(np.mean(s))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_sums_to_clusters(monkeypatch, metric):
    """However tiles cut clusters, and whether a block holds them whole or in part: what a block pair returns are sums of plain distances."""
    monkeypatch.setattr(pairs, "TILE", 16)
    x = cloud(4, 200)
    label = np.sort(np.random.default_rng(1).choice([-7, 0, 1, 2, 3, 4, 5, 40, 41, 42, 43], 200, p=[0.3, 0.3, *[0.4 / 9] * 9]))
    members, d = np.array([(label == k).sum() for k in label]), density.distances(x, x, metric, None)
    side = lambda s: pairs.Rows({"pos": np.arange(200)[s].tobytes(), "vec": x[s].tobytes()})
    for one, two in ((slice(0, 90), slice(90, 200)), (slice(30, 150), None)):
        cols = two or one
        forth, back = (cluster_metrics.Sums(label[p], label[q], members[q]) for p, q in ((one, cols), (cols, one)))
        for i, j, t in pairs.measured(side(one), None if two is None else side(two), metric):
            forth.see(i, j, t)
            back.see(j, i, t.T)
        for sums, p, q in ((forth, one, cols), (back, cols, one)):
            got = {(r.row_idx, r.other): (r.s, r.m, r.best) for f in sums.frames(np.arange(200)[p]) for r in f.itertuples()}
            inside, want = label[q], {}
            for i in range(200)[p]:
                near = [d[i, q][inside == k].mean() for k in set(inside) if k != label[i] and (inside == k).sum() == (label == k).sum()]
                for k in set(inside) | {label[i]}:
                    m, best = (inside == k).sum(), min(near, default=np.inf) if k == label[i] else np.inf
                    if k == label[i] and (m or best < np.inf) or k != label[i] and m < (label == k).sum():
                        want[i, k] = (d[i, q][inside == k].sum(), m, best)
            assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_measures_move_large_blocks(spark, clustered, monkeypatch):
    """Silhouettes and distances within large clusters go by pairs of large blocks: rows met n / 1024 others' blocks before."""
    x, label = clustered
    monkeypatch.setattr(cluster_metrics, "block_pairs", lambda points, *_: density.block_pairs(points.filter("n <= 9"), 9))
    c = rows_of(spark, x, label)
    whole, parts = ({r.cluster_id: r.mean_distance for r in cluster_metrics.intra_distance(c, block=b).collect()} for b in (9, 4))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for k in set(label) - {-1, 9}:
        want = d[np.ix_(label == k, label == k)][np.triu_indices((label == k).sum(), 1)].mean()
        assert whole[k] == pytest.approx(want) and parts[k] == pytest.approx(want)


def brute_validity(x, label):
    d = np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 6)
    out, core, inner, sparse = {}, {}, {}, {}
    for k in sorted(set(label) - {-1}):
        m = np.nonzero(label == k)[0]
        if len(m) < 2:
            continue
        for i in m:
            p = sum(d[i, j] ** -x.shape[1] for j in m if d[i, j] > 0)
            core[i] = round((p / (len(m) - 1)) ** (-1 / x.shape[1]), 6) if p else 0.0
        w = lambda i, j: max(d[i, j], core[i], core[j])
        tree, seen = [], [m[0]]
        while len(seen) < len(m):
            e = min((w(i, j), min(i, j), max(i, j), j) for i in seen for j in m if j not in seen)
            seen.append(e[3])
            tree.append(e[:3])
        ends = [i for e in tree for i in e[1:]]
        many = {i for i in ends if ends.count(i) > 1} or set(ends)
        inner[k], inside = many, [e[0] for e in tree if e[1] in many and e[2] in many]
        sparse[k] = max(inside or [e[0] for e in tree])
    for k in sparse:
        sep = min((max(d[i, j], core[i], core[j]) for o in sparse if o != k for i in inner[k] for j in inner[o]), default=None)
        out[k] = (sparse[k], sep, None if sep is None else (sep - sparse[k]) / max(sep, sparse[k]))
    return out


@pytest.mark.parametrize("block", [1024, 11])
def test_density_validity(spark, clustered, block):
    x, label = clustered
    got = {r.cluster_id: (r.sparseness, r.separation, r.validity) for r in cluster_metrics.density_validity(rows_of(spark, x, label), block=block).collect()}
    want = brute_validity(x, label)
    assert set(got) == set(want) and 9 not in got
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=2e-6)
    alone = cluster_metrics.density_validity(rows_of(spark, x, np.where(label == 0, 0, -1))).collect()
    assert len(alone) == 1 and alone[0].validity is None
    assert cluster_metrics.density_validity(rows_of(spark, x, np.full(len(x), -1))).count() == 0


def test_validity_numbers_points(spark, clustered, monkeypatch):
    """Whatever the rows' ids and the clusters' names are, a tree's points are 0 to n - 1, as its merges are numbered from n on."""
    x, label = clustered
    seen = []

    def trees(points, *args):
        seen.extend(points.select("tree", "n", "pos").collect())
        assert all(0 <= r.pos < r.n for r in seen)
        return density.spanning_trees(points, *args)

    monkeypatch.setattr(cluster_metrics, "spanning_trees", trees)
    c = rows_of(spark, x, np.where(label == 1, -5, label)).withColumn("row_idx", F.col("row_idx") * 11 + 20)
    got = {r.cluster_id: (r.n, r.sparseness, r.separation) for r in cluster_metrics.density_validity(c, block=11).collect()}
    assert len({(r.tree, r.pos) for r in seen}) == len(seen) == sum(n for n, _, _ in got.values())
    want = {-5 if k == 1 else k: v for k, v in brute_validity(x, label).items()}
    assert {k: v[1:] for k, v in got.items()} == {k: pytest.approx(v[:2], abs=2e-6) for k, v in want.items()}


def test_validity_is_high_for_clumps_apart(spark):
    x = np.concatenate([np.random.default_rng(0).normal(c, 0.05, (30, 3)) for c in (0, 5)])
    for label, low, high in ((np.repeat([0, 1], 30), 0.8, 1.0), (np.tile([0, 1], 30), -1.0, 0.0)):
        got = cluster_metrics.density_validity(rows_of(spark, x, label)).selectExpr("sum(weight * validity) AS v").first().v
        assert low < got < high


def brute_ami(table):
    t = sum(table.values())
    a, b = ({k: sum(v for q, v in table.items() if q[i] == k) for k in {q[i] for q in table}} for i in (0, 1))
    h = lambda m: -sum(v / t * math.log(v / t) for v in m.values())
    mi = sum(v / t * math.log(t * v / (a[i] * b[j])) for (i, j), v in table.items())
    e = sum(k / t * math.log(t * k / (x * y)) * math.comb(x, k) * math.comb(t - x, y - k) / math.comb(t, y) for x in a.values() for y in b.values() for k in range(max(1, x + y - t), min(x, y) + 1))
    return (mi - e) / ((h(a) + h(b)) / 2 - e)


def test_ami(spark):
    rng = np.random.default_rng(1)
    table = {(f"l{i}", j): int(v) for i in range(6) for j in range(5) if (v := rng.integers(0, 9)) > 0}
    rows = spark.createDataFrame([(i, j, n) for (i, j), n in table.items()], "label string, cluster_id int, n long")
    assert cluster_metrics.adjusted_mutual_information(rows).first().ami == pytest.approx(brute_ami(table))
    assert cluster_metrics.adjusted_mutual_information(rows.limit(0)).first().ami is None
    assert cluster_metrics.adjusted_mutual_information(rows.limit(1)).first().ami == 1.0


def test_agreement_of_several_tables(spark):
    rows = spark.createDataFrame([(1, "a", 0, 3), (1, "b", 1, 2), (2, "a", 0, 2), (2, "b", 0, 2), (3, "a", 0, 1)], "config int, label string, cluster_id int, n long")
    got = {r.config: r for r in cluster_metrics.agreement(rows, "config").collect()}
    for k, r in got.items():
        one = cluster_metrics.agreement(rows.filter(F.col("config") == k)).first()
        assert one.ari == r.ari and one.v_measure == r.v_measure
    assert got[1].ari == 1.0 and got[2].ari == 0.0 and got[3].ari == 1.0
