"""Branches of planted shapes and against NumPy; sweeps ranked by coarse structure."""

import brute_trees
import numpy as np
import pytest

from cairn.operators import branches, cluster_metrics, hdbscan

ITEMS = "row_idx long, id string, embedding array<double>"


def star(arms: int, n: int = 30, seed: int = 0) -> np.ndarray:
    """Points along arms from one centre."""
    rng = np.random.default_rng(seed)
    t = np.linspace(0.02, 1, n)
    out = [np.stack([t * np.cos(a), t * np.sin(a)], 1) for a in 2 * np.pi * np.arange(arms) / arms]
    return np.concatenate(out) + rng.normal(0, 0.004, (arms * n, 2))


def frame(spark, x):
    return spark.createDataFrame([(i, f"i{i}", v.tolist()) for i, v in enumerate(x)], ITEMS).repartition(4)


def brute(x, base, prob, samples, least, selection, method):
    """Branch labels of each base cluster's members, before clusters of few branches are taken as one."""
    out = {}
    for k in sorted(set(base) - {-1}):
        at = np.nonzero(base == k)[0]
        y = x[at]
        far = 1 / np.linalg.norm(y - np.average(y, axis=0, weights=prob[at]), axis=1)
        core = brute_trees.core_distances(y, samples, "euclidean")
        d = np.round(np.linalg.norm(y[:, None] - y[None], axis=2), 6)
        reach = np.maximum(np.maximum(d, core[:, None]), core[None])
        tree = brute_trees.spanning_tree(y, core, "euclidean")
        if method == "full":
            edges = {(i, j) for i in range(len(y)) for j in range(i) if reach[i, j] <= tree[:, 2].max()}
        else:
            # Among equal distances the nearest of the least place count, and trees of equal weights are those of least ends.
            edges = {(i, j) for i in range(len(y)) for j in sorted(range(len(y)), key=lambda j: (d[i, j], j)) if j != i and j in [q for q in sorted(range(len(y)), key=lambda q: (d[i, q], q)) if q != i][:samples]}
            edges |= {(int(a), int(b)) for a, b, _ in tree}
        rows = sorted((max(far[i], far[j]), min(i, j), max(i, j)) for i, j in edges)
        top, light = list(range(len(y))), []

        def find(i, top=top):
            while top[i] != i:
                i = top[i]
            return i

        for w, a, b in rows:
            if find(a) != find(b):
                top[find(a)] = find(b)
                light.append((a, b, w))
        light = np.array(sorted(set(light), key=lambda e: (e[2], e[0], e[1])))
        cond = brute_trees.condense(brute_trees.single_linkage(light, len(y)), len(y), least)
        out[k] = at, *brute_trees.select(cond, len(y), brute_trees.SimpleNamespace(selection=selection, allow_single_cluster=False, epsilon=0.0))
    return out


@pytest.mark.parametrize("method, selection", [("core", "eom"), ("full", "leaf")])
def test_branches(spark, method, selection):
    x = np.concatenate([star(3), star(2, seed=1) + 20, star(4, seed=2) - 20, [[500.0, 500.0]]])
    labels, strengths = branches.detect(frame(spark, x), hdbscan.Config(20, 4), 8, selection, method)
    got = labels.toPandas().set_index("id").loc[[f"i{i}" for i in range(len(x))]]
    base, prob = got.base_cluster_label.to_numpy(), got.base_cluster_probability.to_numpy()
    assert set(base) == {-1, 0, 1, 2} and base[-1] == -1
    want = brute(x, base, prob, 4, 8, selection, method)
    for at, label, p in want.values():
        g = got.iloc[at]
        many = len(set(label) - {-1})
        if many > 2:
            assert (g.branch_label == label).all() and np.allclose(g.branch_probability, p)
        else:
            assert (g.branch_label == 0).all() and g.subgroup_label.nunique() == 1
    # Three and four arms are split, a line is not; noise stays noise.
    assert [len(set(got.iloc[at].branch_label) - {-1}) for at, *_ in want.values()] == [3, 1, 4]
    assert tuple(got.iloc[-1][["subgroup_label", "subgroup_probability", "branch_label", "branch_probability"]]) == (-1, 0.0, -1, 0.0)
    kinds = got[got.base_cluster_label >= 0].groupby(["base_cluster_label", "branch_label"]).subgroup_label.nunique()
    assert (kinds == 1).all() and got[got.subgroup_label >= 0].subgroup_label.nunique() == len(kinds)
    s = strengths.toPandas()
    assert s.groupby("base_cluster_index").size().to_dict() == {0: 3, 1: 2, 2: 4} and s.branch_persistence.between(0, 1).all()
    one = branches.summary(labels).first()
    assert one.n_samples == len(x) and one.n_base_clusters == 3 and one.n_subgroups == len(kinds) and one.base_noise_ratio == 1 / len(x)


def test_no_clusters(spark):
    labels, strengths = branches.detect(frame(spark, np.eye(3)), hdbscan.Config(5, 2))
    assert {tuple(r)[1:] for r in labels.collect()} == {(-1, 0.0, -1, 0.0, -1, 0.0)} and strengths.count() == 0
    assert branches.summary(labels.limit(0)).first().base_noise_ratio == 0


def test_flattened(spark):
    flat = spark.createDataFrame([(0, [0.5, None]), (1, None), (2, []), (3, [0.25])], "base_cluster_index int, branch_persistence array<double>")
    assert [tuple(r) for r in branches.flattened(flat).orderBy("base_cluster_index", "branch_index").collect()] == [(0, None, None), (0, "0", 0.5), (1, None, None), (2, None, None), (3, "0", 0.25)]
    deep = spark.createDataFrame([(0, [[1.0, 2.0], [3.0]])], "base_cluster_index int, branch_persistence array<array<double>>")
    assert [tuple(r) for r in branches.flattened(deep).collect()] == [(0, "0.0", 1.0), (0, "0.1", 2.0), (0, "1.0", 3.0)]
    assert [tuple(r) for r in branches.flattened(spark.createDataFrame([(4, 0.5)], "base_cluster_index int, branch_persistence double")).collect()] == [(4, "0", 0.5)]


def two(n: int = 40) -> np.ndarray:
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal(c, 0.1, (n, 5)) for c in (0, 3)])


def test_coarse_sweep(spark):
    items = frame(spark, two())
    labels = spark.createDataFrame([(f"i{i}", "ab"[i >= 40]) for i in range(80)], "id string, label string")
    grid = [(p, m, s, sel) for p in (0, 2) for m in (10, 30) for s in (1, 500) for sel in ("eom", "leaf")]
    ranked = hdbscan.coarse_sweep(items, grid, "none", labels=labels)
    got = ranked.orderBy("coarse_rank").toPandas()
    assert got.coarse_rank.tolist() == list(range(1, 17)) and set(got.config) == set(range(16))
    assert (got.score.diff().dropna() <= 0).all() or np.isneginf(got.score).any()
    bad = got[got.min_samples == 500]
    assert (bad.reject_reason == "evaluation_failure").all() and bad.invalid.all() and np.isneginf(bad.score).all() and bad.error.notna().all()
    best = got.iloc[0]
    assert not best.invalid and best.k == 2 and best.ari == 1.0 and best.purity == 1.0
    # The metrics are those of the clustering that is run again.
    again = hdbscan.rerun(items, ranked, None, "none")
    one = cluster_metrics.coarse_metrics(again, int(best.min_cluster_size), best.selection_method).first()
    assert one.score == pytest.approx(best.score) and one.noise == best.noise and one.k == best.k
    assert [r.coarse_rank for r in hdbscan.top_configs(ranked, 3).collect()] == [1, 2, 3]
    with pytest.raises(ValueError, match="rank 99"):
        hdbscan.rerun(items, ranked, 99)
    with pytest.raises(ValueError, match="can't be run"):
        hdbscan.rerun(items, ranked, 16)
    assert hdbscan.candidates_of(ranked) == [(float(p), m, s, sel) for p, m, s, sel in grid]
    # What an earlier sweep tried can be ranked anew.
    some = hdbscan.coarse_sweep(items, [grid[4], grid[12]], "none").toPandas()
    assert sorted(some.score) == sorted(got[got.config.isin([4, 12])].score)


def test_preprocessed(spark):
    x = two(5)
    got = np.array([r.embedding for r in hdbscan.preprocessed(frame(spark, x)).orderBy("row_idx").collect()])
    assert np.allclose(got, x / np.linalg.norm(x, axis=1, keepdims=True))
    got = np.array([r.embedding for r in hdbscan.preprocessed(frame(spark, x), "none", 2).orderBy("row_idx").collect()])
    y = x - x.mean(0)
    u, s, v = np.linalg.svd(y, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(y @ v[:2].T))
    with pytest.raises(ValueError):
        hdbscan.preprocessed(frame(spark, x), "max")


def test_recursive_report(spark):
    """One large loose cluster of two parts is split; the report says how distances within changed."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (60, 3)) for c in (0.0, 0.35)] + [rng.normal(9 + 3 * i, 0.02, (6, 3)) for i in range(5)])
    out, report = hdbscan.recursive(frame(spark, x), hdbscan.Config(6, 3, epsilon=0.6), hdbscan.Config(10, 3, selection="eom"), multiple=2.0)
    assert report.count() == 1
    r, o = report.first(), out.toPandas().set_index("id")
    d = lambda y: np.linalg.norm(y[:, None] - y[None], axis=2)[np.triu_indices(len(y), 1)].mean()
    at = [int(i[1:]) for i in o.index[o.base_cluster == r.parent_cluster]]
    assert r.parent_size == len(at) >= 110 and r.median_size == 6 and r.split_threshold == 30 and r.parent_distance == pytest.approx(d(x[at]))
    assert r.improved and r.adopted and r.reject_reason == "" and r.n_child_clusters == 2
    kids = [[int(i[1:]) for i in o.index[o.cluster_id == k]] for k in set(o.cluster_id[(o.base_cluster == r.parent_cluster) & (o.depth == 1)])]
    assert r.child_distance == pytest.approx(sum(len(k) * d(x[k]) for k in kids) / sum(map(len, kids)))
    assert o.split.sum() == r.parent_size and o.cluster_id.max() > o.base_cluster.max()


def test_pca_by_blocks(spark):
    from cairn.operators import decomposition

    x = np.random.default_rng(0).normal(size=(200, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) + 1e6
    n, mean, cov = decomposition._moments(frame(spark, x))
    assert n == 200 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T), rtol=1e-6)
    report = decomposition.pca(frame(spark, x), 3)[1].orderBy("component").collect()
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose([r.ratio for r in report], want[:3] / want.sum()) and report[-1].cumulative == pytest.approx(want[:3].sum() / want.sum())
    assert decomposition.pca(frame(spark, x).limit(0), 3)[1].count() == 0


def test_valleys(spark):
    rows = [(0, 0.1, 2), (1, 0.15, 3), (2, 0.15, 5), (3, 0.9, 8)]
    linkage = spark.createDataFrame(rows, "r long, distance double, size long").repartition(3)
    got = {r.r: (r.gap, r.score) for r in hdbscan.valley_scores(linkage).collect()}
    for (i, d, n), after in zip(rows, rows[1:] + [None], strict=True):
        gap = None if after is None else after[1] - d
        assert got[i] == (gap if gap is None else pytest.approx(gap), None if gap is None else pytest.approx(gap * np.log(n)))
    assert [r.r for r in hdbscan.valley_scores(linkage, 2).collect()] == [2, 0]


def test_kmeans_of_planted_items(spark):
    from cairn.operators import decomposition

    x = two()
    got = decomposition.kmeans(frame(spark, x), 2).toPandas().set_index("id").loc[[f"i{i}" for i in range(80)]]
    assert got.cluster_id[:40].nunique() == got.cluster_id[40:].nunique() == 1 and got.cluster_id.nunique() == 2
    for part in (slice(0, 40), slice(40, 80)):
        assert np.allclose(got.score[part], np.linalg.norm(x[part] - x[part].mean(0), axis=1))


def test_purity_of_nothing(spark):
    none = spark.createDataFrame([], "label string, cluster_id int, n long")
    assert cluster_metrics.purity(none).first().purity == 0.0 and cluster_metrics.purity(none, None).first().purity is None
    assert np.isnan(cluster_metrics.purity(none, float("nan")).first().purity)
