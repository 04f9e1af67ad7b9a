"""Statistics of a clustering (id, cluster_id, prob; -1 is noise), and its agreement with labels."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.density import BLOCK, block_pairs, distances, rows_of, spanning_trees
from cairn.operators.pairs import LEAST, Rows, each_pair, inverse_powers, leaving_edges, measured, packed, power_sums
from cairn.operators.steps import Steps, numbered

NOISE = -1


def cluster_sizes(c: DataFrame) -> DataFrame:
    return c.filter(F.col("cluster_id") != NOISE).groupBy("cluster_id").agg(F.count("*").alias("n"))


def size_stats(c: DataFrame) -> DataFrame:
    """One row: least, greatest, mean and median size of the clusters; all null without clusters."""
    n = F.col("n")
    return cluster_sizes(c).agg(F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.avg(n).alias("mean_size"), F.percentile(n, 0.5).alias("median_size"))


def summary(c: DataFrame) -> DataFrame:
    """One row: n, n_clusters, n_noise, noise_ratio, and the largest cluster's share of all rows and of rows that aren't noise."""
    noise = F.col("cluster_id") == NOISE
    a = c.agg(F.count("*").alias("n"), F.count_distinct(F.when(~noise, F.col("cluster_id"))).alias("n_clusters"), F.count_if(noise).alias("n_noise"))
    b = cluster_sizes(c).agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    out = a.crossJoin(b)
    rest = F.col("n") - F.col("n_noise")
    return out.select("n", "n_clusters", "n_noise", (F.col("n_noise") / F.greatest(F.lit(1), "n")).alias("noise_ratio"), (F.col("largest") / F.greatest(F.lit(1), "n")).alias("largest_of_all"), (F.col("largest") / F.greatest(F.lit(1), rest)).alias("largest_of_clustered"))


def contingency(c: DataFrame, labels: DataFrame, noise: str = "as_cluster") -> DataFrame:
    """label, cluster_id, n of the rows that both have; noise: "as_cluster" or "exclude" (with empty labels)."""
    both = c.select("id", "cluster_id").join(labels.select("id", "label"), "id")
    if noise == "exclude":
        both = both.filter((F.col("cluster_id") != NOISE) & (F.col("label") != ""))
    return both.groupBy("label", "cluster_id").agg(F.count("*").alias("n"))


def purity(table: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """One row: the share of rows with their cluster's main label; without rows, empty (sweeps have NaN there, reports 0)."""
    return table.groupBy("cluster_id").agg(F.max("n").alias("m"), F.sum("n").alias("t")).agg(F.coalesce(F.sum("m") / F.sum("t"), F.lit(empty).cast("double")).alias("purity"))


def cluster_purity(table: DataFrame) -> DataFrame:
    """For each cluster but noise: n, its main label (ties: the smallest) and that label's share."""
    t = table.filter(F.col("cluster_id") != NOISE).groupBy("cluster_id")
    main = F.min(F.struct((-F.col("n")).alias("k"), "label"))
    return t.agg(F.sum("n").alias("n"), main["label"].alias("major_label"), (-main["k"] / F.sum("n")).alias("purity"))


def noise_rate(c: DataFrame, labels: DataFrame) -> DataFrame:
    both = c.select("id", "cluster_id").join(labels.select("id", "label"), "id")
    return both.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("cluster_id") == NOISE).cast("int")).alias("noise_rate"))


def agreement(table: DataFrame, *by: str) -> DataFrame:
    """by, ari, homogeneity, completeness, v_measure (which is the arithmetic NMI) of each contingency table; one row without by."""
    pairs = lambda c: c * (c - 1) / 2
    n = F.col("n").cast("double")
    a = table.groupBy(*by, "label").agg(F.sum(n).alias("x")).groupBy(*by).agg(F.sum(pairs(F.col("x"))).alias("ca"), F.sum(F.col("x") * F.log("x")).alias("ea"))
    b = table.groupBy(*by, "cluster_id").agg(F.sum(n).alias("x")).groupBy(*by).agg(F.sum(pairs(F.col("x"))).alias("cb"), F.sum(F.col("x") * F.log("x")).alias("eb"))
    t = table.groupBy(*by).agg(F.sum(n).alias("t"), F.sum(pairs(n)).alias("cn"), F.sum(n * F.log(n)).alias("en"))
    one = t.join(a, [*by]).join(b, [*by]) if by else t.crossJoin(a).crossJoin(b)
    log = F.log("t")
    h_l, h_c = log - F.col("ea") / F.col("t"), log - F.col("eb") / F.col("t")
    mi = (F.col("en") - F.col("ea") - F.col("eb")) / F.col("t") + log
    e = F.try_divide(F.col("ca") * F.col("cb"), pairs(F.col("t")))
    most = (F.col("ca") + F.col("cb")) / 2
    out = one.select(*by, F.when(F.coalesce(most == e, F.lit(True)), 1.0).otherwise((F.col("cn") - e) / (most - e)).alias("ari"), F.when(h_l < 1e-12, 1.0).otherwise(mi / h_l).alias("homogeneity"), F.when(h_c < 1e-12, 1.0).otherwise(mi / h_c).alias("completeness"))
    h, c = F.col("homogeneity"), F.col("completeness")
    return out.withColumn("v_measure", F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c)))


def adjusted_mutual_information(table: DataFrame) -> DataFrame:
    """One row: ami, with the arithmetic mean of both entropies; null of an empty table.

    The expected value sums over pairs of margins: margins of one size stand together, with how many there are, so there are at
    most about the square root of 2 n distinct ones on a side. Each pair is a row, and tasks add up its overlaps.
    """

    def expected(batches):
        lg = np.vectorize(math.lgamma, otypes=[float])
        for g in batches:
            out = []
            for x, y, t, times in zip(g["x"].tolist(), g["y"].tolist(), g["t"].tolist(), g["times"].tolist(), strict=True):
                total, fixed = 0.0, math.lgamma(x + 1) + math.lgamma(y + 1) + math.lgamma(t - x + 1) + math.lgamma(t - y + 1) - math.lgamma(t + 1)
                # Overlaps further from the mean have no probability in double precision.
                mean, far = x * y / t, 40 * math.sqrt(x * y / t) + 400
                last = min(x, y, math.ceil(mean + far))
                for lo in range(max(1, x + y - t, math.floor(mean - far)), last + 1, 1 << 16):
                    k = np.arange(lo, min(lo + (1 << 16), last + 1), dtype=float)
                    total += float((k / t * np.log(t * k / (x * y)) * np.exp(fixed - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(t - x - y + k + 1))).sum())
                out.append(total * times)
            yield pd.DataFrame({"part": out})

    n = F.col("n").cast("long")
    margin = lambda c, x, m: table.groupBy(c).agg(F.sum(n).alias(x)).groupBy(x).agg(F.count("*").alias(m))
    a, b, t = margin("label", "x", "xs"), margin("cluster_id", "y", "ys"), table.agg(F.sum(n).alias("t"))
    both = a.crossJoin(b).crossJoin(t).withColumn("times", F.col("xs") * F.col("ys"))
    e = both.select("x", "y", "t", "times").repartition("x", "y").mapInPandas(expected, "part double").agg(F.sum("part").alias("e"))
    h = lambda rows, x, m: rows.crossJoin(t).agg((-F.sum(F.col(m) * F.col(x) / F.col("t") * F.log(F.col(x) / F.col("t")))).alias(f"h{x}"))
    joint = table.crossJoin(t).agg((-F.sum(n / F.col("t") * F.log(n / F.col("t")))).alias("h"))
    one = e.crossJoin(h(a, "x", "xs")).crossJoin(h(b, "y", "ys")).crossJoin(joint)
    mean = (F.col("hx") + F.col("hy")) / 2
    return one.select(F.when(F.abs(mean - F.col("e")) < 1e-15, 1.0).otherwise((F.col("hx") + F.col("hy") - F.col("h") - F.col("e")) / (mean - F.col("e"))).alias("ami"))


def _sampled(c: DataFrame, most: int | None) -> DataFrame:
    if most is None:
        return c
    w = Window.partitionBy("cluster_id").orderBy(F.xxhash64("row_idx"), "row_idx")
    return c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def intra_distance(c: DataFrame, most: int | None = None, metric: str = "euclidean", block: int = LEAST) -> DataFrame:
    """cluster_id, n, mean distance of pairs of members; null for one. most: of so many members, by hash, in larger clusters.

    Blocks of a cluster meet in pairs, and each pair returns one sum. Clusters of one block are dealt as they are.
    """
    rows = _sampled(c.filter(F.col("cluster_id") != NOISE), most).select(F.col("cluster_id").cast("string").alias("tree"), F.col("row_idx").alias("pos"), "embedding")
    sized = rows.join(rows.groupBy("tree").agg(F.count("*").alias("n")), "tree")

    def add(batches):
        for b in batches:
            for tree, lo, hi, left, right in zip(b["tree"], b["lo"], b["hi"], b["a"], b["b"], strict=True):
                d = distances(rows_of(left, "embedding"), rows_of(right, "embedding"), metric, None)
                k = len(d)
                yield pd.DataFrame({"tree": [tree], "s": [d.sum() - np.trace(d) if lo == hi else 2 * d.sum()], "m": [k * (k - 1) if lo == hi else 2 * d.size]})

    def tiled(batches):
        for batch in batches:
            for tree, one, two in zip(batch["tree"], batch["a"], batch["b"], strict=True):
                a, b = Rows(one), None if two is None else Rows(two)
                s = sum(d.sum() - np.trace(d, i.start - j.start) if b is None else 2 * d.sum() for i, j, d in measured(a, b, metric))
                yield pd.DataFrame({"tree": [tree], "s": [s], "m": [len(a) * (len(a) - 1) if b is None else 2 * len(a) * len(b)]})

    small, large = (sized.filter(x) for x in (F.col("n") <= block, F.col("n") > block))
    kind = "tree string, s double, m long"
    sums = block_pairs(small, block).mapInPandas(add, kind).unionByName(each_pair(packed(large, (), block)).mapInPandas(tiled, kind)).groupBy("tree").agg(F.try_divide(F.sum("s"), F.sum("m")).alias("mean_distance"))
    out = cluster_sizes(c).withColumn("tree", F.col("cluster_id").cast("string"))
    return out.join(sums, "tree", "left").drop("tree")


class Sums:
    """What rows sum up of their distances to a block, whose rows stand by cluster: s, to their own cluster's rows; best, the least mean of
    the other clusters that it holds whole; and the sums to those that it holds in part, which are its first and last at most.

    own: each row's cluster; clusters, members: of each of the block's rows, its cluster and how many rows that has in all.
    """

    def __init__(self, own: np.ndarray, clusters: np.ndarray, members: np.ndarray):
        self.own, (self.names, self.start, self.counts) = own, np.unique(clusters, return_index=True, return_counts=True)
        self.whole = self.counts == members[self.start]
        at = np.minimum(np.searchsorted(self.names, own), len(self.names) - 1)
        self.mine = np.where(self.names[at] == own, at, -1)
        self.s, self.best, self.open = np.zeros(len(own)), np.full(len(own), np.inf), {}

    def see(self, rows: slice, cols: slice, d: np.ndarray) -> None:
        """d: the distances of some rows to some of the block's."""
        k = np.arange(*(np.searchsorted(self.start, [cols.start, cols.stop - 1], "right") + [-1, 0]))
        starts = np.maximum(self.start[k], cols.start) - cols.start
        sums = d.sum(1)[:, None] if len(k) == 1 else np.add.reduceat(d, starts, axis=1)
        inside = self.whole[k] & (self.start[k] >= cols.start) & (self.start[k] + self.counts[k] <= cols.stop)
        for j in np.flatnonzero(~inside):
            self.open.setdefault(int(k[j]), np.zeros(len(self.own)))[rows] += sums[:, j]
        if inside.any():
            self.take(rows, k[inside], sums[:, inside])

    def take(self, rows: slice, k: np.ndarray, sums: np.ndarray) -> None:
        """sums: of rows, to all of the clusters k."""
        mine = self.mine[rows, None] == k
        self.s[rows] += np.where(mine, sums, 0).sum(1)
        self.best[rows] = np.minimum(self.best[rows], np.where(mine, np.inf, sums / self.counts[k]).min(1))

    def frames(self, row: np.ndarray):
        """row_idx (which row tells), own, other, s, m, best: own sums with best, then sums to parts of others, of m rows each."""
        every, parts = slice(None), []
        for k, sums in self.open.items():
            if self.whole[k]:
                self.take(every, np.array([k]), sums[:, None])
            else:
                self.s = np.where(self.mine == k, sums, self.s)
                parts.append((self.mine != k, k, sums))
        keep = (self.mine >= 0) | (self.best < np.inf)
        yield pd.DataFrame({"row_idx": row, "own": self.own, "other": self.own, "s": self.s, "m": np.where(self.mine >= 0, self.counts[self.mine], 0), "best": self.best})[keep]
        for keep, k, sums in parts:
            yield pd.DataFrame({"row_idx": row[keep], "own": self.own[keep], "other": self.names[k], "s": sums[keep], "m": self.counts[k], "best": np.inf})


def silhouette(c: DataFrame, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """One row: the mean silhouette of rows that aren't noise; null under 3 rows, under 2 clusters, or of single rows only.

    Blocks of rows in order of their clusters meet in pairs, so a block holds whole small clusters, or a part of a large one. Of what a
    block holds whole, a row needs only the nearest mean; others come as sums. So about n * n / 2**15 rows move and as many sums.
    """

    def add(batches):
        for batch in batches:
            for one, two in zip(batch["a"], batch["b"], strict=True):
                a, b = Rows(one), None if two is None else Rows(two)
                (own, all_), (other, all_other) = ((r.field("cluster_id"), r.field("members")) for r in (a, b or a))
                forth, back = Sums(own, other, all_other), None if b is None else Sums(other, own, all_)
                for i, j, d in measured(a, b, metric):
                    forth.see(i, j, d)
                    if back:
                        back.see(j, i, d.T)
                yield from forth.frames(a.pos)
                if back:
                    yield from back.frames(b.pos)

    with Steps(c.sparkSession) as steps:
        rows = c.filter(F.col("cluster_id") != NOISE).select("cluster_id", F.col("row_idx").alias("pos"), "embedding", F.lit("").alias("tree"))
        rows = rows.join(rows.groupBy("cluster_id").agg(F.count("*").alias("members")), "cluster_id")
        placed = numbered(rows, ["tree"], ["cluster_id", "pos"], steps, "place")
        part = each_pair(packed(placed, ("cluster_id", "members"), block, F.col("place"))).mapInPandas(add, "row_idx long, own long, other long, s double, m long, best double")
        each = part.groupBy("row_idx", "own", "other").agg(F.sum("s").alias("s"), F.sum("m").alias("m"), F.min("best").alias("best"))
        mine = F.col("own") == F.col("other")
        # A row's distance to itself is 0 and does not count.
        p = each.groupBy("row_idx").agg(F.max(F.when(mine & (F.col("m") > 1), F.col("s") / (F.col("m") - 1))).alias("a"), F.least(F.min("best"), F.coalesce(F.min(F.when(~mine & (F.col("m") > 0), F.col("s") / F.col("m"))), F.lit(float("inf")))).alias("b"))
        one = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
        n = cluster_sizes(c).agg(F.sum("n").alias("rows"), F.count("*").alias("k"))
        out = p.agg(F.avg(one).alias("s")).crossJoin(n).select(F.when((F.col("rows") >= 3) & (F.col("k") >= 2) & (F.col("k") < F.col("rows")), F.col("s")).alias("silhouette"))
        return steps.keep(out)


def density_validity(c: DataFrame, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """cluster_id, n, sparseness, separation, validity, weight of each cluster of two and more rows: density-based validity.

    c: row_idx, cluster_id, embedding. Within a cluster, a row's core is the power mean of exponent -dims of its distances
    (equal rows don't count), and edges weigh the larger of distance and both cores. sparseness: the heaviest edge of the lightest
    tree between nodes of more than one edge (of all, if there is none). separation: the lightest edge from such nodes to
    another cluster's. validity: (separation - sparseness) over the larger; null with one cluster. weight: the share of all
    rows, noise too; the index of the clustering is the weighted sum.
    """

    def powers(batches):
        for batch in batches:
            for tree, lo, hi, left, right in zip(batch["tree"], batch["lo"], batch["hi"], batch["a"], batch["b"], strict=True):
                x, y = rows_of(left, "embedding"), rows_of(right, "embedding")
                p = inverse_powers(distances(x, y, metric), x.shape[1])
                for rows, m in ((left, p),) if lo == hi else ((left, p), (right, p.T)):
                    yield pd.DataFrame({"tree": tree, "pos": [r["pos"] for r in rows], "p": m.sum(1)})

    with Steps(c.sparkSession) as steps:
        whole = c.agg(F.count("*").alias("rows"))
        rows = c.filter(F.col("cluster_id") != NOISE).select(F.col("cluster_id").cast("string").alias("tree"), "row_idx", "embedding")
        # Points are numbered within their cluster: merges of its tree have the numbers from n on.
        points = steps.cut(numbered(rows, ["tree"], ["row_idx"], steps, "pos").filter("n > 1").drop("row_idx"))
        small, large = (points.filter(x) for x in (F.col("n") <= 2 * block, F.col("n") > 2 * block))
        mass = block_pairs(small, block).mapInPandas(powers, "tree string, pos long, p double").unionByName(power_sums(large, metric, block)).groupBy("tree", "pos").agg(F.sum("p").alias("p"))
        cored = points.join(mass, ["tree", "pos"])
        dims = F.size("embedding")
        core = F.when(F.col("p") > 0, F.pow(F.col("p") / (F.col("n") - 1), -1.0 / dims)).otherwise(0.0)
        cored = steps.cut(cored.withColumn("core", F.round(core, 6)).withColumn("cores", F.array("core")).drop("p"))
        edges = steps.cut(spanning_trees(cored.drop("core"), steps, [""], metric, block))
        ends = edges.select("tree", F.explode(F.array("a", "b")).alias("pos")).groupBy("tree", "pos").agg(F.count("*").alias("k"))
        inner = steps.cut(ends.withColumn("inner", F.col("k") > 1).withColumn("none", ~F.max("inner").over(Window.partitionBy("tree"))).filter(F.col("inner") | F.col("none")).select("tree", "pos"))
        side = lambda x: inner.select("tree", F.col("pos").alias(x), F.lit(True).alias(f"_{x}"))
        marked = edges.join(side("a"), ["tree", "a"], "left").join(side("b"), ["tree", "b"], "left")
        inside = F.max(F.when(F.col("_a") & F.col("_b"), F.col("w")))
        sparse = marked.groupBy("tree").agg(F.coalesce(inside, F.max("w")).alias("sparseness"))
        # All clusters as one tree, of which each is a part: the lightest edges that leave the parts. Rows have other numbers there.
        least = points.agg(F.min(F.col("tree").cast("long"))).first()[0] or 0
        parts = cored.join(inner, ["tree", "pos"]).select(F.lit("").alias("tree"), (F.col("tree").cast("long") - least).alias("part"), F.col("pos").alias("_pos"), "embedding", "core")
        kept = numbered(parts, ["tree"], ["part", "_pos"], steps, "pos")
        apart = leaving_edges(kept, block, metric).groupBy((F.col("part") + least).alias("cluster_id")).agg(F.min("w").alias("separation"))
        size = points.select("tree", "n").distinct()
        j = size.join(sparse, "tree").withColumn("cluster_id", F.col("tree").cast("long")).join(apart, "cluster_id", "left").crossJoin(F.broadcast(whole))
        far = F.col("separation")
        return steps.keep(j.select("cluster_id", "n", "sparseness", far, F.try_divide(far - F.col("sparseness"), F.greatest(far, "sparseness")).alias("validity"), (F.col("n") / F.col("rows")).alias("weight")))


def sweep_score(noise, prob, largest, k, n, nmi=None, ari=None):
    """The grid search's score of a clustering, as a column."""
    giant = F.greatest(F.lit(0.0), (largest - 0.12) * 2)
    many = F.when(k <= 1, 0.25).otherwise(0.0) + F.when(k > F.greatest(F.lit(2), F.floor(F.sqrt(F.greatest(n, F.lit(1)))) * 3), 0.15).otherwise(0.0)
    out = (1 - noise) + 0.2 * prob - giant - many
    for weight, x in ((0.5, nmi), (0.3, ari)):
        if x is not None:
            out = out + weight * F.coalesce(x, F.lit(0.0))
    return out


def coarse_metrics(c: DataFrame, min_cluster_size: int, selection: str) -> DataFrame:
    """One row of metrics for clusterings into about two, with invalid and reject_reason, the score (-inf if invalid) and what it would be otherwise.

    prob is the mean over rows that aren't noise. Without rows, all are taken for noise.
    """
    one = c.sparkSession.createDataFrame([(0, min_cluster_size, selection)], "config int, min_cluster_size int, selection_method string")
    return coarse_metrics_by(c.withColumn("config", F.lit(0)), one).drop("config")


def coarse_metrics_by(c: DataFrame, configs: DataFrame) -> DataFrame:
    """coarse_metrics of each of configs (config, min_cluster_size, selection_method); c: config, cluster_id, prob."""
    sizes = c.filter(F.col("cluster_id") != NOISE).groupBy("config", "cluster_id").agg(F.count("*").alias("n"))
    shares = sizes.join(sizes.groupBy("config").agg(F.sum("n").alias("t")), "config").join(configs.select("config", "min_cluster_size"), "config").withColumn("p", F.col("n") / F.col("t"))
    # Each cluster's share, and of these the two largest, found in parts before they meet.
    parts = shares.groupBy("config", F.pmod(F.xxhash64("cluster_id"), F.lit(64)).alias("part")).agg(F.slice(F.reverse(F.array_sort(F.collect_list("p"))), 1, 2).alias("top"))
    second = parts.groupBy("config").agg(F.flatten(F.collect_list("top")).alias("top")).select("config", F.try_element_at(F.reverse(F.array_sort("top")), F.lit(2)).alias("second"))
    a = shares.groupBy("config").agg(F.count("*").alias("k"), F.max("p").alias("largest"), F.sum(-F.col("p") * F.log("p")).alias("h"), F.count_if(F.col("n") < F.col("min_cluster_size")).alias("small_cluster_count")).join(second, "config")
    b = c.groupBy("config").agg(F.avg((F.col("cluster_id") == NOISE).cast("int")).alias("noise"), F.avg(F.when(F.col("cluster_id") != NOISE, F.col("prob"))).alias("prob"))
    m = configs.join(a, "config", "left").join(b, "config", "left").fillna(0, ["k", "small_cluster_count"]).fillna(0.0, ["largest", "h", "second", "prob"]).fillna(1.0, ["noise"])
    k, largest, noise = F.col("k"), F.col("largest"), F.col("noise")
    m = m.withColumns({"entropy": F.when(k > 1, F.col("h") / F.log(k)).otherwise(0.0), "effective": F.when(k > 0, F.exp("h")).otherwise(0.0), "giant": F.greatest(F.lit(0.0), (largest - 0.55) / 0.15), "many": F.greatest(F.lit(0.0), F.abs(k - 2) - 0.5), "fragmentation": F.greatest(F.lit(0.0), (k - 6) / 10)})
    # The reasons that reports name.
    reasons = {"n_clusters<=1": k <= 1, "noise_ratio>0.10": noise > 0.10, "largest_cluster_fraction>0.70": largest > 0.70, "second_largest_cluster_fraction<0.15": F.col("second") < 0.15, "effective_num_clusters<1.8": F.col("effective") < 1.8}
    m = m.withColumn("reject_reason", F.concat_ws(";", *(F.when(v, n) for n, v in reasons.items())))
    score = 1.5 * F.least(F.col("second") / 0.4, F.lit(1.0)) + 1.2 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("effective") - 2)) + 0.8 * F.col("entropy") + 0.6 * (1 - noise) + 0.4 * F.col("prob")
    score = score + 0.3 * F.least(F.col("min_cluster_size") / 40, F.lit(1.0)) + F.when(F.col("selection_method") == "eom", 0.2).otherwise(0.0) - 1.2 * F.col("giant") - 0.3 * F.col("many")
    m = m.withColumn("invalid", F.col("reject_reason") != "").withColumn("unrejected_score", score).withColumn("score", F.when(F.col("reject_reason") != "", float("-inf")).otherwise(score))
    return m.drop("h", "min_cluster_size", "selection_method")


def weighted_distance(report: DataFrame, *by: str) -> DataFrame:
    """by, mean_distance: of the clusters in report (n, mean_distance), weighted by size; those without a distance don't count."""
    n = F.when(F.col("mean_distance").isNotNull() & ~F.isnan("mean_distance"), F.col("n"))
    return report.groupBy(*by).agg(F.try_divide(F.sum(n * F.col("mean_distance")), F.sum(n)).alias("mean_distance"))
