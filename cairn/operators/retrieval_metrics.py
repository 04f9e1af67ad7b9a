"""Evaluation of neighbour lists (query_id, neighbor_id, rank) against labels and groups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.identity import adjacent_groups, pick_column


def ranked(knn: DataFrame) -> DataFrame:
    """query_id, neighbor_id, rank: columns by their aliases; without a rank, by distance, or score from the highest, or row order.

    Row order is that of _file and _row, which read_neighbors gives; a table without them has the order in which it is read.
    Ranks that aren't numbers are dropped; the first of repeated pairs stays.
    """
    q, n = pick_column(knn.columns, "query"), pick_column(knn.columns, "neighbor")
    r, d, s = (pick_column(knn.columns, role, required=False) for role in ("rank", "distance", "score"))
    number = lambda c: F.col(c).try_cast("double")
    place = F.struct("_file", "_row") if {"_file", "_row"} <= set(knn.columns) else F.struct(F.monotonically_increasing_id())
    order: Column = number(r) if r else number(d) if d else -number(s) if s else F.lit(0.0)
    x = knn.select(F.trim(F.col(q).cast("string")).alias("query_id"), F.trim(F.col(n).cast("string")).alias("neighbor_id"), order.alias("_o"), place.alias("_i"))
    x = x.filter("_o IS NOT NULL AND NOT isnan(_o)")
    first = Window.partitionBy("query_id", "neighbor_id").orderBy("_o", "_i")
    x = x.withColumn("_f", F.row_number().over(first)).filter("_f = 1")
    place = F.col("_o").cast("int") if r else F.row_number().over(Window.partitionBy("query_id").orderBy("_o", "_i"))
    return x.withColumn("rank", place.cast("long")).select("query_id", "neighbor_id", "rank")


def matched(knn: DataFrame, labels: DataFrame, missing: str = "drop") -> DataFrame:
    """knn with query_label, neighbor_label, match. missing: drop rows where either is null, or let two nulls be equal."""
    q = labels.select(F.col("id").alias("query_id"), F.col("label").alias("query_label"))
    n = labels.select(F.col("id").alias("neighbor_id"), F.col("label").alias("neighbor_label"))
    both = knn.join(q, "query_id", "left").join(n, "neighbor_id", "left")
    if missing == "drop":
        both = both.filter("query_label IS NOT NULL AND neighbor_label IS NOT NULL")
    return both.withColumn("match", F.col("query_label").eqNullSafe(F.col("neighbor_label")).cast("int"))


def rate_at_k(rows: DataFrame, ks: list[int]) -> DataFrame:
    """query_id, query_label, topk, rate: matches in the first k ranks, by k (places without a row don't match)."""
    k = rows.sparkSession.createDataFrame([(x,) for x in sorted(set(ks))], "topk int")
    hits = F.sum(F.when(F.col("rank") <= F.col("topk"), F.col("match")).otherwise(0))
    return rows.crossJoin(F.broadcast(k)).groupBy("query_id", "query_label", "topk").agg((hits / F.col("topk")).alias("rate"))


def rate_of_rows(rows: DataFrame) -> DataFrame:
    """query_id, query_label, rate: matches by rows that are there."""
    return rows.groupBy("query_id", "query_label").agg(F.avg("match").alias("rate"))


def describe(rates: DataFrame, *by: str, value: str = "rate") -> DataFrame:
    """Count, mean, sample deviation (0 for one row), least, quartiles and greatest of value, for each group."""
    q = lambda p: F.percentile(value, p)
    aggs = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max(value).alias("max")]
    return rates.groupBy(*by).agg(*aggs)


def macro_mean(rows: DataFrame, k: int) -> DataFrame:
    """fusion_mode, n_labels, mean: rates by query, then by label (null labels too), then by mode."""
    per_query = rows.filter(F.col("rank") <= k).groupBy("fusion_mode", "query_id", "query_label").agg(F.avg("match").alias("rate"))
    per_label = per_query.groupBy("fusion_mode", "query_label").agg(F.count("*").alias("n_queries"), F.avg("rate").alias("mean"))
    return per_label.groupBy("fusion_mode").agg(F.count("*").alias("n_labels"), F.avg("mean").alias("mean"))


def prefilter_recall(items: DataFrame) -> DataFrame:
    """id, peers, recall_same, recall_adjacent: of the others with its label, those in its group, or in that or an adjacent one.

    items: id (unique), label, pregroup_id. Counts stand in for the self-join; null without peers.
    """
    count = items.groupBy("label", "pregroup_id").agg(F.count("*").alias("n"))
    peers = items.groupBy("label").agg((F.count("*") - 1).alias("peers"))
    near = items.select("id", "label", "pregroup_id", F.explode(F.array_union(F.array("pregroup_id"), adjacent_groups(F.col("pregroup_id")))).alias("g"))
    hits = near.join(count.select("label", F.col("pregroup_id").alias("g"), "n"), ["label", "g"], "left").groupBy("id", "label").agg((F.sum(F.when(F.col("g") == F.col("pregroup_id"), F.col("n")).otherwise(0)) - 1).alias("same"), (F.sum(F.coalesce("n", F.lit(0))) - 1).alias("close"))
    out = hits.join(peers, "label")
    share = lambda c: F.when(F.col("peers") > 0, F.col(c) / F.col("peers"))
    return out.select("id", "peers", share("same").alias("recall_same"), share("close").alias("recall_adjacent"))


def prefilter_purity(items: DataFrame) -> DataFrame:
    """pregroup_id, n, n_labels, dominant_label (ties: the smallest), dominant_ratio, fraction of all rows."""
    t = items.groupBy("pregroup_id", "label").agg(F.count("*").alias("k"))
    best = F.min(F.struct((-F.col("k")).alias("m"), "label"))
    g = t.groupBy("pregroup_id").agg(F.sum("k").alias("n"), F.count("*").alias("n_labels"), best["label"].alias("dominant_label"), (-best["m"] / F.sum("k")).alias("dominant_ratio"))
    return g.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def query_set_differences(knn: DataFrame) -> DataFrame:
    """fusion_mode, missing: how many of all modes' queries each mode lacks."""
    pairs = knn.select("fusion_mode", "query_id").distinct()
    every = pairs.select("fusion_mode").distinct().crossJoin(pairs.select("query_id").distinct())
    lacks = every.join(pairs, ["fusion_mode", "query_id"], "left_anti").groupBy("fusion_mode").agg(F.count("*").alias("missing"))
    return pairs.select("fusion_mode").distinct().join(lacks, "fusion_mode", "left").select("fusion_mode", F.coalesce("missing", F.lit(0)).alias("missing"))


def compare(reports: dict[str, DataFrame], keys: list[str], value: str = "mean") -> DataFrame:
    """One value column for each report, joined on keys; rows of any report stay."""
    out = None
    for name, df in reports.items():
        one = df.select(*keys, F.col(value).alias(name))
        out = one if out is None else out.join(one, keys, "full")
    return out


def ablation(rates: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """by, n_rows, mean, delta, n_worse: configurations against the baseline of each label, best first.

    rates: by, label, rate. baseline: label, rate. Null parameters are values like others.
    """
    per = rates.groupBy(*by, "label").agg(F.count("*").alias("n"), F.avg("rate").alias("m"))
    base = baseline.groupBy("label").agg(F.avg("rate").alias("b"))
    d = per.join(base, "label", "left").withColumn("d", F.col("m") - F.col("b"))
    out = d.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.avg("m").alias("mean"), F.avg("d").alias("delta"), F.count_if(F.col("d") < -1e-9).alias("n_worse"))
    return out.orderBy(F.desc("mean"), F.desc("delta"), "n_worse", *by)


def describe_percent(rates: DataFrame, *by: str, value: str = "rate") -> DataFrame:
    """describe() with the sample variance (0 for one row), and mean and deviation in percent."""
    var = rates.groupBy(*by).agg(F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"))
    return describe(rates, *by, value=value).join(var, list(by)).withColumns({"mean_percent": F.col("mean") * 100, "std_percent": F.col("std") * 100})


def prefilter_totals(items: DataFrame, *by: str) -> DataFrame:
    """by, n, n_groups, weighted_purity, reduction: of all rows, or for each method in by.

    items: label, pregroup_id and by. The purity is the share of rows with their group's most frequent label; reduction
    is 1 less the groups' mean share of the rows. Null labels and groups are values like others; without rows, both are 0.
    """
    t = items.groupBy(*by, "pregroup_id", "label").agg(F.count("*").alias("k"))
    g = t.groupBy(*by, "pregroup_id").agg(F.sum("k").alias("n"), F.max("k").alias("most"))
    out = g.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("n_groups"), F.sum("most").alias("most"))
    purity, reduction = F.try_divide("most", "n"), 1 - 1 / F.nullif(F.col("n_groups"), F.lit(0))
    return out.select(*by, "n", "n_groups", F.coalesce(purity, F.lit(0.0)).alias("weighted_purity"), F.coalesce(reduction, F.lit(0.0)).alias("reduction"))


def counts_by(rows: DataFrame, by: str, item: str) -> DataFrame:
    """by, n_rows, n_distinct: rows, and different items of which null is one."""
    null = F.bool_or(F.col(item).isNull()).cast("long")
    return rows.groupBy(by).agg(F.count("*").alias("n_rows"), (F.count_distinct(item) + null).alias("n_distinct"))


def first_k(rows: DataFrame, k: int | None, order: list[str], by: tuple[str, ...] = ("fusion_mode", "query_id")) -> DataFrame:
    """Rows of rank k at most, by the first of rank_final, rank, neighbor_rank; without these, the first k by order of each group. None: all."""
    if k is None:
        return rows
    rank = next((c for c in ("rank_final", "rank", "neighbor_rank") if c in rows.columns), None)
    if rank:
        return rows.filter(F.col(rank).cast("double") <= k)
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_place") <= k).drop("_place")


def candidate_ratio(counts: DataFrame) -> DataFrame:
    """One row: n, candidates, ratio of candidates to all ordered pairs of items. counts: a row for each item, n its candidates.

    Without items the ratio is 1.
    """
    c = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))
    every = F.col("n") * (F.col("n") - 1)
    return c.withColumn("ratio", F.when(F.col("n") < 1, 1.0).otherwise(F.col("candidates") / F.greatest(every, F.lit(1))))
