"""Settings of the size fusion tried side by side: one candidate search serves the whole grid and the baseline of shape alone."""

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.retrieval_metrics import matched
from cairn.operators.routing import size_distance, top

# The features that a size may be, those that are decimal logarithms, and names that stand for others.
FEATURES = ("log_size_scalar", "aspect_xy", "elongation_12", "flatness_ratio", "bbox_longest", "log_bbox_longest", "bbox_volume", "log_bbox_volume", "apparent_size_proxy", "apparent_size_volume_proxy")
LOGARITHMS = ("log_size_scalar", "log_bbox_longest", "log_bbox_volume", "apparent_size_proxy", "apparent_size_volume_proxy")
ALIASES = {"apparent_size_proxy": "log_bbox_longest", "apparent_size_volume_proxy": "log_bbox_volume"}
MODES = ("plain_distance", "ratio_penalty", "margin_gate")
#: What names a setting.
SETTING = ["size_feature", "size_penalty_mode", "lambda_size"]


def grid(features: list[str], modes: list[str], weights: list[float]) -> list[tuple[str, str, float]]:
    """All settings (feature, mode, weight), in order, each once. Unknown names and an empty list are errors."""
    for name, given, known in (("size feature", features, FEATURES), ("penalty mode", modes, MODES)):
        if unknown := [x for x in given if x not in known]:
            raise ValueError(f"unknown {name} {unknown}; there are {known}")
    if not (features and modes and weights):
        raise ValueError("a grid needs a feature, a mode and a weight")
    return list(dict.fromkeys((f, m, float(w)) for f, m, w in product(features, modes, weights)))


def _percentile(x: Column, p: float) -> Column:
    """Of a sorted array, exact, between its neighbours; null if it is empty."""
    at = (F.size(x) - 1) * p
    low, high = F.get(x, F.floor(at).cast("int")), F.get(x, F.ceil(at).cast("int"))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def _scale(x: Column, how: str, least: float = 1e-8) -> Column:
    """base, span: what `routing.normalized` takes from a list and divides it by; x holds the list's finite numbers, sorted."""
    base, span = F.lit(0.0), F.lit(1.0)
    if how == "zscore":
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
        deviation = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.size(x))
        span = F.when(deviation > least, deviation).otherwise(1.0)
    elif how == "minmax":
        base, width = F.array_min(x), F.array_max(x) - F.array_min(x)
        span = F.when(width > least, width).otherwise(float("inf"))
    elif how != "none":
        iqr, median = _percentile(x, 0.75) - _percentile(x, 0.25), _percentile(x, 0.5)
        span = F.when(iqr > least, iqr).when(median > least, median).otherwise(1.0)
    return F.struct(base.alias("base"), span.alias("span"))


def grid_ranked(pairs: DataFrame, sizes: DataFrame, settings: list[tuple[str, str, float]], k: int = 10, rerank: int = 50, norm: str = "robust", threshold: float = 1.5, penalty: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """size_feature, size_penalty_mode, lambda_size, query_idx, candidate_idx, distance_final, rank_final: the k best of each
    query's rerank nearest under each setting, by distance + weight * size; and the k nearest under (baseline, baseline, 0).

    pairs: query_idx, candidate_idx, distance, and carry, which the result has too. sizes: row_idx and the features, one row an
    item; a size that is missing or not finite adds nothing. A query's rerank pairs are one array, so sizes, their scales and
    the ranks of all settings need no rows, shuffles or sorts of their own.
    """
    columns = sorted({ALIASES.get(f, f) for f, _, _ in settings})
    finite = [F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double")).alias(c) for c in columns]
    s = sizes.select("row_idx", F.struct(*finite).alias("_s"))
    first = top(pairs.select("query_idx", "candidate_idx", "distance", *carry), rerank, rank="rank_shape")
    listed = first.join(s.toDF("candidate_idx", "_c"), "candidate_idx", "left").groupBy("query_idx").agg(F.sort_array(F.collect_list(F.struct("rank_shape", "candidate_idx", "distance", "_c", *carry))).alias("_p"))
    both = listed.join(s.toDF("query_idx", "_q"), "query_idx", "left")

    def raw(feature: str, mode: str):
        name = ALIASES.get(feature, feature)
        logs = feature in LOGARITHMS

        def of(e):
            q, c = F.col("_q")[name], e["_c"][name]
            if mode == "plain_distance":
                return size_distance(q, c, "plain")
            return size_distance(*((q, c) if logs else (F.abs(q), F.abs(c))), mode, threshold, penalty, logs)

        return F.transform("_p", of)

    kinds = list(dict.fromkeys((f, m) for f, m, _ in settings))
    weights = {kind: [w for f, m, w in settings if (f, m) == kind] for kind in kinds}
    each = [F.struct(F.lit(f).alias("size_feature"), F.lit(m).alias("size_penalty_mode"), F.array(*map(F.lit, weights[f, m])).alias("_w"), raw(f, m).alias("_raw")) for f, m in kinds]
    # The baseline is one more kind, whose size is 0: all lists come of one pass over the pairs.
    each.append(F.struct(F.lit("baseline").alias("size_feature"), F.lit("baseline").alias("size_penalty_mode"), F.array(F.lit(0.0)).alias("_w"), F.transform("_p", lambda e: F.lit(0.0)).alias("_raw")))
    out = both.select("query_idx", "_p", F.explode(F.array(*each)).alias("e")).select("query_idx", "_p", "e.*")
    known = lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))
    out = out.withColumn("_x", F.array_sort(F.filter("_raw", known))).withColumn("_scale", _scale(F.col("_x"), norm)).withColumn("lambda_size", F.explode("_w"))

    def final(e, i):
        v = F.get("_raw", i)
        size = (F.when(known(v), v) - F.col("_scale.base")) / F.col("_scale.span")
        size = F.coalesce(F.when(known(size), size), F.lit(0.0))
        return F.struct(F.round(e["distance"] + F.col("lambda_size") * size, 6).alias("distance_final"), e["rank_shape"].alias("rank_shape"), e["candidate_idx"].alias("candidate_idx"), *(e[c].alias(c) for c in carry))

    best = F.slice(F.sort_array(F.transform("_p", final)), 1, k)
    out = out.select(*SETTING, "query_idx", F.posexplode(best).alias("_at", "e"))
    return out.select(*SETTING, "query_idx", "e.candidate_idx", "e.distance_final", (F.col("_at") + 1).cast("long").alias("rank_final"), *(f"e.{c}" for c in carry))


def grid_rates(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """The setting, query_id, query_label and rate of each query: the share of its neighbours that have its label (two nulls are equal).

    ranked: the setting, query_id, neighbor_id; or, carried from pairs that were matched before they were ranked, query_id,
    query_label, match, so that only pairs are joined and not each setting's lists. labels: id, label.
    """
    return (ranked if "match" in ranked.columns else matched(ranked, labels, "equal")).groupBy(*SETTING, "query_id", "query_label").agg(F.avg("match").alias("rate"))


def grid_overall(rates: DataFrame) -> DataFrame:
    """The setting, n_queries, mean_match_rate, std_match_rate (0 for one query) over queries, the baseline too."""
    return rates.groupBy(*SETTING).agg(F.count("*").alias("n_queries"), F.avg("rate").alias("mean_match_rate"), F.coalesce(F.stddev_samp("rate"), F.lit(0.0)).alias("std_match_rate"))


def grid_by_label(rates: DataFrame) -> DataFrame:
    """The setting, query_label, n_queries, mean_match_rate, and the baseline's mean and the distance from it; null labels are one label."""
    each = rates.groupBy(*SETTING, "query_label").agg(F.count("*").alias("n_queries"), F.avg("rate").alias("mean_match_rate"))
    base = each.filter("size_feature = 'baseline'").select(F.col("query_label").alias("_l"), F.col("mean_match_rate").alias("baseline_mean_match_rate"))
    joined = each.filter("size_feature <> 'baseline'").join(base, F.col("query_label").eqNullSafe(F.col("_l")), "left").drop("_l")
    return joined.withColumn("delta_mean_match_rate", F.col("mean_match_rate") - F.col("baseline_mean_match_rate"))


def grid_best(rates: DataFrame) -> DataFrame:
    """The settings by place, 1 the best: greatest mean, then least labels that are worse than the baseline; ties by the setting.

    With grid_overall's columns, delta_mean_match_rate and n_category_worse (by over 1e-9). rates are read several times: a table.
    """
    overall = grid_overall(rates)
    base = overall.filter("size_feature = 'baseline'").select(F.col("mean_match_rate").alias("_b"))
    worse = grid_by_label(rates).groupBy(*SETTING).agg(F.count_if(F.col("delta_mean_match_rate") < -1e-9).alias("n_category_worse"))
    rows = overall.filter("size_feature <> 'baseline'").join(F.broadcast(base)).join(worse, SETTING).withColumn("delta_mean_match_rate", F.col("mean_match_rate") - F.col("_b")).drop("_b")
    # One row for each setting, as many as the caller listed.
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("mean_match_rate", 9)), "n_category_worse", *SETTING)))
