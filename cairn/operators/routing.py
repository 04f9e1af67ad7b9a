"""Candidates by group, and retrieval that re-ranks by fused distances."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.identity import adjacent_groups
from cairn.functions.vectors import cosine_distance, doubles, euclidean
from cairn.operators.knn import knn, knn_within

#: Ids in a block; what is joined and dealt to tasks is blocks, not ids. Candidates that follow each other for all queries of a block:
#: so short a cycle of ids, whole bytes of any width, is what column files pack best.
BLOCK, CYCLE = 2048, 128


def _least(pool_k: int, multiplier: float) -> int:
    return max(pool_k, math.ceil(pool_k * max(multiplier, 1)))


def _keyed(items: DataFrame) -> DataFrame:
    """row_idx, pregroup_id, g: a key that is never null; "" is for items in no group."""
    return items.select("row_idx", "pregroup_id", F.coalesce(F.concat(F.lit("="), "pregroup_id"), F.lit("")).alias("g"))


def _sizes(i: DataFrame) -> DataFrame:
    return i.groupBy("g", "pregroup_id").agg(F.count("*").alias("size"))


def _near(strategy: str):
    return adjacent_groups(F.col("pregroup_id")) if strategy == "adjacent" else F.array().cast("array<string>")


def _fill(i: DataFrame, sizes: DataFrame, least: int, strategy: str, known_first: bool) -> DataFrame:
    """g, candidate_idx, tier: what queries of each group with under least others take besides these.

    Of each group only the first least items by row_idx matter; of a neighbouring group, as many as those before it leave.
    The rest comes from the first items overall: a group and its neighbours can shut out only so many of them.
    """
    first = i.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("row_idx"))).filter(F.col("place") <= least)
    small = sizes.filter((F.col("g") != "") & (F.col("size") - 1 < least)).withColumn("near", F.filter(_near(strategy), lambda x: x.isNotNull()))
    step = small.select("g", F.posexplode("near").alias("at", "name"), (F.col("size") - 1).alias("own")).withColumn("of", F.concat(F.lit("="), "name"))
    step = step.join(sizes.select(F.col("g").alias("of"), F.col("size").alias("there")), "of", "left").fillna(0, ["there"])
    earlier = F.coalesce(F.sum("there").over(Window.partitionBy("g").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = step.withColumn("take", F.greatest(F.lit(0), F.least("there", least - F.col("own") - earlier)))
    near = step.filter("take > 0").join(first.select(F.col("g").alias("of"), "place", "row_idx"), "of").filter("place <= take").select("g", F.col("row_idx").alias("candidate_idx"), (F.col("at") + 1).cast("int").alias("tier"))
    got = step.groupBy("g").agg(F.sum("take").alias("got"))
    need = small.join(got, "g", "left").withColumn("need", least - (F.col("size") - 1) - F.coalesce("got", F.lit(0))).filter("need > 0").select("g", "near", "need")
    known = first.filter("g <> ''") if known_first else first
    # least of them stay after any five groups are left out; both lists are of a fixed length.
    head = known.orderBy("row_idx").limit(6 * least).select("g", "row_idx", F.lit(4).alias("tier"))
    if known_first:
        head = head.unionByName(first.filter("g = ''").select("g", "row_idx", F.lit(5).alias("tier")))
    list_ = head.agg(F.sort_array(F.collect_list(F.struct("tier", "row_idx", "g"))).alias("list"))
    rest = need.join(F.broadcast(list_)).withColumn("left", F.filter("list", lambda x: (x["g"] != F.col("g")) & ~F.array_contains(F.transform("near", lambda n: F.concat(F.lit("="), n)), x["g"])))
    rest = rest.select("g", F.explode(F.slice("left", F.lit(1), F.col("need").cast("int"))).alias("x")).select("g", F.col("x.row_idx").alias("candidate_idx"), F.col("x.tier").alias("tier"))
    return near.unionByName(rest)


def _parts(items: DataFrame, mode: str, strategy: str, pool_k: int, multiplier: float, known_first: bool) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """Keyed items; (query_idx, g) of queries that take their whole group; what these take besides; (query_idx, near) of those that take all."""
    i = _keyed(items)
    sizes = _sizes(i)
    q = i.join(sizes.select("g", "size"), "g").select(F.col("row_idx").alias("query_idx"), "g", "pregroup_id", "size")
    everything = F.lit(True) if mode == "off" else (F.col("g") == "") | (F.lit(mode == "strict") & (F.col("size") < 2))
    grouped_ = q.filter(~everything).select("query_idx", "g")
    fill = _fill(i, sizes, _least(pool_k, multiplier), strategy, known_first) if mode == "soft" else None
    return i, grouped_, fill, q.filter(everything).select("query_idx", "g", "pregroup_id")


def _blocks(rows: DataFrame, name: str, block: int) -> tuple[DataFrame, DataFrame]:
    """key, n_{name}: how many blocks the rows (key, x) of a key have; key, {name}_at, {name}: each block, an array of about block x."""
    n = rows.groupBy("key").agg(F.ceil(F.count("*") / block).alias(f"n_{name}"))
    at = F.pmod(F.xxhash64("x"), F.col(f"n_{name}")).alias(f"{name}_at")
    return n, rows.join(n, "key").groupBy("key", at).agg(F.collect_list("x").alias(name))


def _crossed(queries: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """query, candidate: x of each of queries with x of each of rows of the same key. queries, rows: key, x.

    Pairs of blocks are dealt over all tasks, however few the keys; only then do they become pairs, which no join or shuffle carries.
    """
    (n_q, q), (n_c, c) = _blocks(queries, "q", block), _blocks(rows, "c", block)
    for name, n in (("q", n_q), ("c", n_c)):
        places = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{name}") - 1)).alias(f"{name}_at")
        met = n.select("key", places) if name == "q" else met.join(n, "key").select("key", "q_at", places)
    # By number: blocks are small beside their pairs, and tasks must not be merged by the size of what they read.
    tasks = 8 * rows.sparkSession.sparkContext.defaultParallelism
    dealt = met.join(q, ["key", "q_at"]).join(c, ["key", "c_at"]).repartition(tasks, "key", "q_at", "c_at")
    cycles = F.transform(F.sequence(F.lit(0), F.floor((F.size("c") - 1) / CYCLE).cast("int")), lambda k: F.slice("c", k * CYCLE + 1, F.lit(CYCLE)))
    # One generated loop keeps all that it makes of a row; coalesce (of as many tasks) ends the first, so that is a block and not its square.
    dealt = dealt.select("q", F.explode(cycles).alias("c")).coalesce(tasks).select("c", F.explode("q").alias("query"))
    return dealt.coalesce(tasks).select("query", F.explode("c").alias("candidate"))


def candidates(items: DataFrame, mode: str = "soft", strategy: str = "adjacent", pool_k: int = 10, multiplier: float = 2.0, known_first: bool = True, block: int = BLOCK) -> DataFrame:
    """query_idx, candidate_idx, tier. items: row_idx, pregroup_id (null: not in the table, group "-1").

    Tiers: 0 the query's group, 1 to 3 its adjacent groups in order, 4 others in the table, 5 the rest (4 too, unless
    known_first). A group with at least pool_k * multiplier others is kept whole and alone; else tiers fill up to that
    number in order of row_idx. mode strict keeps tier 0, or everything if that is empty; off keeps everything, as do
    queries that aren't in the table. Lists of everything are as long as the table: candidate_counts and nearest need none.
    """
    i, own, fill, all_ = _parts(items, mode, strategy, pool_k, multiplier, known_first)
    ids = lambda q, c, tier: (F.col(q).alias("query_idx"), F.col(c).alias("candidate_idx"), tier.cast("int").alias("tier"))
    named = lambda rows, key, x: rows.select(key.alias("key"), x.alias("x"))
    g, one = F.col("g"), F.lit("")
    out = _crossed(named(own, g, F.col("query_idx")), named(i, g, F.col("row_idx")), block)
    # Queries in no group, and all of mode off, take everything as their own group.
    alone = (g != "") & F.lit(mode == "strict")
    out = out.unionByName(_crossed(named(all_.filter(~alone), one, F.col("query_idx")), named(i, one, F.col("row_idx")), block))
    out = out.select(*ids("query", "candidate", F.lit(0)))
    if fill is not None:
        out = out.unionByName(own.join(fill, "g").select("query_idx", "candidate_idx", "tier"))
    if mode == "strict":
        q, c = F.struct("query_idx", _near(strategy).alias("near")), F.struct("row_idx", "g", "pregroup_id")
        place = F.array_position("query.near", F.col("candidate.pregroup_id"))
        rest = F.when((F.col("candidate.g") != "") | F.lit(not known_first), 4).otherwise(5)
        whole = _crossed(named(all_.filter(alone), one, q), named(i, one, c), block)
        out = out.unionByName(whole.select(*ids("query.query_idx", "candidate.row_idx", F.coalesce(F.when(place > 0, place), rest))))
    return out.filter("query_idx <> candidate_idx")


def candidate_counts(items: DataFrame, mode: str = "soft", pool_k: int = 10, multiplier: float = 2.0) -> DataFrame:
    """query_idx, n: the length of each query's list of candidates, from the groups' sizes alone."""
    i, least = _keyed(items), _least(pool_k, multiplier)
    sizes = _sizes(i).select("g", "size")
    q = i.join(sizes, "g").join(F.broadcast(i.agg(F.count("*").alias("total"))))
    others, own = F.col("total") - 1, F.col("size") - 1
    short = {"off": others, "strict": F.when(own > 0, own).otherwise(others), "soft": F.when(own >= least, own).otherwise(F.least(others, F.lit(least)))}[mode]
    return q.select(F.col("row_idx").alias("query_idx"), F.when(F.col("g") == "", others).otherwise(short).alias("n"))


def nearest(items: DataFrame, k: int = 10, mode: str = "soft", strategy: str = "adjacent", pool_k: int = 10, multiplier: float = 2.0, known_first: bool = True, metric: str = "cosine") -> DataFrame:
    """query_idx, candidate_idx, distance, rank: the k nearest of each query's candidates. items: row_idx, pregroup_id, embedding.

    Groups are searched as blocks, and so is the table for queries that take all of it; only short lists are pairs.
    """
    _, own, fill, all_ = _parts(items, mode, strategy, pool_k, multiplier, known_first)
    v = items.select("row_idx", "embedding")
    named = _keyed(items).join(v, "row_idx")
    inside = named.join(own.select(F.col("query_idx").alias("row_idx")), "row_idx").select(F.col("g").alias("tree"), F.col("row_idx").alias("pos"), "embedding")
    inside = inside.join(inside.groupBy("tree").agg(F.count("*").alias("n")), "tree")
    out = knn_within(inside, k, metric).select(F.col("pos").alias("query_idx"), F.col("near").alias("candidate_idx"), "distance")
    whole = v.join(all_.select(F.col("query_idx").alias("row_idx")), "row_idx")
    out = out.unionByName(knn(v, k, metric, whole).select("query_idx", F.col("neighbor_idx").alias("candidate_idx"), "distance"))
    if fill is not None:
        pairs = own.join(fill, "g").select("query_idx", "candidate_idx")
        out = out.unionByName(distances(pairs, items, metric).select("query_idx", "candidate_idx", "distance"))
    return top(out, k).select("query_idx", "candidate_idx", "distance", "rank")


def distances(pairs: DataFrame, items: DataFrame, metric: str = "cosine") -> DataFrame:
    """pairs with distance, at 6 decimals."""
    v = items.select("row_idx", doubles("embedding").alias("v"))
    f = cosine_distance if metric == "cosine" else euclidean
    q, c = v.select(F.col("row_idx").alias("query_idx"), F.col("v").alias("_q")), v.select(F.col("row_idx").alias("candidate_idx"), F.col("v").alias("_c"))
    return pairs.join(q, "query_idx").join(c, "candidate_idx").withColumn("distance", F.round(f(F.col("_q"), F.col("_c")), 6)).drop("_q", "_c")


def top(pairs: DataFrame, k: int, order: str = "distance", tie: str = "candidate_idx", rank: str = "rank") -> DataFrame:
    w = Window.partitionBy("query_idx").orderBy(order, tie)
    return pairs.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def size_distance(q: Column, c: Column, mode: str = "ratio_penalty", threshold: float = 1.5, penalty: float = 0.05, logs: bool = True, least: float = 1e-8) -> Column:
    """plain: |q - c|; ratio_penalty: |ln(q / c)|; margin_gate: that, plus penalty over a ratio of threshold. Missing: 0.

    logs: q and c are decimal logarithms, which the ratio modes undo.
    """
    if mode == "plain":
        return F.coalesce(F.abs(q - c), F.lit(0.0))
    x, y = (F.pow(F.lit(10.0), q), F.pow(F.lit(10.0), c)) if logs else (q, c)
    ratio = F.when(q.isNotNull() & c.isNotNull(), F.abs(F.log(F.greatest(x, F.lit(least))) - F.log(F.greatest(y, F.lit(least)))))
    apart = F.greatest(x, y) / F.greatest(F.least(x, y), F.lit(least))
    gate = F.when(apart > threshold, penalty).otherwise(0.0) if mode == "margin_gate" else F.lit(0.0)
    return F.coalesce(ratio + gate, F.lit(0.0))


def normalized(x: str, how: str, by: str | list[str] = "query_idx", least: float = 1e-8) -> Column:
    """x scaled over the rows of by: zscore by the population deviation, minmax, robust by the quartile range (else the
    median, else 1), or none. What isn't finite is 0 and takes no part in the scale."""
    w = Window.partitionBy(by)
    c = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.col(x))
    if how == "none":
        out = c
    elif how == "zscore":
        out = c / F.when(F.stddev_pop(c).over(w) > least, F.stddev_pop(c).over(w)).otherwise(1.0)
    elif how == "minmax":
        span = F.max(c).over(w) - F.min(c).over(w)
        out = F.when(span > least, (c - F.min(c).over(w)) / span).otherwise(0.0)
    else:
        iqr = F.percentile(c, 0.75).over(w) - F.percentile(c, 0.25).over(w)
        median = F.percentile(c, 0.5).over(w)
        out = c / F.when(iqr > least, iqr).when(median > least, median).otherwise(1.0)
    return F.coalesce(F.when(F.isnan(out) | (F.abs(out) == float("inf")), None).otherwise(out), F.lit(0.0))


def fusion(pairs: DataFrame, size: DataFrame, k: int = 10, rerank: int = 50, weight: float = 0.05, mode: str = "ratio_penalty", norm: str = "robust", texture: float = 0.0) -> DataFrame:
    """The rerank nearest by shape, then the k best by distance + weight * size + texture * distance_tex; ties by the first rank.

    pairs: query_idx, candidate_idx, distance (and distance_tex, if texture isn't 0). size: row_idx, log_size.
    """
    s = size.select("row_idx", "log_size")
    first = top(pairs, rerank, rank="rank_shape")
    with_q = first.join(s.select(F.col("row_idx").alias("query_idx"), F.col("log_size").alias("_q")), "query_idx", "left")
    both = with_q.join(s.select(F.col("row_idx").alias("candidate_idx"), F.col("log_size").alias("_c")), "candidate_idx", "left")
    both = both.withColumn("distance_size_raw", size_distance(F.col("_q"), F.col("_c"), mode)).withColumn("distance_size", normalized("distance_size_raw", norm))
    tex = F.col("distance_tex") if texture else F.lit(0.0)
    both = both.withColumn("distance_final", F.round(F.col("distance") + weight * F.col("distance_size") + texture * tex, 6)).drop("_q", "_c")
    return top(both, k, "distance_final", "rank_shape", "rank_final")
