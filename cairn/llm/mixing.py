"""Mixing sources to target weights by the cube method (Deville and Tille's balanced sampling).

A source that should give r times its words repeats all its documents floor(r) times; the rest r - floor(r) is each
document's inclusion probability. Flights move three documents' probabilities at a time along the null space of two
constraints, the totals of documents and of words, until one of them is 0 or 1. Each task flies a bounded bucket of one
source and hands on at most two open documents; these fly again, level by level. Documents with over 1/200 of their
source's words go first, and the probability of the others makes up for them, so what lands last is small.
"""

from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm._common import cut, ship, table

ship(__name__)

WEIGHTS, MOST, BUCKET, LARGE, LAST = (5.0, 2.0, 1.0), 3.0, 4096, 200, 12
EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, n, target: the sources' shares of all words by weight, none over most times its own.

    sizes: source, size. Sources by code point, null last, take the weights in turn. What a source can't take is shared
    by weight among the others: in order of most * size / weight, the full ones come first.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.max("size").alias("largest"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    s = s.withColumns({"total": F.sum("source_size").over(whole), "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0)), "used": F.coalesce(F.sum(most * F.col("source_size")).over(so_far), F.lit(0.0))})
    s = s.withColumn("level", (F.col("total") - F.col("used")) / F.col("open"))
    s = s.withColumn("place", F.row_number().over(order))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(whole)["level"]
    s = s.withColumn("target", F.least(F.col("weight") * F.coalesce(level, F.col("full_at")), most * F.col("source_size").cast("double")))
    return s.select("source", "source_size", "n", "largest", "target")


def fly(x: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """The fast flight: probabilities p of documents of x words move until at most two are neither 0 nor 1.

    Sums of p and of p * x stay as they are (with fewer open documents than constraints, nothing moves).
    """
    rng, p, waiting, active = Random(seed), p.copy(), [i for i in range(len(p)) if EPS < p[i] < 1 - EPS], []
    p[p <= EPS], p[p >= 1 - EPS] = 0, 1
    waiting.reverse()
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 3:
            return p
        a, b, c = active
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in zip(active, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in zip(active, u, strict=True) if v)
        step = up if rng.random() * (up + down) < down else -down
        still = []
        for i, v in zip(active, u, strict=True):
            q = p[i] + step * v
            p[i] = 0.0 if q <= EPS else 1.0 if q >= 1 - EPS else q
            if 0 < p[i] < 1:
                still.append(i)
        active = still


def land(x: np.ndarray, p: np.ndarray, target: float, last: int) -> np.ndarray:
    """The landing: of all ways to round the open documents (last at most), the one whose words come nearest to target."""
    left = np.flatnonzero((p > 0) & (p < 1))[-last:]
    ways = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
    fixed = np.where((p > 0) & (p < 1), 0, p) @ x
    best = ways[np.lexsort((np.abs(ways - p[left]).sum(1), np.abs(fixed + ways @ x[left] - target)))[0]]
    p = np.where((p > 0) & (p < 1), 0, p)
    p[left] = best
    return p


def settle(x: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Flights and landings for all documents, largest first (x must descend): halves land one after another, and the
    probabilities of what is left make up for what each landing was off; the last LAST documents land together."""
    out, at, target = p.copy(), 0, float(p @ x)
    while len(x) - at > LAST:
        half = at + (len(x) - at + 1) // 2
        out[at:half] = fly(x[at:half], out[at:half], seed + at)
        out[at:half] = land(x[at:half], out[at:half], out[at:half] @ x[at:half], 2)
        at, words = half, x[half:].sum()
        if words:
            rest = target - out[:half] @ x[:half]
            free = out[half:] @ x[half:]
            # Toward 0 in proportion to p, toward 1 in proportion to 1 - p: nothing leaves [0, 1].
            out[half:] = out[half:] * max(0.0, rest) / free if free and rest <= free else out[half:] + (1 - out[half:]) * min(1.0, (rest - free) / (words - free)) if words > free else out[half:]
    tail = np.where((out[at:] > 0) & (out[at:] < 1), out[at:], np.round(out[at:]))
    out[at:] = land(x[at:], tail, target - out[:at] @ x[:at], LAST)
    return out


FLOWN = "doc_id string, source string, size long, key long, large boolean, p double"


def _flight(group: pd.DataFrame, landing: bool) -> pd.DataFrame:
    g = group.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    x, p = g["size"].to_numpy(float), g["p"].to_numpy(float)
    seed = int(g["key"].iloc[0]) & 0xFFFFFFFF
    g["p"] = settle(x, p, seed) if landing else fly(x, p, seed)
    return g[["doc_id", "source", "size", "key", "large", "p"]]


def _groups(df: DataFrame, buckets: int, landing: bool) -> DataFrame:
    """Every source's bucket flies in a task of its own; with one bucket it may land."""
    named = df.withColumn("_b", F.pmod(F.xxhash64("key", "doc_id", F.lit(buckets)), F.lit(buckets)))
    return named.groupBy(F.col("source").alias("_s"), "_b").applyInPandas(lambda g: _flight(g, landing), FLOWN)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, bucket: int = BUCKET) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies: how many words and copies of each document the mix takes.

    Size is the number of words; null and empty texts have 0 and are taken 0 words (their copies still count documents).
    Rows that repeat others are documents of their own. An empty table gives no rows. Other columns are ignored.
    """
    words = F.size(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")), " "))
    empty = F.coalesce("text", F.lit("")).rlike("^[\\x20\\x09-\\x0D]*$")
    units = cut(docs.select(F.col("doc_id").cast("string"), "source", F.when(empty, 0).otherwise(words).cast("long").alias("size"), F.xxhash64(F.col("doc_id").cast("string"), "source", F.lit(11)).alias("key")))
    goal = cut(targets(units.select("source", "size"), weights, most))
    most_rows = goal.agg(F.max("n")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.when(F.abs(ratio - F.round(ratio)) < EPS, F.round(ratio)).otherwise(ratio)
    g = goal.select(F.col("source").alias("_s"), "source_size", "target", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("rest"))
    part = g.select("_s", "source_size", "rest")
    open_ = units.join(part, units.source.eqNullSafe(part._s), "inner").withColumn("large", F.col("size") * LARGE > F.col("source_size")).withColumn("p", F.col("rest")).select("doc_id", "source", "size", "key", "large", "p", "source_size", "rest")
    # At most LARGE documents of a source are large: one group, which lands.
    first = cut(_groups(open_.filter("large").select("doc_id", "source", "size", "key", "large", "p"), 1, True))
    gone = first.groupBy("source").agg(F.sum("size").alias("size_l"), F.sum(F.col("p") * F.col("size")).alias("taken_l"))
    left = part.join(gone, part._s.eqNullSafe(gone.source), "left").select("_s", ((F.col("rest") * F.col("source_size") - F.coalesce("taken_l", F.lit(0.0))) / (F.col("source_size") - F.coalesce("size_l", F.lit(0)))).alias("q"), "source_size", F.coalesce("size_l", F.lit(0)).alias("size_l"))
    left = left.select("_s", F.when(F.col("source_size") > F.col("size_l"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "q"))).otherwise(0.0).alias("q"))
    small = open_.filter("NOT large").join(left, F.col("source").eqNullSafe(left._s)).select("doc_id", "source", "size", "key", "large", F.col("q").alias("p"))
    buckets, done = max(1, -(-most_rows // bucket)), [first]
    while buckets > 1:
        flown = cut(_groups(small, buckets, False))
        done.append(flown.filter("p = 0 OR p = 1"))
        small, buckets = flown.filter("p > 0 AND p < 1"), -(-2 * buckets // bucket)
    done.append(_groups(small, 1, True))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    joined = out.join(g, out.source.eqNullSafe(g._s))
    copies = (F.col("whole") + F.col("p")).cast("long")
    return joined.select(F.col("doc_id").cast("long"), "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")
