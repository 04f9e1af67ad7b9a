"""Connected components by alternating large-star and small-star steps; no step gathers a node's neighbours in one row."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import Scratch, join_counted


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b: long). Loops and repeated edges are allowed.

    The result reads a table of scratch. Nodes of very many edges are joined apart from the others.
    """
    e = scratch.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now.n:
            break
        before = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = scratch.cut(join_counted(both, least, "u", "n", 2 * now.n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, lower, "u", "n", 2 * now.n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = scratch.cut(small.filter("u <> v").distinct())
        scratch.drop(e, large)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
