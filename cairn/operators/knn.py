"""Exact nearest neighbours, by blocks: all blocks pass by each block of queries, whose rows keep their top k."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import pairs

BLOCK = 2048


def knn(items: DataFrame, k: int = 10, metric: str = "cosine", queries: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """query_idx, neighbor_idx, rank, distance: the k nearest others of each query, by distance at 6 decimals, then row_idx.

    items: row_idx (unique), embedding. Only itself is left out, so of two equal rows each has the other at distance 0.
    No row holds more than a block; the product is of blocks, not of rows. Blocks have 2**15 rows at most, and only neighbours
    leave the search.
    """
    named = lambda rows: rows.select(F.lit("").alias("tree"), F.lit(rows.count()).cast("long").alias("n"), F.col("row_idx").alias("pos"), "embedding")
    found = pairs.near_pairs(named(items), k, metric, block) if queries is None else pairs.near_across(named(queries), named(items), k, metric, block)
    near = found.select(F.col("pos").alias("query_idx"), F.col("near").alias("neighbor_idx"), "distance")
    w = Window.partitionBy("query_idx").orderBy("distance", "neighbor_idx")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def knn_within(points: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """tree, pos, near, distance: the k nearest others in its own tree of each of points (tree, n, pos, embedding)."""
    return pairs.near_pairs(points, k, metric)
