"""Assigning arriving vectors to known clusters."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.vectors import doubles, euclidean


def assign(arriving: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, cluster_id, distance of the nearest centroid; works on streams and tables. Centroids are few: one row a cluster."""
    c = centroids.agg(F.collect_list(F.struct("cluster_id", doubles("embedding").alias("v"))).alias("_c"))
    near = F.array_min(F.transform("_c", lambda c: F.struct(euclidean(doubles("embedding"), c.v).alias("d"), c.cluster_id.alias("k"))))
    return arriving.crossJoin(F.broadcast(c)).withColumn("_n", near).select("id", F.col("_n.k").alias("cluster_id"), F.col("_n.d").alias("distance"))
