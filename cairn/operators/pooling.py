"""Pooling of feature vectors, centroids and representatives."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.vectors import doubles, euclidean, norm

HOW = {"mean": F.avg, "max": F.max, "median": lambda c: F.percentile(c, 0.5)}


def pool(df: DataFrame, key: str, vector: str, how: str = "mean", renormalize: bool = False) -> DataFrame:
    """key, vector: each dimension pooled over all the rows of key (views and tokens alike weigh the same)."""
    long = df.select(key, F.posexplode(doubles(vector)).alias("dim", "x"))
    dims = long.groupBy(key, "dim").agg(HOW[how](F.col("x")).alias("x"))
    out = dims.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s.x).alias(vector))
    if renormalize:
        size = norm(F.col(vector))
        out = out.withColumn(vector, F.when(size > 0, F.transform(vector, lambda x: x / size)).otherwise(F.col(vector)))
    return out


def centroids(assigned: DataFrame, vector: str = "embedding", cluster: str = "cluster_id") -> DataFrame:
    """The mean vector of each cluster that isn't noise."""
    return pool(assigned.filter(F.col(cluster) != -1), cluster, vector)


def representatives(assigned: DataFrame, vector: str = "embedding", cluster: str = "cluster_id") -> DataFrame:
    """The member nearest to each cluster's centroid; the first row wins ties."""
    center = centroids(assigned, vector, cluster).withColumnRenamed(vector, "_c")
    d = F.round(euclidean(doubles(vector), F.col("_c")), 6)
    near = assigned.join(center, cluster).withColumn("distance", d)
    return near.groupBy(cluster).agg(F.min_by("id", F.struct("distance", "row_idx")).alias("id"), F.min("distance").alias("distance"))
