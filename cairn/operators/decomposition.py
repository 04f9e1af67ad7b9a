"""Principal components and k-means, from Spark ML."""

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.vectors import doubles, euclidean


def _moments(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and sample covariance of the embeddings; only D x D numbers reach the driver.

    Each task adds up the products of its centred rows; a row of the matrix is then summed over tasks.
    """
    v = items.select(doubles("embedding").alias("v"))
    n = v.count()
    if not n:
        return 0, np.zeros(0), np.zeros((0, 0))
    mean = v.agg(Summarizer.mean(array_to_vector("v"))).first()[0].toArray()
    if n < 2:
        return n, mean, np.zeros((len(mean), len(mean)))

    def products(batches):
        gram = np.zeros((len(mean), len(mean)))
        for b in batches:
            x = np.stack(b["v"].to_numpy()).astype(float) - mean
            gram += x.T @ x
        yield pd.DataFrame({"i": np.arange(len(mean)), "row": list(gram)})

    def total(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [g["i"].iloc[0]], "row": [np.sum(np.stack(g["row"].to_numpy()), axis=0)]})

    rows = v.mapInPandas(products, "i int, row array<double>").groupBy("i").applyInPandas(total, "i int, row array<double>").collect()
    return n, mean, np.array([r.row for r in sorted(rows, key=lambda r: r.i)]) / (n - 1)


def pca(items: DataFrame, setting: float) -> tuple[DataFrame, DataFrame]:
    """items with centred scores as embedding, and the report (component, ratio, cumulative).

    setting: 0 or less is off, under 1 a share of the variance, 2 and more a number of components. 1 is ambiguous and an
    error. Each component's largest weight is positive.
    """
    if setting == 1:
        raise ValueError("1 could mean one component or all the variance: give 0.999 or a number from 2 on")
    n, mean, cov = _moments(items)
    if not n:
        return items, items.sparkSession.createDataFrame([], "component int, ratio double, cumulative double")
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    ratio = values / values.sum() if values.sum() else values
    k = len(mean) if setting <= 0 else int(setting) if setting > 1 else int(np.searchsorted(np.cumsum(ratio), setting) + 1)
    k = min(k, n, len(mean))
    w = vectors[:, :k]
    w = w * np.sign(w[np.abs(w).argmax(0), np.arange(k)])
    spark = items.sparkSession
    report = spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(ratio[:k])], "component int, ratio double")
    report = report.withColumn("cumulative", F.sum("ratio").over(Window.orderBy("component")))
    if setting <= 0:
        return items, report
    columns = [F.aggregate(F.zip_with(doubles("embedding"), F.lit((w[:, j]).tolist()), lambda x, y: x * y), F.lit(float(-(mean @ w[:, j]))), lambda s, x: s + x) for j in range(k)]
    return items.withColumn("embedding", F.array(*columns)), report


def kmeans(items: DataFrame, k: int = 20, seed: int = 42) -> DataFrame:
    """id, cluster_id, score: the distance to the nearest centre."""
    v = items.select("id", doubles("embedding").alias("e"), array_to_vector(doubles("embedding")).alias("features"))
    model = KMeans(k=k, seed=seed).fit(v)
    centers = F.lit(np.array(model.clusterCenters()).tolist())
    return model.transform(v).select("id", F.col("prediction").alias("cluster_id"), euclidean(F.col("e"), F.element_at(centers, F.col("prediction") + 1)).alias("score"))
