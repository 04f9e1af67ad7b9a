"""Quality classifier: hashed word n-grams, logistic regression trained with FTRL-proximal updates."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import held_out, ship, small_batches, table
from cairn.llm._linear import BITS, Ftrl, features, fit, labelled, scorer, tokens

ship(__name__)

#: Labelled documents learned from at most, by label; passes over them; least score of an accepted document.
BOUNDS, EPOCHS, ACCEPT = {0: 3000, 1: 10_000}, 3, 0.3


def cells(text: str | None) -> tuple[np.ndarray, float]:
    return features(tokens(text, False)), 1.0


def _train(data: list) -> tuple[np.ndarray, dict]:
    model, seen = Ftrl(), [(cells(t)[0], y) for t, y in data]
    for _ in range(EPOCHS):
        for i, y in seen:
            model.learn(i, y)
    return model.weights(np.arange(1 << BITS)), {}


def learn_quality(docs: DataFrame, labels: DataFrame, bounds: dict[int, int] = BOUNDS) -> np.ndarray:
    """Weights learned from labels.quality of documents that aren't held out. No labels: all weights 0, so every score is 0.5."""
    return fit(labelled(docs, labels, "quality", bounds), _train)[0]


def with_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with score (0 to 1; null and empty texts get the bias's) and predicted (1 if score >= 0.3).

    Every row stays; columns of docs that are called score or predicted are replaced.
    """
    return docs.withColumn("score", scorer(docs.sparkSession, weights, cells)("text")).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    weights = learn_quality(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs.select("doc_id", held_out().alias("held_out"), "text"), weights).drop("text")
