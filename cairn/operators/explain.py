"""Attention rollout over layers, and its maps of patches."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_normalized(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(a.sum(-1, keepdims=True), 1e-6)


def rollout(attention: list[np.ndarray], gradients: list[np.ndarray] | None = None) -> np.ndarray:
    """What the first token draws from each other one: the product of the layers' mean heads plus identity, row by row normal.

    attention: (heads, tokens, tokens) for each layer; gradients of the same shape weigh it by their positive part.
    """
    out = np.eye(attention[0].shape[-1])
    for i, a in enumerate(attention):
        if gradients is not None:
            a = a * np.maximum(gradients[i], 0)
        out = row_normalized(a.mean(0) + np.eye(a.shape[-1])) @ out
    return out[0, 1:]


def rollouts(attention: DataFrame) -> DataFrame:
    """image_id, patch, weight. attention: image_id, layer, head, row (array of arrays), one row for each head."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        layers = [np.stack([np.stack(m) for m in h["row"]]).astype(float) for _, h in g.sort_values(["layer", "head"]).groupby("layer")]
        w = rollout(layers)
        return pd.DataFrame({"image_id": g["image_id"].iloc[0], "patch": np.arange(len(w)), "weight": w})

    return attention.groupBy("image_id").applyInPandas(run, "image_id string, patch int, weight double")


def heat(weights: DataFrame) -> DataFrame:
    """image_id, y, x, heat: the patches as a square, from 0 to 1 for each image."""
    w = Window.partitionBy("image_id")
    low, high, side = F.min("weight").over(w), F.max("weight").over(w), F.sqrt(F.count("*").over(w)).cast("int")
    return weights.select("image_id", F.floor(F.col("patch") / side).cast("int").alias("y"), (F.col("patch") % side).alias("x"), ((F.col("weight") - low) / F.greatest(high - low, F.lit(1e-6))).alias("heat"))


def fill_ratio(pixels: DataFrame, key: str, white: float = 245.0) -> DataFrame:
    """key, fill_ratio, touches_border: the box of foreground pixels (x, y, width, height, r, g, b) by the image's area."""
    fore = F.least("r", "g", "b") < white
    box = lambda f, c: f(F.when(fore, F.col(c)))
    a = pixels.groupBy(key).agg(box(F.min, "x").alias("x0"), box(F.max, "x").alias("x1"), box(F.min, "y").alias("y0"), box(F.max, "y").alias("y1"), F.max("width").alias("w"), F.max("height").alias("h"))
    area = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    return a.select(key, F.coalesce(area / (F.col("w") * F.col("h")), F.lit(0.0)).alias("fill_ratio"), F.coalesce((F.col("x0") == 0) | (F.col("y0") == 0) | (F.col("x1") == F.col("w") - 1) | (F.col("y1") == F.col("h") - 1), F.lit(False)).alias("touches_border"))


def embed_images(*_args, **_kwargs):
    """Model inference is a seam: pass a predict_batch_udf of your own model. None is bundled."""
    raise NotImplementedError("bring a model: pyspark.ml.functions.predict_batch_udf over the image table")
