"""Hashed word n-grams, and logistic regression by follow-the-regularised-leader updates (FTRL-proximal)."""

import json
import re
from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import held_out, mix, ship

ship(__name__)

BITS = 20
#: A token is a run of letters and digits, or a run of other visible characters.
TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^\sA-Za-z0-9_\x80-\xff]+")


def tokens(text: str | None, lower: bool) -> list[bytes]:
    return TOKEN.findall(((text or "").lower() if lower else text or "").encode("utf-8", "replace"))


def features(toks: list[bytes]) -> np.ndarray:
    """The distinct cells of all single tokens and pairs of neighbours; cell 0 is the bias.

    A token that repeats the one before it reads as "again", so that stuttering looks alike in any vocabulary.
    """
    h = np.fromiter(map(crc32, toks), np.uint64, len(toks))
    h[1:][h[1:] == h[:-1]] = 1 << 40
    parts = [h]
    with np.errstate(over="ignore"):
        parts.append(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    cells = mix(np.concatenate(parts)) >> np.uint64(64 - BITS)
    return np.unique(np.concatenate(([0], cells.astype(np.int64))))


def rates(toks: list[bytes], stems: tuple[int, ...] = (), damp: float = 100, most: float = 1) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of all single tokens and of their first so many bytes (stems), and how many percent of the
    tokens each is, most at most, as if there were damp tokens more; cell 0 is the bias, of value 1."""
    parts = [np.fromiter(map(crc32, toks), np.uint64, len(toks))]
    for k in stems:
        parts.append(np.fromiter((crc32(t[:k]) for t in toks), np.uint64, len(toks)) + np.uint64(k << 41))
    cells, n = np.unique((mix(np.concatenate(parts)) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    some = cells > 0
    return np.concatenate(([0], cells[some])), np.concatenate(([1.0], np.minimum(most, 100 * n[some] / (len(toks) + damp))))


class Ftrl:
    """Per-coordinate FTRL-proximal; l1 leaves cells at 0 that few examples speak for."""

    def __init__(self, alpha: float = 0.15, beta: float = 1.0, l1: float = 1.5, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, i) -> np.ndarray:
        z, l1 = self.z[i], np.where(np.asarray(i) == 0, 0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0, w)

    def step(self, i: np.ndarray, g, w: np.ndarray) -> None:
        """One update of cells i, whose weights are w, by gradient g."""
        n = self.n[i]
        after = n + g * g
        self.z[i] += g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[i] = after

    def learn(self, i: np.ndarray, y: int, x=1.0) -> None:
        """One example: cells i of values x, label y."""
        w = self.weights(i)
        self.step(i, (sigmoid((w * x).sum()) - y) * x, w)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def labelled(docs: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int]) -> DataFrame:
    """Rows (text, y) to learn from, in a fixed random order: for each y, bounds[y] documents at most, none held out."""
    known = labels.filter(~held_out() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y")).withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    few = reduce(DataFrame.unionAll, [known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(n) for y, n in bounds.items()])
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").orderBy("h", "doc_id", "text").limit(sum(bounds.values())).select("text", "y")


def fit(rows: DataFrame, train) -> tuple[np.ndarray, dict]:
    """Runs train(list of (text, y)) -> weights, notes over the bounded rows, in one task; 2**BITS float32 weights."""

    def run(batches):
        data = [x for b in batches for x in zip(b["text"], b["y"], strict=True)]
        w, notes = train(data)
        yield pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "notes": [json.dumps(notes)]})

    got = rows.coalesce(1).mapInPandas(run, "w binary, notes string").collect()
    return (np.frombuffer(bytes(got[0].w), np.float32), json.loads(got[0].notes)) if got else (np.zeros(1 << BITS, np.float32), {})


def scorer(spark, weights: np.ndarray, featurise):
    """A column function: text to probability, the sigmoid of the sparse dot product. featurise(text): cells and their values."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = shared.value
        return pd.Series([sigmoid(np.sum(w[i] * x, dtype=np.float64)) for i, x in map(featurise, texts)], dtype="float64")

    return score
