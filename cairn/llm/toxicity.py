"""Toxicity classifier that is regularised by counterfactuals: swapping identity terms must not change its score.

A text's features are its words' rates, so a word that toxic texts are full of and clean ones seldom hold does not condemn
a long clean text. Terms are swapped in the labelled texts: listed ones, and neutral terms that are learned from these texts
in any language, words that are frequent, as frequent in toxic as in clean texts, and stand in like contexts.
"""

from collections import Counter
from typing import NamedTuple
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import held_out, ship, small_batches, table
from cairn.llm._linear import BITS, Ftrl, fit, labelled, rates, scorer, tokens

ship(__name__)

#: Labelled documents learned from at most, by label; passes; weight of the squared score change; least score of a toxic document.
BOUNDS, EPOCHS, PENALTY, TOXIC = {0: 14_000, 1: 6000}, 4, 1.0, 0.5
#: Lengths in bytes of the word beginnings that count as features: insults are inflected.
STEMS = (4, 5, 6)
#: Neutral terms: least share of the texts, most log odds between the labels, how many at most; cells of a context.
SHARE, NEUTRAL, TERMS, CONTEXT = 0.01, 0.3, 300, 256

#: Default identity terms; terms are swapped within their row. The first of each row is neutral.
IDENTITY = [
    ["people", "women", "men", "girls", "boys", "immigrants", "refugees", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "gays", "lesbians", "blacks", "whites", "asians", "africans", "mexicans", "arabs"],
    ["person", "woman", "man", "girl", "boy", "immigrant", "refugee", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "catholic", "lesbian", "transgender", "foreigner"],
    ["any", "gay", "straight", "black", "white", "asian", "african", "mexican", "arab", "jewish", "female", "male", "disabled", "deaf", "blind", "old", "young"],
]


class Model(NamedTuple):
    """The weights; of the labelled texts learned from, how many there were and how many had terms swapped; and the
    learned terms, each with the one that takes its place."""

    weights: np.ndarray
    rows: int
    swapped: int
    terms: dict[str, str]


def cells(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return rates(tokens(text, True), STEMS)


def neutral_terms(toks: list[list[bytes]], ys: list[int]) -> dict[bytes, bytes]:
    """Each neutral term, with the neutral term whose neighbours are most like its own."""
    held = {y: Counter(t for x, label in zip(toks, ys, strict=True) if label == y for t in set(x)) for y in (0, 1)}
    n = {y: sum(label == y for label in ys) for y in (0, 1)}
    if not n[0] or not n[1]:
        return {}
    odds = {t: np.log((held[1][t] + 1) / (n[1] + 2)) - np.log((held[0][t] + 1) / (n[0] + 2)) for t in held[0] if t[:1].isalpha() or t[:1] >= b"\x80"}
    able = sorted((t for t, o in odds.items() if abs(o) <= NEUTRAL and held[0][t] + held[1][t] >= SHARE * len(ys)), key=lambda t: (-held[0][t] - held[1][t], t))[:TERMS]
    at = {t: i for i, t in enumerate(able)}
    near = np.zeros((len(able), CONTEXT))
    for x in toks:
        for k, t in enumerate(x):
            if (i := at.get(t)) is not None:
                if k:
                    near[i, crc32(x[k - 1]) % (CONTEXT // 2)] += 1
                if k + 1 < len(x):
                    near[i, CONTEXT // 2 + crc32(x[k + 1]) % (CONTEXT // 2)] += 1
    if len(able) < 2:
        return {}
    near = np.sqrt(near / np.maximum(1, near.sum(1, keepdims=True)))
    like = near @ near.T
    np.fill_diagonal(like, -1)
    return {t: able[j] for t, j in zip(able, like.argmax(1).tolist(), strict=True)}


def _swaps(toks: list[bytes], after: dict, first: dict, learned: dict) -> list[list[bytes]]:
    """The text with each listed term as the next of its row, and as the row's neutral first one; and with one of its
    learned terms as its like."""
    out = [[swap.get(t, t) for t in toks] for swap in (after, first) if any(t in swap for t in toks)]
    if own := sorted({t for t in toks if t in learned}):
        one = own[len(toks) % len(own)]
        out.append([learned[one] if t == one else t for t in toks])
    return out


def _trainer(identity: list[list[str]], penalty: float):
    after = {t.encode(): row[(k + 1) % len(row)].encode() for row in identity for k, t in enumerate(row)}
    first = {t.encode(): row[0].encode() for row in identity for t in row[1:]}

    def train(data: list) -> tuple[np.ndarray, dict]:
        model, seen = Ftrl(alpha=0.3, l1=2.0), []
        toks = [tokens(t, True) for t, _ in data]
        learned = neutral_terms(toks, [y for _, y in data])
        for words, (_, y) in zip(toks, data, strict=True):
            i, x = rates(words, STEMS)
            swaps = []
            for other in _swaps(words, after, first, learned):
                j, z = rates(other, STEMS)
                both, back = np.unique(np.concatenate((i, j)), return_inverse=True)
                change = np.bincount(back, np.concatenate((x, -z)))
                if (some := np.abs(change) > 1e-12).any():
                    swaps.append((both[some], change[some]))
            seen.append((i, x, y, swaps))
        for _ in range(EPOCHS):
            for i, x, y, swaps in seen:
                model.learn(i, y, x)
                for j, change in swaps:  # the gradient of penalty * (change of the log odds)**2
                    w = model.weights(j)
                    if (moved := (w * change).sum()) != 0:
                        model.step(j, 2 * penalty * np.clip(moved, -4, 4) * change, w)
        terms = {t.decode("utf-8", "replace"): u.decode("utf-8", "replace") for t, u in learned.items()}
        return model.weights(np.arange(1 << BITS)), {"rows": len(seen), "swapped": sum(bool(s) for *_, s in seen), "terms": terms}

    return train


def learn_toxicity(docs: DataFrame, labels: DataFrame, bounds: dict[int, int] = BOUNDS, identity: list[list[str]] = IDENTITY, penalty: float = PENALTY) -> Model:
    """Learns from labels.toxic of documents that aren't held out. No labels: all weights 0, so every score is 0.5."""
    weights, notes = fit(labelled(docs, labels, "toxic", bounds), _trainer(identity, penalty))
    return Model(weights, notes.get("rows", 0), notes.get("swapped", 0), notes.get("terms", {}))


def with_toxicity(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with score (0 to 1; null and empty texts get the bias's) and predicted (1 if score >= 0.5).

    Every row stays; columns of docs that are called score or predicted are replaced.
    """
    return docs.withColumn("score", scorer(docs.sparkSession, weights, cells)("text")).withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return with_toxicity(docs.select("doc_id", held_out().alias("held_out"), "text"), model.weights).drop("text")
