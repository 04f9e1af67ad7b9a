"""Substring deduplication by sliding sentence spans.

Of the runs of consecutive sentences that hold two sentences and twelve words, the shortest from each sentence on and the
shortest up to each sentence are hashed. Together they cover what any longer run covers, and repeat wherever it does. They
are joined globally, and the sentences go that a repeated run covers other than at its first place.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import Scratch, cut, fresh, holds, join_counted, key_filter, mix, once, ship, small_batches, table, text_key, word_hashes

ship(__name__)

#: A run holds at least so many sentences and so many words.
SENTENCES, WORDS = 2, 12
#: A sentence goes on to the blanks behind its final mark, or behind a line break.
BREAK = re.compile(rb"[.!?][ \t-\r]+|\n[ \t-\r]*")
#: An odd factor and its inverse, for hashes of word runs that don't depend on where a run stands.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


@once
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, f, np.uint64))), dtype=np.uint64) for f in (FACTOR, INVERSE))


def _bounds(raw: bytes) -> np.ndarray:
    ends = [m.end() for m in BREAK.finditer(raw)]
    return np.array([0, *(ends if ends and ends[-1] == len(raw) else [*ends, len(raw)])], np.int64)


def split_sentences(text: str | None) -> list[str]:
    """The sentences, whose concatenation is the text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    at = _bounds(raw).tolist()
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at[:-1], at[1:], strict=True)] if raw else []


def _spans(text: str | None, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run: its hash, its first sentence, and the one after its last. Sentences without words stand in no run."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    byte = np.frombuffer(raw, np.uint8)
    blank = (byte == 32) | ((byte >= 9) & (byte <= 13))
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))) if len(raw) else np.zeros(0, np.int64)
    at = np.searchsorted(starts, _bounds(raw))  # the words before each bound
    full = np.flatnonzero(np.diff(at))
    begin = np.append(at[full], len(starts))
    n = len(full)
    end = np.maximum(np.searchsorted(begin, begin[:-1] + words), np.arange(n) + sentences)
    start = np.minimum(np.searchsorted(begin, begin[1:] - words, "right") - 1, np.arange(n) + 1 - sentences)
    from_each, to_each = np.flatnonzero(end <= n), np.flatnonzero(start >= 0)
    pairs = np.concatenate((from_each * (n + 1) + end[from_each], start[to_each] * (n + 1) + to_each + 1))
    first, last = np.divmod(np.unique(pairs), n + 1)
    if not len(first):
        return np.zeros(0, np.uint64), first, last
    up, down = _powers(1 << max(12, len(starts).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(word_hashes(text)) * up[: len(starts)], dtype=np.uint64)))
        a, b = begin[first], begin[last]
        return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)), full[first], full[last - 1] + 1


def repeated_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """doc_id, key, covered: for each document, the ranges (first, after last) of sentences that a repeated run covers.

    A run's first place is the one of least (doc_id, key, sentence); a null doc_id comes first. key tells apart documents
    that share a doc_id; rows equal in doc_id and text are one document. Documents without such a range have no row.
    """
    with Scratch(docs.sparkSession) as scratch:
        return cut(_repeated(docs, sentences, words, scratch))


def _repeated(docs: DataFrame, sentences: int, words: int, scratch: Scratch) -> DataFrame:
    def count(batches):
        for b in batches:
            runs = [_spans(t, sentences, words)[0] for t in b["text"]]
            h, n = np.unique(np.concatenate([*runs, np.zeros(0, np.uint64)]).view(np.int64), return_counts=True)
            yield pd.DataFrame({"h": h, "n": n})

    counts = scratch.cut(docs.select("text").mapInPandas(count, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"))
    twice = docs.sparkSession.sparkContext.broadcast(key_filter(counts))

    def emit(batches):
        for b in batches:
            parts = []
            for d, key, t in zip(b["doc_id"], b["key"], b["text"], strict=True):
                h, first, last = _spans(t, sentences, words)
                at = holds(twice.value, h)
                if at.any():
                    parts.append(pd.DataFrame({"h": h[at].astype(np.int64), "doc_id": d, "key": key, "first": first[at], "last": last[at]}))
            if parts:
                yield pd.concat(parts)

    rows = docs.select(F.col("doc_id").cast("string"), text_key().alias("key"), "text").mapInPandas(emit, "h long, doc_id string, key long, first int, last int")
    rows = scratch.cut(rows).withColumn("at", F.struct(F.col("doc_id").cast("long").alias("d"), "key", "first"))
    firsts = rows.groupBy("h").agg(F.min("at").alias("least"), F.max("at").alias("most"), F.count("*").alias("n")).filter("n > 1")
    firsts = scratch.cut(firsts.filter("least <> most OR (least.d IS NULL) <> (most.d IS NULL)").select("h", "least", "n"))
    total = firsts.agg(F.sum("n")).first()[0] or 0
    again = join_counted(rows, firsts, "h", "n", total).filter(~F.col("at").eqNullSafe(F.col("least")))
    return again.groupBy(F.col("at.d").alias("doc_id"), "key").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("covered"))


def _cleaner():
    @F.pandas_udf("clean string, n_sentences long, n_removed long")
    def cleaned(texts: pd.Series, covered: pd.Series) -> pd.DataFrame:
        out = []
        for text, ranges in zip(texts, covered, strict=True):
            parts = split_sentences(text)
            gone = np.zeros(len(parts) + 1, np.int64)
            for r in ranges if ranges is not None else ():
                gone[r["first"]] += 1
                gone[r["last"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            out.append((None if text is None else "".join(s for s, g in zip(parts, gone, strict=True) if not g), len(parts), int(gone.sum())))
        return pd.DataFrame(out, columns=["clean", "n_sentences", "n_removed"])

    return cleaned


def remove_repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """docs with clean (the text without repeated sentences; null stays null), n_sentences and n_removed.

    Every row stays; columns of docs of these three names are replaced.
    """
    x, c = fresh(docs, "x"), fresh(docs, "c")
    found = repeated_spans(docs, sentences, words).select(F.struct("doc_id", "key", "covered").alias(x))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(x)["doc_id"]) & (text_key() == F.col(x)["key"]), "left")
    done = joined.withColumn(c, _cleaner()("text", F.col(x)["covered"]))
    own = {k: F.col(c)[k] for k in ("clean", "n_sentences", "n_removed")}
    return done.select(*(k for k in docs.columns if k not in own), *(v.alias(k) for k, v in own.items()))


def op8_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
