"""Document fingerprints by locally consistent parsing: deterministic coin tossing names phrases, level by level.

A phrase's bounds depend only on its near surroundings, so equal passages share their interior phrases wherever they
stand. A fingerprint has two sketches of every text: the least hashes of its short phrases (of about 9 bytes) and of its long ones
(of about 27). Shares of equal ones estimate the likeness of two texts: of long phrases if both have enough, else of short ones, so
that always the same kind is compared.

Null text is the empty text, which has an empty fingerprint; texts of any length are parsed whole. Rows that share a doc_id are in
order of their text, null ids come last, and of one row the next is itself. Other columns are ignored; no rows: no rows.
"""

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import mix, once, ship, small_batches, table

ship(__name__)

#: Hashes in a sketch; the levels of short and of long phrases; so many long phrases are enough.
SIZE, SHORT, LONG, ENOUGH = 64, 2, 3, 32
#: Documents in a range of neighbours.
RANGE = 4096


@once
def _tosses() -> tuple[np.ndarray, ...]:
    """Tables of coin tosses: of two symbols, twice the lowest bit they differ in, plus the first one's value there."""

    def toss(n: int) -> np.ndarray:
        a, b = np.arange(n)[:, None], np.arange(n)[None, :]
        x = a ^ b
        low = np.bitwise_count((x & -x) - 1)
        return np.where(x == 0, 0, 2 * low + ((a >> np.where(x == 0, 0, low)) & 1)).astype(np.uint8)

    return toss(256), toss(128), toss(16), toss(8)


def _labels(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each symbol's label in 0..5; neighbours differ, and a label depends on a few symbols before it only."""
    bytes_, two, four, three = _tosses()
    if sym.dtype == np.uint8:
        lab = bytes_[sym, np.concatenate((sym[:1], sym[:-1]))]
    else:
        prev = np.concatenate((~sym[:1], sym[:-1]))
        x = sym ^ prev
        low = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        lab = (2 * low + ((sym >> (low & np.uint64(63))) & np.uint64(1))).astype(np.uint8) & 127
    for tossed in (two, four, three) if sym.dtype != np.uint8 else (four, three):
        lab[first] = 0
        lab = tossed[lab, np.concatenate((lab[:1], lab[:-1]))]
    lab[first] = 0
    return lab


def _level(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of the sequences sym of documents doc: their names, and their documents."""
    starts = np.concatenate(([True], (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])))
    at = np.flatnonzero(starts)
    runs = np.diff(np.append(at, len(sym))).astype(np.uint64)
    sym, doc = sym[at], doc[at]
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    lab = _labels(sym, first)
    peak = np.zeros(len(sym), bool)
    after = np.append(lab[1:], np.uint8(0))  # behind the last text as behind the others, whose next label is a first one's 0
    peak[1:] = (lab[1:] > lab[:-1]) & (lab[1:] > after[1:])
    cut = np.flatnonzero(peak | first)
    with np.errstate(over="ignore"):
        name = mix(sym.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + runs)
        place = (np.arange(len(sym)) - np.repeat(cut, np.diff(np.append(cut, len(sym))))).astype(np.uint64)
        names = mix(np.add.reduceat(mix(name + place * np.uint64(0xD6E8FEB86659FD93)), cut))
    return names, doc[cut]


def _sketches(doc: np.ndarray, names: np.ndarray, n: int) -> list[np.ndarray]:
    """The SIZE least different 32-bit hashes of each document's phrases, in order."""
    keys = np.unique(doc.astype(np.uint64) << np.uint64(32) | names >> np.uint64(32))
    bounds = np.searchsorted((keys >> np.uint64(32)).astype(np.int64), np.arange(n + 1))
    low = keys.astype(np.uint32)
    return [low[a : min(b, a + SIZE)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def fingerprints(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's sketches of short and of long phrases; an empty text has none in either."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lens = np.array([len(b) for b in raw], np.int64)
    sym: np.ndarray = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(raw)), lens)
    if not len(sym):
        return [(np.zeros(0, np.uint32),) * 2] * len(raw)
    found = []
    for level in range(1, LONG + 1):
        sym, doc = _level(sym, doc)
        if level in (SHORT, LONG):
            found.append(_sketches(doc, sym, len(raw)))
    return list(zip(*found, strict=True))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The estimated share of phrases in common (Jaccard); 1 for two empty fingerprints."""
    kind = int(min(len(a[1]), len(b[1])) >= ENOUGH)
    x, y = set(a[kind].tolist()), set(b[kind].tolist())
    if not x or not y:
        return float(len(x) == len(y))
    least = sorted(x | y)[:SIZE]
    return sum(v in x and v in y for v in least) / len(least)


def as_string(f: tuple[np.ndarray, np.ndarray]) -> str:
    """Both sketches in hex, short phrases first."""
    return "-".join("".join(f"{v:08x}" for v in part.tolist()) for part in f)


def in_ranges(docs: DataFrame, per_range: int = RANGE) -> DataFrame:
    """docs' doc_id and text, dealt by ranges of descending doc_id and sorted, with columns r (range) and copy.

    A range also holds, last and with copy true, the first rows of the range that follows; the first follows the last.
    Null ids come last. Rows that share an id are in order of their text.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"))
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"))
    n = ids.count()
    parts = max(1, n // per_range)
    cuts = sorted(set(ids.approxQuantile("k", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    bounds = F.lit([int(c) for c in cuts]) if cuts else None
    r = F.aggregate(bounds, F.lit(0), lambda a, b: a + (F.col("k") <= b).cast("int")) if cuts and len(cuts) < 64 else None
    if cuts and r is None:
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast(np.array(cuts))

        @F.pandas_udf("int")
        def place(k: pd.Series) -> pd.Series:
            return pd.Series((len(shared.value) - np.searchsorted(shared.value, k.to_numpy())).astype("int32"))

        r = place("k")
    keyed = keyed.withColumn("r", r if r is not None else F.lit(0))
    tops = ids.withColumn("r", r if r is not None else F.lit(0)).groupBy("r").agg(F.max("k").alias("top")).orderBy("r").collect()
    order = [t.r for t in tops]
    before = {r: order[i - 1] for i, r in enumerate(order)}
    if not tops:
        return keyed.withColumn("copy", F.lit(False))
    edges = docs.sparkSession.createDataFrame([(t.top, before[t.r]) for t in tops], "k long, before int")
    copies = keyed.join(F.broadcast(edges), "k").select("doc_id", "text", "k", F.col("before").alias("r"), F.lit(True).alias("copy"))
    both = keyed.withColumn("copy", F.lit(False)).unionByName(copies)
    return both.repartition(max(1, len(order)), "r").sortWithinPartitions("r", "copy", F.desc("k"), "text")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 500)

    def run(batches):
        held = None  # the last row of the batch before: (r, doc_id, text, fingerprint), whose next row is still to come
        for b in batches:
            rows = list(zip(b["r"], b["copy"], b["doc_id"], b["text"], fingerprints(list(b["text"])), strict=True))
            pairs = []
            for r, copy, doc_id, text, f in rows:
                if held and held[0] == r:
                    pairs.append((held[1:], (text, f)))
                held = None if copy else (r, doc_id, text, f)
            edited = [t[: len(t) - (k := len(t) // 3)] + after[:k] for (_, t, _), (after, _) in pairs]
            marks = fingerprints(edited)
            out = [(d, len(t), sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_string(f), as_string(g), likeness(f, g), likeness(f, h)) for ((d, t, f), (_, h)), e, g in zip(pairs, edited, marks, strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_ranges(table(spark, sf_dir, "documents")).select("r", "copy", F.col("doc_id").cast("string"), "text").mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
