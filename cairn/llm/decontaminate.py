"""Benchmark decontamination by spaced seeds: hash fixed masks of token positions, join, verify around the hits.

The masks lose nothing: every stretch that the thresholds accept holds a seed of equal words. A test enumerates this up to
25 words; a longer one splits into two of 13 words or more, and what is equal in one of them is no less than in the whole.
Both sides' texts are words of letters and digits, lower-cased. Test items come in blocks of bounded size, each a
sorted table that every task searches; more items make more blocks, not larger ones. Words are compared as 64-bit hashes.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from cairn.llm._common import ship, small_batches, table, text_key

ship(__name__)

#: Each mask keeps 5 of up to 8 neighbouring words, so that changed words fall into gaps or beside it.
MASKS = ["11111", "110111", "11010011"]
#: Least words of an overlap (or the whole item, if that has fewer, SHORTEST at least); least share of equal words in it.
OVERLAP, SHORTEST, EQUAL = 13, 8, 0.8
#: Words of test items in a block.
BLOCK = 1 << 20
#: Hits that are looked at together, and the words before and behind a hit's first that an accepted stretch around it can hold.
CHUNK, AROUND = 1 << 13, np.arange(1 - 2 * OVERLAP, 2 * OVERLAP)
#: A seed with more hits than this in one text has its diagonals counted all at once.
MANY = 1 << 14
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def _words(text) -> np.ndarray:
    found = WORD.findall((text if isinstance(text, str) else "").lower().encode("utf-8", "replace"))
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def _seeds(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(h) - offsets[-1]
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for o in offsets if n > 0 else ():
            out = (out ^ h[o : o + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _index(items: list) -> tuple:
    """All items' words one after another, with ends; and each mask's sorted seeds with their positions."""
    words = [_words(t) for _, t in items]
    ends = np.cumsum([len(w) for w in words])
    h = np.concatenate([*words, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(words)), [len(w) for w in words])
    seeds = []
    for m in MASKS:
        offsets = np.flatnonzero(np.array(list(m)) == "1")
        s = _seeds(h, offsets)
        at = np.flatnonzero(item[: len(s)] == item[offsets[-1] :][: len(s)]) if len(s) else np.zeros(0, int)
        order = np.argsort(s[at], kind="stable")
        near = np.zeros(1 << 20, bool)  # whether any seed starts with these 20 bits: spares most searches
        near[s[at] >> np.uint64(44)] = True
        seeds.append((offsets, s[at][order], at[order], near))
    return [i for i, _ in items], h, item, ends, seeds


def _dense(places: np.ndarray, q: np.ndarray, length: int, index: tuple) -> set[tuple[int, int]]:
    """(diagonal, item) of all hits of one seed, at these places of a text of so many words and q of the items.

    Its hits on each diagonal are the correlation of its places on both sides, so their product is never listed.
    """
    _, _, item, ends, _ = index
    out: set[tuple[int, int]] = set()
    text = np.bincount(places, minlength=length).astype(float)
    for i in np.unique(item[q]).tolist():
        start = ends[i - 1] if i else 0
        mine = q[item[q] == i] - start
        size = int(ends[i] - start)
        n = 1 << (length + size).bit_length()
        hits = np.fft.irfft(np.fft.rfft(text, n) * np.fft.rfft(np.bincount(size - 1 - mine, minlength=size), n), n)
        at = np.flatnonzero(hits[: length + size] > 0.5)
        out.update(zip((at - (size - 1) - start).tolist(), [i] * len(at), strict=True))
    return out


def _likely(w: np.ndarray, index: tuple) -> set[tuple[int, int]]:
    """(diagonal, item) of the hits with as many equal words around them as the shortest stretch accepted there holds,
    and of all hits of seeds that have very many."""
    _, h, item, ends, seeds = index
    out: set[tuple[int, int]] = set()
    for offsets, keys, at, near in seeds:
        s = _seeds(w, offsets)
        places = np.flatnonzero(near[s >> np.uint64(44)])
        left, right = np.searchsorted(keys, s[places]), np.searchsorted(keys, s[places], "right")
        some = right > left
        places, left, right = places[some], left[some], right[some]
        if int((right - left).sum()) > MANY:
            _, back, n = np.unique(left, return_inverse=True, return_counts=True)
            many = n[back] * (right - left) > MANY
            for first in np.unique(left[many]).tolist():
                own = left == first
                out |= _dense(places[own], at[first : int(right[own][0])], len(w), index)
            places, left, right = places[~many], left[~many], right[~many]
        upto = np.cumsum(right - left)
        for k in range(0, int(upto[-1]) if len(upto) else 0, CHUNK):
            hit = np.arange(k, min(k + CHUNK, int(upto[-1])))
            j = np.searchsorted(upto, hit, "right")
            p, q = places[j], at[right[j] - (upto[j] - hit)]
            a, b = p[:, None] + AROUND, q[:, None] + AROUND
            inside = (a >= 0) & (a < len(w)) & (b >= 0) & (b < len(h))
            a, b = np.where(inside, a, 0), np.where(inside, b, 0)
            same = inside & (w[a] == h[b]) & (item[b] == item[q][:, None])
            i = item[q]
            size = ends[i] - np.where(i > 0, ends[i - 1], 0)
            ok = same.sum(1) >= EQUAL * np.minimum(OVERLAP, size) - 1e-9
            out.update(zip((p - q)[ok].tolist(), i[ok].tolist(), strict=True))
    return out


def _overlaps(w: np.ndarray, index: tuple) -> dict[int, tuple[int, int]]:
    """item -> (longest verified overlap, equal words in it)."""
    ids, h, _, ends, _ = index
    found: dict[int, tuple[int, int]] = {}
    meets = []
    for diagonal, i in _likely(w, index):
        start = int(ends[i - 1]) if i else 0
        lo, hi = max(start, -diagonal), min(int(ends[i]), len(w) - diagonal)
        meets.append((lo - hi, diagonal, i, lo, hi, int(ends[i]) - start))
    for _, diagonal, i, lo, hi, size in sorted(meets):
        if (hi - lo, hi - lo) <= found.get(ids[i], (0, 0)):
            continue  # nothing better on a diagonal this short
        same = w[lo + diagonal : hi + diagonal] == h[lo:hi]
        # The longest stretch with at least EQUAL of its words equal, both ends being equal: prefix sums, least first.
        score = np.concatenate(([0.0], np.cumsum(same - EQUAL)))
        least = np.minimum.accumulate(score)
        first = np.searchsorted(-least, -score - 1e-9)
        length = np.arange(len(score)) - first
        k = int(np.argmax(length))
        best = (int(length[k]), int(same[first[k] : k].sum()))
        if best[0] >= max(SHORTEST, min(OVERLAP, size)) and best > found.get(ids[i], (0, 0)):
            found[ids[i]] = best
    return found


def _blocks(benchmark: DataFrame, block: int):
    """The index of each block of items, broadcast; items of null text are in none."""
    items = benchmark.select(F.col("item_id").cast("string"), "text").filter("text IS NOT NULL")
    n = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + n // (4 * block)
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(_index(sorted((tuple(r) for r in part), key=str)))


def overlaps(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per pair: doc_id, item_id, words (of the longest overlap), equal_words.

    An overlap is a stretch of at least 13 words (8 to 12: only as a whole item) that differ by substitutions in at
    most a fifth. Items under 8 words, and null or empty texts on either side, match nothing. Rows of
    docs that are equal in doc_id and text count as one; so do items that repeat an item_id, by their best overlap. An
    empty table gives no rows. Other columns are ignored.
    """
    out = None
    for index in _blocks(benchmark, block):

        def search(batches, index=index):
            for b in batches:
                rows = [(d, key, i, *x) for d, key, t in zip(b["doc_id"], b["key"], b["text"], strict=True) for i, x in _overlaps(_words(t), index.value).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "key", "item_id", "words", "equal_words"])

        found = docs.select(F.col("doc_id").cast("string"), text_key().alias("key"), "text").mapInPandas(search, "doc_id string, key long, item_id string, words long, equal_words long")
        out = found if out is None else out.unionAll(found)
    best = out.groupBy("doc_id", "key", "item_id").agg(F.max(F.struct("words", "equal_words")).alias("best"))
    return best.select(F.col("doc_id").cast("long"), F.col("item_id").cast("long"), "best.words", "best.equal_words")


def _clean(index):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not _overlaps(_words(t), index.value) for t in texts], dtype=bool)

    return clean


def uncontaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs that overlap no item; null and empty texts stay, and all columns."""
    for index in _blocks(benchmark, block):
        docs = docs.filter(_clean(index)("text"))
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
