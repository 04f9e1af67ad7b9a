"""Spelling variants by full neighbourhood generation.

Every word emits its distinct deletions, replacements and insertions over the alphabet that the words use; those that are
words themselves are its near words, and an equality join finds them: no distance is computed. The neighbourhood of a word of
L letters over an alphabet of A has about 2 L A members, so they are made as hashes first, in arrays: F and G being the
hashes of what stands before and behind a place, each member's hash takes two products. A Bloom filter of the vocabulary
lets few but words pass, and only these members are spelled out and joined. If the vocabulary is too large for the filter,
more of them pass and are joined; the result is the same.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import Scratch, cut, holds, key_filter, mix, ship, small_batches, table
from cairn.llm._sql import CRC_TABLE, crc32_sql

ship(__name__)

#: The contract's values: shortest word, least occurrences, one run in SLIP loses a code point, how much more frequent a form is.
LEAST, TWICE, SLIP, TIMES = 7, 2, 31, 10
#: Members of neighbourhoods in one array; words whose counts a task holds before it passes them on.
CHUNK, HELD = 1 << 20, 200_000
P = 0x9E3779B97F4A7C15


def runs(doc_id, text: str | None, least: int) -> Counter:
    """The words of a text with their occurrences: runs of letters, lower-cased in A-Z only, of which one in SLIP loses a code point."""
    low = (text or "").encode("utf-8", "replace").lower().decode()
    seed, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    # A run cannot lose letters and still be a word unless it has that many before.
    for w, n in Counter(re.findall("[A-Za-zÀ-ÿ]{%d,}" % least, low)).items():
        h = zlib.crc32(w.encode(), seed)
        if h % SLIP == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        if len(w) >= least:
            out[w] += n
    return out


def vocabulary(docs: DataFrame, least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """word, n over whole texts. Null texts have no words; a null doc_id counts as "None"; repeated rows count again."""

    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                held.update(runs(i, t, least))
                if len(held) >= HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    ids = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).alias("doc_id"), "text")
    return ids.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= twice)


def _values(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(1))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.multiply.accumulate(np.full(n, P, np.uint64))
    return out


def _letters(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def word_keys(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word: its letters' values times falling powers, mixed."""
    out = np.zeros(len(words), np.uint64)
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    with np.errstate(over="ignore"):
        for size, at in by.items():
            if size:
                v = _values(_letters([words[i] for i in at]))
                out[at] = (v * _powers(size)[:size][::-1]).sum(1, dtype=np.uint64)
    return mix(out)


def neighbourhood(words: list[str], alphabet: str):
    """Yields (rows, members, keys) of the distinct members of the words' neighbourhoods, words of one length at a time.

    members: a function that spells out those at given places of keys. Rows are places in words.
    """
    letters = np.array([ord(c) for c in alphabet], np.uint32)
    value, by = _values(letters), {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for size, at in by.items():
        step = max(1, CHUNK // ((size + 1) * (len(alphabet) + 1)))
        span = max(1, CHUNK // (len(alphabet) + 1))
        power = _powers(size + 1)
        for k in range(0, len(at), step):
            own = np.array(at[k : k + step])
            m = _letters([words[i] for i in own])
            with np.errstate(over="ignore"):
                v = _values(m)
                # before[:, i] hashes the i letters before place i; behind[:, i] those from place i on.
                up = v * power[:size][::-1]
                behind = np.zeros((len(own), size + 1), np.uint64)
                behind[:, :size] = np.cumsum(up[:, ::-1], 1, dtype=np.uint64)[:, ::-1]
                before = behind[:, :1] - behind  # times power[size - i]
                # One word of very many letters is taken in spans of places.
                for lo in range(0, size + 1, span):
                    hi = min(lo + span, size + 1)
                    yield from _members(words, own, m, before, behind, power, letters, value, lo, hi, size)


def _members(words, own, m, before, behind, power, letters, value, lo, hi, size):
    place = np.arange(lo, hi)
    inner = place[place < size]
    # What stands before a place keeps its hash times the power of what is behind it, which one letter more or less shifts.
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(P, -1, 1 << 64))
        if len(inner):
            # Of equal neighbours, only the first is deleted.
            new = np.ones((len(own), len(inner)), bool)
            first = inner > 0
            new[:, first] = m[:, inner[first]] != m[:, inner[first] - 1]
            keys = mix(before[:, inner] * inverse + behind[:, inner + 1])
            r, c = np.nonzero(new)
            yield own[r], (lambda x, r=r, c=c: [words[own[a]][: inner[b]] + words[own[a]][inner[b] + 1 :] for a, b in zip(r[x], c[x], strict=True)]), keys[r, c]
            # Replacements by another letter.
            keys = mix((before[:, inner] + behind[:, inner + 1])[:, :, None] + (power[size - 1 - inner][:, None] * value[None, :])[None])
            r, c, a = np.nonzero(m[:, inner][:, :, None] != letters)
            yield own[r], (lambda x, r=r, c=c, a=a: [words[own[i]][: inner[j]] + chr(letters[k]) + words[own[i]][inner[j] + 1 :] for i, j, k in zip(r[x], c[x], a[x], strict=True)]), keys[r, c, a]
        # A letter before an equal one makes what the same letter behind it makes: only the latter is emitted.
        keys = mix((before[:, place] * np.uint64(P) + behind[:, place])[:, :, None] + (power[size - place][:, None] * value[None, :])[None])
        new = np.ones(keys.shape, bool)
        new[:, : len(inner)] = m[:, inner][:, :, None] != letters
        r, c, a = np.nonzero(new)
        yield own[r], (lambda x, r=r, c=c, a=a: [words[own[i]][: place[j]] + chr(letters[k]) + words[own[i]][place[j] :] for i, j, k in zip(r[x], c[x], a[x], strict=True)]), keys[r, c, a]


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n for each pair of words (word, n; each word once) that differ by one insertion, deletion or replacement, both ways.

    The alphabet is that of the words; it comes to the driver, one row for each letter. A word has no more near words than its
    neighbourhood has members, so no group grows with the corpus. Read the result before words' table goes.
    """
    spark = words.sparkSession
    alphabet = "".join(sorted(r.c for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect() if r.c))

    @F.pandas_udf("long")
    def key(w: pd.Series) -> pd.Series:
        return pd.Series(word_keys(w.tolist()).view(np.int64))

    known = spark.sparkContext.broadcast(key_filter(words.select(key("word").alias("h")), 64))

    def emit(batches):
        for b in batches:
            ws, ns = b["word"].tolist(), b["n"].to_numpy()
            for rows, members, keys in neighbourhood(ws, alphabet):
                x = np.nonzero(holds(known.value, keys))[0]
                if len(x):
                    yield pd.DataFrame({"near": members(x), "word": [ws[i] for i in rows[x]], "n": ns[rows[x]]})

    # Words come in parts of equal numbers: the work is in the neighbourhoods, not in the rows.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = words.select("word", "n").repartition(parts, "word").mapInPandas(emit, "near string, word string, n long")
    return pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def variants(docs: DataFrame, least: int = LEAST, twice: int = TWICE, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text).

    form: the near word of largest n (ties: least in code-point order), if it has times as many occurrences; root: the end of
    the chain of forms. Counts grow along a chain, so it ends. No words: no rows; docs' other columns are ignored.
    """
    with Scratch(docs.sparkSession) as s:
        words = s.cut(vocabulary(docs, least, twice))
        best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
        got = words.join(best, "word", "left")
        good = -F.col("b.m") >= times * F.col("n")
        out = s.cut(got.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("b.near")).alias("form"), F.when(good, -F.col("b.m")).alias("form_n")))
        chains = s.cut(out.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
        while True:
            # Each round doubles what a chain has followed; counts grow tenfold a step, so there are few rounds.
            onward = chains.join(chains.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
            after = s.cut(onward.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            s.drop(chains)
            if not after.filter("moved").take(1):
                break
            chains = after.drop("moved")
            s.paths[id(chains)] = chains, s.paths.pop(id(after))[1]
        ends = after.select("word", "root")
        return cut(out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return variants(table(spark, sf_dir, "documents"))


#: SQL finds near words from the words' deletions, by place: two words are near if one is a deletion of the other, or if they lack the same place's letter and are equal.
ORACLE = {
    "op11_spelling": f"""
WITH RECURSIVE {CRC_TABLE},
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
low AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS k FROM found GROUP BY ALL),
hashed AS (SELECT r, k, {crc32_sql("doc_id::varchar || ':' || r")} AS h FROM low, crc WHERE length(r) >= 7),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::bigint) || substr(r, (h % length(r))::bigint + 2) ELSE r END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::bigint AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM places),
near AS (
SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.d = b.word
UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.d = b.word),
best AS (SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, near, near_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0)::bigint AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END::bigint AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
}
