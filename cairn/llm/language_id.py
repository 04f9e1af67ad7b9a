"""Language identification by rank-order profiles (Cavnar and Trenkle's out-of-place distance)."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm._common import fresh, held_out, once, ship, small_batches, table

ship(__name__)

#: n-grams of 1 to 3 letters; three code points fill 63 bits, so a gram is one exact integer.
MAX_N, PROFILE, PER_LANG, CHUNK = 3, 400, 2000, 1 << 18
#: Ids of sampled documents that are sent to all tasks, at most.
BROADCAST = 2_000_000


@once
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the whole text, and how often each occurs. Words are runs of letters, padded with a space."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(_letters()[a], a, 32)
    a = np.concatenate(([32], a, [32]))
    a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))].astype(np.uint64)
    parts = []
    for at in range(0, len(a), CHUNK):
        x = a[at : at + CHUNK + 2]
        one, two = x[:CHUNK], x[:-1] | x[1:] << np.uint64(21)
        inner = x[1:-1] != 32
        three = (two[:-1] | x[2:] << np.uint64(42))[inner]
        parts.append(np.unique(np.concatenate((one[one != 32], two[:CHUNK], three)), return_counts=True))
    if len(parts) == 1:
        return parts[0]
    codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _top(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent, ties by code."""
    if len(codes) > 2 * k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:k]]


def learn_profiles(docs: DataFrame, per_lang: int = PER_LANG, k: int = PROFILE) -> dict[str, list[int]]:
    """Each language's k most frequent n-grams in order, from per_lang documents (those of least id hash; whole texts).

    docs: doc_id, text, lang. Rows with null text, lang or doc_id teach nothing.
    """
    known = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # The least hashes of each of 64 parts of a language, then of the language: no task ranks a whole language.
    parts = Window.partitionBy("lang", "part").orderBy("h", "doc_id")
    some = known.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(64))).withColumn("r", F.row_number().over(parts)).filter(F.col("r") <= per_lang)
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = some.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_lang).select("doc_id").distinct()
    few = per_lang * known.select("lang").distinct().count() <= BROADCAST
    sample = docs.select("doc_id", "lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def count(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                new, old = _grams(text), sums.get(lang)
                if old is not None:
                    codes, back = np.unique(np.concatenate((old[0], new[0])), return_inverse=True)
                    new = codes, np.bincount(back, np.concatenate((old[1], new[1]))).astype(np.int64)
                sums[lang] = new
        for lang, (codes, n) in sums.items():
            yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n})

    counts = sample.select("lang", "text").mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counts.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("lang", "r", "code").collect()
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.r)):
        out.setdefault(r.lang, []).append(r.code)
    return out


def predictor(profiles: dict[str, list[int]], k: int = PROFILE):
    """A column function: text to struct(lang, score). Null texts, and texts without a letter, are `und` with score 0."""
    langs = [(lang, np.sort(p := np.array(codes, np.uint64)), np.argsort(p)) for lang, codes in sorted(profiles.items())]

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            top = _top(*_grams(text), k) if isinstance(text, str) and text else ()
            if not len(top) or not langs:
                out.append(("und", 0.0))
                continue
            rank, best = np.arange(len(top)), None
            for lang, codes, ranks in langs:
                i = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
                far = int(np.where(codes[i] == top, np.abs(ranks[i] - rank), k).sum())
                best = min(best, (far, lang)) if best else (far, lang)
            out.append((best[1], 1 - best[0] / (k * len(top))))
        return pd.DataFrame(out, columns=["lang", "score"])

    return predict


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """docs with lang_pred and score; every row stays, other columns too (lang_pred and score are replaced)."""
    own = fresh(docs, "predicted")
    p = docs.withColumn(own, predictor(profiles)("text"))
    return p.withColumns({"lang_pred": F.col(own)["lang"], "score": F.col(own)["score"]}).drop(own)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
