"""Token counts through a digest cache.

A count is stored under two digests: of the normalised content (null is the empty text; nothing else is altered, as any other
change could change the count) and of the tokenizer's version (its file, its library and that library's version). Stored counts
are joined; of the digests that miss, one document each is encoded, and its count is appended to the cache, a Parquet table.

Texts are shuffled only where they may be repeats: a Bloom filter tells the documents to encode from the others, built from
whichever are fewer, and what it cannot tell apart is joined by key.
"""

import hashlib
import uuid
from importlib.metadata import version
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import Scratch, cut, fresh, holds, join_counted, key_filter, once, shared_folder, ship, small_batches, table

ship(__name__)

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: A tokenizer's file is sent to all tasks, up to so many bytes.
MOST = 64 << 20
CACHE = "digest string, tokenizer string, n_tokens long"


def tokenizer(path: str) -> tuple[str, str, bytes]:
    """(version digest, library, file) of a tokenizer: tokenizers for .json, sentencepiece for .model."""
    data, library = Path(path).read_bytes(), {".json": "tokenizers", ".model": "sentencepiece"}[Path(path).suffix]
    if len(data) > MOST:
        raise ValueError(f"{path}: {len(data)} bytes; tokenizers of up to {MOST} are sent to tasks")
    return hashlib.sha256(f"{library} {version(library)} ".encode() + data).hexdigest(), library, data


@once
def _counter(library: str, data: bytes):
    if library == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(data.decode())
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def _encoded(docs: DataFrame, library: str, data) -> DataFrame:
    """digest, n_tokens of docs (digest, text). data: the broadcast file."""

    def run(batches):
        count = _counter(library, data.value)
        for b in batches:
            # Texts of about a megabyte at a time, as their tokens are held until they are counted.
            texts, lo, size, out = b["text"].tolist(), 0, 0, []
            for hi, t in enumerate(texts, 1):
                size += len(t)
                if size > 1 << 20 or hi == len(texts):
                    out += count(texts[lo:hi])
                    lo, size = hi, 0
            yield pd.DataFrame({"digest": b["digest"], "n_tokens": np.array(out, np.int64)})

    return docs.select("digest", "text").mapInPandas(run, "digest string, n_tokens long")


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """digest, n_tokens that the cache has for a tokenizer; writers that met may both have stored a digest. No cache: no rows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    rows = spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)
    return rows.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def missing(docs: DataFrame, known: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """keyed docs (doc_id, digest, n_bytes, key), counts of each digest, and (digest, text) of one document for each digest not known.

    A key stands for a document and its text; rows that share it are repeats.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).alias("text")
    whole = docs.select("doc_id", text).withColumn("digest", F.sha2("text", 256)).withColumn("key", F.xxhash64("doc_id", "digest"))
    keyed = cut(whole.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), "key"))
    digests = s.cut(keyed.groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("n")))
    todo = s.cut(digests.join(known.select("digest"), "digest", "left_anti").select("digest", "key"))
    keys = keyed.groupBy("key").agg(F.count("*").alias("n"))
    rest = s.cut(keys.join(todo.select("key", F.lit(True).alias("chosen")), "key", "left").filter("chosen IS NULL OR n > 1").select(F.col("key").alias("h")))
    few = todo.count() <= rest.count()
    shared = spark.sparkContext.broadcast(key_filter(todo.select(F.col("key").alias("h")) if few else rest))

    @F.pandas_udf("boolean")
    def listed(h: pd.Series) -> pd.Series:
        return pd.Series(holds(shared.value, h.to_numpy().view(np.uint64)))

    # Rows that the filter does not hold are decided: all of them stay or, if it lists those to encode, none.
    doubt = whole.filter(listed("key")).join(todo.select("digest", "key"), ["digest", "key"], "left_semi").dropDuplicates(["digest"])
    texts = doubt.select("digest", "text")
    return keyed, digests, texts if few else texts.unionByName(whole.filter(~listed("key")).select("digest", "text"))


def token_counts(docs: DataFrame, model: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text). model: a tokenizer's file; cache: a folder all share.

    Whole texts, without begin, end or added special tokens; null text is empty; nothing is cut off. Other columns are ignored,
    repeated rows repeat, a null doc_id stays. No rows: no rows, and an empty cache.
    """
    spark = docs.sparkSession
    version_digest, library, data = tokenizer(model)
    with Scratch(spark) as s:
        keyed, digests, texts = missing(docs, stored(spark, cache, version_digest), s)
        new = _encoded(texts, library, spark.sparkContext.broadcast(data))
        new.select("digest", F.lit(version_digest).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
        counts = cut(digests.select("digest", "n").join(stored(spark, cache, version_digest), "digest"))
        total = keyed.count()
    n = fresh(keyed, "n")
    out = join_counted(keyed, counts.withColumnRenamed("n", n), "digest", n, total)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that every run encodes every distinct text."""
    small_batches(spark)
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), f"{shared_folder(spark)}/token_counts_{uuid.uuid4().hex}")
