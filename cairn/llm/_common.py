"""What the operators of this subpackage share: inputs, the held-out fold, lineage cuts, key filters, joins on hot keys."""

import sys
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: A filter of keys has 16 bits for each, 2**28 (32 MB) at most; if it fills up, it lets through more but loses nothing.
LEAST_BITS, MOST_BITS = 16, 28
#: A key of over 1/HOT of the rows is hot: there are HOT such keys at most.
HOT = 1000


def ship(name: str) -> None:
    """Functions of this module travel by value: executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def once(f):
    """f, keeping what it returned for the same arguments; unlike functools.cache, it travels by value."""
    kept: dict = {}

    def g(*args):
        if args not in kept:
            kept[args] = f(*args)
        return kept[args]

    return g


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df lacks."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, mod 5, is 0. A null id is never learned from, so it counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Arrow batches of few rows and few bytes, so that long texts stay within a Python worker's memory.

    The session keeps the setting, as Spark reads it when the returned DataFrame is run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. Where none is named: the warehouse's, or a temporary one in local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        own = tempfile.mkdtemp() if context.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared checkpoint folder: its lineage ends, and lost executors lose nothing."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Cuts whose tables are deleted when the block ends; what outlives it must be cut by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self):
        return self

    def cut(self, df: DataFrame) -> DataFrame:
        out, path = _written(df)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that this block cut, and no others."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *error):
        self.drop(*(t for t, _ in list(self.paths.values())))


def join_counted(rows: DataFrame, one: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with one on key; one has each key once, and in count how many of the rows have it, total at most.

    Keys of over 1/HOT of the total are broadcast, HOT rows at most, so no task gets all rows of a hot key.
    """
    hot = F.col(count) > total / HOT
    many = rows.join(F.broadcast(one.filter(hot)), key)
    few = rows.join(F.broadcast(one.filter(hot).select(key)), key, "left_anti").join(one.filter(~hot), key)
    return many.unionByName(few)


def text_key(text="text"):
    """With doc_id, tells rows apart that repeat a doc_id; rows equal in both count as one document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, where words are what space and \\t to \\r part; lower: A-Z only."""
    b = (text or "").encode("utf-8", "replace")
    words = (b.lower() if lower else b).split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Bits of h spread over all 64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k neighbours in h."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]) if n > 0 else out
    return out


def _cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(64 - bits)
    return (keys >> top).astype(np.int64), (keys << np.uint64(bits) >> top).astype(np.int64)


def key_filter(keys: DataFrame, each: int = 16) -> tuple[int, np.ndarray]:
    """A Bloom filter of the keys (column h, a 64-bit hash as long), as its size in bits and itself: two bits for each key, of each."""
    bits = min(MOST_BITS, max(LEAST_BITS, (each * keys.count()).bit_length()))
    top = 64 - bits
    cells = F.array(F.shiftrightunsigned("h", top), F.shiftrightunsigned(F.shiftleft("h", bits), top))
    v = F.col("c") + 1
    rows = keys.select(F.explode(cells).alias("c")).groupBy(F.bitmap_bucket_number(v).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("m")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        at = (r.b - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r.m), np.uint8)
    return bits, out


def holds(packed: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Whether the filter holds each key; true for every key that was put in, and for few others."""
    bits, cells = packed
    a, b = _cells(keys, bits)
    return (cells[a >> 3] >> (a & 7).astype(np.uint8)) & (cells[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
