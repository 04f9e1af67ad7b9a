"""What iterative operators share: tables between steps, row numbers, components, and pointers to follow.

Each step's table is written to the shared checkpoint folder, which ends its lineage and outlives lost executors. Keys named by
`by` are never null.
"""

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pointers that one task follows at a time.
SPAN = 1 << 16


class Steps:
    """Tables of an operator's steps. keep() outlives the block; what cut() wrote is deleted when it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            own = tempfile.mkdtemp() if context.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
            context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
        self.root = context._jsc.sc().getCheckpointDir().get()

    def __enter__(self):
        return self

    def _written(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.root}/{uuid.uuid4().hex}.parquet"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self._written(df)[0]

    def cut(self, df: DataFrame) -> DataFrame:
        out, path = self._written(df)
        self.paths.append(path)
        return out

    def __exit__(self, *error):
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def together(rows: DataFrame, by: list[str], f, schema: str, least: int = SPAN) -> DataFrame:
    """What f makes of frames of whole groups by by: a large one, or small ones until they have least rows.

    A frame's column `group` numbers its groups, so that f need not be called for each. Groups are dealt by hash over a number of
    tasks that follows the cores, not the bytes: thousands of small trees take long, but are few bytes.
    """

    def frame(parts: list[pd.DataFrame]) -> pd.DataFrame:
        g = pd.concat(parts, ignore_index=True)
        return f(g.assign(group=g.groupby(by, sort=False).ngroup().to_numpy(np.int64)))

    def run(batches):
        ready, last, size = [], [], 0
        for batch in batches:
            if not len(batch):
                continue
            own = (batch[by] == batch[by].iloc[-1]).all(axis=1).to_numpy()
            start = int(np.argmax(own))
            if last and start == 0 and (last[0][by].iloc[0] == batch[by].iloc[0]).all():
                last.append(batch)
                continue
            ready += [*last, batch[:start]]
            size += sum(map(len, last)) + start
            last = [batch[start:]]
            if size >= least:
                yield frame(ready)
                ready, size = [], 0
        if last:
            yield frame([*ready, *last])

    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, held(*by)).sortWithinPartitions(*by).mapInPandas(run, schema)


def held(*by: str) -> Column:
    """A key to deal rows by, for tasks that need whole groups. By the columns themselves, of a join by them into as many partitions,
    Spark takes the dealing for done, and may then read that join's rows where they lie, groups in pieces."""
    return F.xxhash64(*by)


def keyed(g: pd.DataFrame, *columns: str) -> list[np.ndarray]:
    """Ids in columns, from -1 up, as numbers that differ between a frame's groups; those of one group keep their order."""
    width = 2 + max(int(g[c].max()) for c in columns) if len(g) else 2
    return [g["group"].to_numpy() * width + g[c].to_numpy(np.int64) + 1 for c in columns]


def numbered(rows: DataFrame, by: list[str], order: list[str], steps: Steps, name: str = "idx", total: str = "n") -> DataFrame:
    """rows with their number from 0 within by, in order, and how many there are.

    Rows are dealt into ranges; each range numbers its own, after the sizes of those before it. No task holds a whole group.
    """
    parts = steps.cut(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    before = F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.groupBy(*by, "_part").agg(F.count("*").alias("_size")).select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_size").over(group).alias(total))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return parts.withColumn("_own", own).join(starts, [*by, "_part"]).withColumn(name, F.col("_own") + F.col("_start")).drop("_own", "_start", "_part")


def components(edges: DataFrame, by: list[str], steps: Steps) -> DataFrame:
    """by, node, component (its smallest node) for the nodes of edges (by, a, b: long), by alternating large and small stars."""
    e = steps.cut(edges.select(*by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.least("u", F.min("v")).alias("m"))
        large = steps.cut(both.join(least, [*by, "u"]).filter("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(lower, [*by, "u"]).select(*by, F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = steps.cut(small.filter("u <> v").distinct())
    return e.select(*by, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(*by, F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def follow(pointers: DataFrame, top: int, steps: Steps, span: int = SPAN) -> DataFrame:
    """tree, id, end: where the chain from id ends. pointers: tree, id, next, with next > id, each id once; ends have no row.

    top: no id reaches it. Tasks follow chains within a span of ids; what leaves its span goes on by joins, each of which doubles
    how far it has come.
    """

    def within(g: pd.DataFrame) -> pd.DataFrame:
        ids, at = keyed(g, "id", "next")
        order = np.argsort(ids)
        g, ids, at = g.iloc[order], ids[order], at[order]
        off = ids - g["id"].to_numpy()
        while True:
            place = np.searchsorted(ids, at)
            inside = (place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == at)
            if not inside.any():
                return pd.DataFrame({"tree": g["tree"].to_numpy(), "id": g["id"].to_numpy(), "end": at - off})
            at = np.where(inside, at[np.minimum(place, len(ids) - 1)], at)

    now = together(pointers.select("tree", "id", "next", F.floor(F.col("id") / span).alias("span")), ["tree", "span"], within, "tree string, id long, end long")
    rounds = max(0, -(-top // span) - 1).bit_length()
    for _ in range(rounds):
        now = steps.cut(now)
        onward = now.select("tree", F.col("id").alias("end"), F.col("end").alias("_next"))
        now = now.join(onward, ["tree", "end"], "left").select("tree", "id", F.coalesce("_next", "end").alias("end"))
    return now
