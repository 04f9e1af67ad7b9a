"""Readers and writers of what the pipeline exchanges: file lists, id lists, labels, neighbour lists, arrays, meshes."""

import csv
import io
import json
import math
import operator
import re
import struct
import warnings
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.identity import path_id, render_id

MESHES, IMAGES = ("ply", "obj", "stl", "off"), ("png", "jpg", "jpeg")


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """path, rel, content of the files below folder with one of the extensions, in any case; content is read only if used."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rel = F.when(F.instr("path", folder.rstrip("/") + "/") > 0, F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)).otherwise(F.substring_index("path", "/", -1))
    return f.filter(F.lower("path").rlike(rf"\.({'|'.join(extensions)})$")).select("path", rel.alias("rel"), "content")


def render_groups(files: DataFrame) -> DataFrame:
    """specimen_id, paths (sorted) of rendered views."""
    return files.groupBy(render_id(F.col("rel")).alias("specimen_id")).agg(F.sort_array(F.collect_list("path")).alias("paths"))


def images_by_folder(files: DataFrame) -> DataFrame:
    """specimen_id, paths: each folder at the top is one item; files beside the folders are left out."""
    return files.filter(F.contains("rel", F.lit("/"))).groupBy(F.substring_index("rel", "/", 1).alias("specimen_id")).agg(F.sort_array(F.collect_list("path")).alias("paths"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """row_idx, id: the lines that aren't blank, stripped, in the order of the file (one unsplit file)."""
    lines = spark.read.text(path, wholetext=True)
    every = F.filter(F.transform(F.split("value", r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return lines.select(F.posexplode(every).alias("row_idx", "id")).withColumn("row_idx", F.col("row_idx").cast("long"))


def infer_ids(spark: SparkSession, n: int) -> DataFrame:
    """row_idx and the ids 000, 001 and so on."""
    return spark.range(n).select(F.col("id").alias("row_idx"), F.format_string("%03d", "id").alias("id"))


def read_labels(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """id, label: of a CSV with specimen_id and label, or of lines "id label words". Short lines are errors, or skipped."""
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True)
        if not {"specimen_id", "label"} <= set(df.columns):
            raise ValueError(f"specimen_id and label are needed; {path} has {df.columns}")
        return df.select(F.col("specimen_id").alias("id"), "label")
    words = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).filter(F.trim("value") != "").select(words.alias("w"))
    if lenient:
        t = t.filter(F.size("w") >= 2)
    bad = F.raise_error(F.concat(F.lit("a label is missing: "), F.array_join("w", " ")))
    return t.select(F.when(F.size("w") >= 2, F.col("w")[0]).otherwise(bad.cast("string")).alias("id"), F.array_join(F.slice("w", 2, 1 << 20), " ").alias("label"))


def labels_for(ids: DataFrame, spark: SparkSession, path: str | None) -> DataFrame:
    """ids (row_idx, id) with label: of a file with tabs or commas in its first line by id (of repeated ids the last; others get
    ""), else of one label a line, by position.

    Where there is no file, or it is blank, has another number of lines, or no id of it is known, labels are what stands
    before the first / in ids; if any id has none, there are no labels: all null.
    """
    inferred = ids.withColumn("label", F.when(F.contains("id", F.lit("/")), F.substring_index("id", "/", 1)))
    inferred = inferred.join(F.broadcast(inferred.agg(F.bool_or(F.col("label").isNull() | (F.col("label") == "")).alias("_none")))).withColumn("label", F.when(~F.col("_none"), F.col("label"))).drop("_none")
    if path is None or not _exists(spark, path):
        return inferred
    lines = read_ids(spark, path).withColumnRenamed("id", "line")
    first = lines.filter("row_idx = 0").first()
    if first is None:
        return inferred
    if sep := next((s for s in ("\t", ",") if s in first.line), None):
        w = F.split("line", sep)
        pairs = lines.filter(F.size(w) >= 2).groupBy(w[0].alias("id")).agg(F.max_by(w[1], F.col("row_idx")).alias("label"))
        got = ids.join(pairs, "id", "left").withColumn("label", F.coalesce("label", F.lit("")))
        return got if got.filter("label <> ''").take(1) else inferred
    if lines.count() != ids.count():
        return inferred
    return ids.join(lines.withColumnRenamed("line", "label"), "row_idx")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def scan_tables(spark: SparkSession, folder: str, pattern: str = "knn_*.csv", needed: tuple[str, ...] = (), deep: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of all CSV files below folder (in it, unless deep) whose names fit pattern, and an error row (_file, error) for each bad one.

    Each file has a header of its own: columns meet by name, in any order, and what a file lacks is null. All are strings;
    _file and _row (from 0) are where a row comes from. Bad files lack a needed column, have a blank header, or a
    line of another length than it. Files without rows, or without any byte, give none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "content")
    if not deep:
        files = files.filter(~F.contains(F.substring_index("path", folder.rstrip("/") + "/", -1), F.lit("/")))

    def parse(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    lines = list(csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"))))
                    head = [h.strip() for h in lines[0]] if lines else []
                    if lacks := sorted(set(needed) - set(head)) if head else ["a header"]:
                        raise ValueError(f"lacks {lacks}")
                    rows = [(path, i, dict(zip(head, r, strict=True)), None) for i, r in enumerate(r for r in lines[1:] if r)]
                except Exception as e:  # one bad file is a row of the error table, not the end of the run
                    rows = [(path, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["_file", "_row", "data", "error"])

    out = files.mapInPandas(parse, "_file string, _row long, data map<string, string>, error string")
    names = sorted(r.k for r in out.filter("error IS NULL").select(F.explode(F.map_keys("data")).alias("k")).distinct().collect())
    columns = list(dict.fromkeys([*needed, *names]))
    good = out.filter("error IS NULL").select(*(F.col("data")[c].alias(c) for c in columns), "_file", "_row")
    return good, out.filter("error IS NOT NULL").select("_file", "error")


def read_neighbors(spark: SparkSession, folder: str, merged: str = "merged_knn.csv", needed: tuple[str, ...] = ()) -> DataFrame:
    """Neighbour lists of a folder: of the file merged, if it is there, else of all knn_*.csv below; see scan_tables.

    Nothing to read, or a bad file, is an error.
    """
    one = f"{folder.rstrip('/')}/{merged}"
    good, bad = scan_tables(spark, one if _exists(spark, one) else folder, merged if _exists(spark, one) else "knn_*.csv", needed)
    if first := bad.orderBy("_file").first():
        raise ValueError(f"{first['_file']}: {first['error']}")
    if not good.take(1):
        raise ValueError(f"no rows in {merged} or knn_*.csv below {folder}")
    return good


def match_rates(spark: SparkSession, folder: str, pattern: str = "knn_*.csv") -> tuple[DataFrame, DataFrame]:
    """query_id, category, topk, match_count, match_rate of each file of a query's neighbours in folder, and its bad files.

    A file is of the query in its first row; a neighbour matches if its id has the same first part before /.
    """
    rows, bad = scan_tables(spark, folder, pattern, ("query_id", "neighbor_id"), deep=False)
    category = lambda c: F.substring_index(c, "/", 1)
    per = rows.join(rows.filter("_row = 0").select("_file", F.col("query_id").alias("_query")), "_file")
    match = (category(F.col("neighbor_id")) == category(F.col("_query"))).cast("int")
    out = per.groupBy("_file", F.col("_query").alias("query_id")).agg(F.count("*").alias("topk"), F.sum(match).alias("match_count"), F.avg(match).alias("match_rate"))
    return out.select("query_id", category(F.col("query_id")).alias("category"), "topk", "match_count", "match_rate"), bad


def read_overall(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the overall list of a JSON summary."""
    return spark.read.option("multiLine", True).json(path).select(F.inline("overall"))


def read_arrays(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Feature arrays (.npy, rank 2 or 3) below folder: (specimen_id, view_idx, token_idx, feature), and (path, error)."""
    files = list_files(spark, folder, ("npy",)).filter(~F.col("rel").rlike(r"(^|/)embeddings\.npy$")).select("rel", "path", "content")

    def parse(batches):
        for b in batches:
            rows = []
            for rel, path, content in zip(b["rel"], b["path"], b["content"], strict=True):
                try:
                    a = np.load(io.BytesIO(content))
                    if a.ndim < 2:
                        raise ValueError(f"rank {a.ndim}")
                    a = a.reshape(a.shape[0], -1, a.shape[-1])
                    rows += [(rel, path, v, t, a[v, t].astype(float).tolist(), None) for v in range(a.shape[0]) for t in range(a.shape[1])]
                except Exception as e:  # one bad file is a row of the error table, not the end of the run
                    rows.append((rel, path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["rel", "path", "view_idx", "token_idx", "feature", "error"])

    out = files.mapInPandas(parse, "rel string, path string, view_idx int, token_idx int, feature array<double>, error string")
    good = out.filter("error IS NULL").select(path_id(F.col("rel")).alias("specimen_id"), "view_idx", "token_idx", "feature")
    return good, out.filter("error IS NOT NULL").select("path", "error")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """row_idx, embedding of one rank-2 .npy file."""

    def parse(batches):
        for b in batches:
            for content in b["content"]:
                a = np.load(io.BytesIO(content)).astype(float)
                for at in range(0, len(a), 4096):
                    yield pd.DataFrame({"row_idx": np.arange(at, min(at + 4096, len(a))), "embedding": a[at : at + 4096].tolist()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "row_idx long, embedding array<double>")


def _mesh(name: str, content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Points and triangles of an ASCII OFF, OBJ, STL or PLY file, or of a binary STL."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "stl" and not (content[:5] == b"solid" and b"facet" in content[:1024]):
        n = struct.unpack("<I", content[80:84])[0]
        t = np.frombuffer(content[84 : 84 + 50 * n], np.dtype([("n", "<3f4"), ("p", "<9f4"), ("a", "<u2")]))
        return t["p"].reshape(-1, 3).astype(float), np.arange(3 * n).reshape(-1, 3)
    lines = [x.split() for x in content.decode("utf-8", "replace").splitlines() if x.strip() and not x.startswith("#")]
    if kind == "obj":
        pts = [x[1:4] for x in lines if x[0] == "v"]
        faces = [[int(v.split("/")[0]) for v in x[1:]] for x in lines if x[0] == "f"]
        faces = [[v - 1 if v > 0 else v + len(pts) for v in f] for f in faces]
    elif kind == "stl":
        pts = [x[1:4] for x in lines if x[0] == "vertex"]
        faces = np.arange(len(pts)).reshape(-1, 3).tolist()
    else:
        if kind == "off":  # the counts may stand right behind OFF
            head = lines[0][0][3:]
            lines = ([[head, *lines[0][1:]]] if head else [lines[0][1:]] if len(lines[0]) > 1 else []) + lines[1:]
            n, m = int(lines[0][0]), int(lines[0][1])
            body = lines[1:]
        else:
            sizes = {x[1]: int(x[2]) for x in lines if x[0] == "element"}
            n, m = sizes.get("vertex", 0), sizes.get("face", 0)
            body = lines[next(i for i, x in enumerate(lines) if x[0] == "end_header") + 1 :]
        pts, faces = [x[:3] for x in body[:n]], [[int(v) for v in x[1 : 1 + int(x[0])]] for x in body[n : n + m]]
    triangles = [[f[0], f[i], f[i + 1]] for f in faces for i in range(1, len(f) - 1)]
    points = np.array(pts, float).reshape(-1, 3)
    if not len(points):
        raise ValueError("no points")
    return points, np.array(triangles, int).reshape(-1, 3)


def read_meshes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points (specimen_id, point_idx, x, y, z), triangles (specimen_id, ax .. cz) and errors (specimen_id, error)."""
    files = list_files(spark, folder, MESHES).select(path_id(F.col("rel")).alias("specimen_id"), "rel", "content")

    def parse(batches):
        for b in batches:
            for sid, rel, content in zip(b["specimen_id"], b["rel"], b["content"], strict=True):
                try:
                    p, t = _mesh(rel, content)
                    yield pd.DataFrame({"specimen_id": sid, "kind": "point", "v": p.tolist(), "error": None})
                    yield pd.DataFrame({"specimen_id": sid, "kind": "triangle", "v": p[t].reshape(-1, 9).tolist(), "error": None})
                except Exception as e:  # one bad file is a row of the error table, not the end of the run
                    yield pd.DataFrame({"specimen_id": [sid], "kind": ["error"], "v": [None], "error": [str(e)]})

    out = files.mapInPandas(parse, "specimen_id string, kind string, v array<double>, error string")
    points = out.filter("kind = 'point'").select("specimen_id", *(F.col("v")[i].alias(c) for i, c in enumerate("xyz")))
    triangles = out.filter("kind = 'triangle'").select("specimen_id", *(F.col("v")[i].alias(c) for i, c in enumerate(a + b for a in "abc" for b in "xyz")))
    return points, triangles, out.filter("kind = 'error'").select("specimen_id", "error")


def write_neighbors(knn: DataFrame, path: str) -> None:
    """One folder for each query, CSV with a header."""
    knn.write.partitionBy("query_id").option("header", True).mode("overwrite").csv(path)


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """df as CSV with a header, JSON lines or Parquet. An empty table still has its columns in CSV and Parquet."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def resolve_file(spark: SparkSession, folder: str, patterns: list[str], fallback: tuple[str, ...] = ()) -> str:
    """folder, if it is a file; else the file below it whose name fits one of patterns, else one of fallback (`*` and `?`): the
    least deep, then the first by name. Several that fit, and a fallback, are warned of."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        raise FileNotFoundError(f"{folder} does not exist")
    if system.getFileStatus(place).isFile():
        return folder
    files = list_files(spark, folder, (r"[^./]+",)).select("path", "rel", F.substring_index("rel", "/", -1).alias("name"))
    for some in filter(None, (patterns, fallback)):
        fits = [F.col("name").rlike("^" + re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") + "$") for p in some]
        depth = F.length("rel") - F.length(F.replace("rel", F.lit("/")))
        found = files.filter(reduce(operator.or_, fits)).agg(F.min_by("path", F.struct(depth, "rel")).alias("path"), F.count("*").alias("n")).first()
        if found.n:
            if found.n > 1 or some is fallback:
                warnings.warn(f"{found.n} files below {folder} fit {some}: {found.path} is taken", stacklevel=2)
            return found.path
    raise FileNotFoundError(f"nothing below {folder} fits {patterns} or {list(fallback)}")


def read_rates(spark: SparkSession, path: str, needed: tuple[str, ...]) -> DataFrame:
    """A CSV report with types as found; an error if it lacks one of the columns."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    if lacks := sorted(set(needed) - set(df.columns)):
        raise ValueError(f"{path} lacks {lacks}")
    return df


def write_object(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON object as one file, over one that is there: of a report's few values, never of a table's rows. NaN is null."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return None if isinstance(x, float) and not math.isfinite(x) else x

    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(json.dumps(plain(values), ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()
