"""A Merkle manifest of a dataset, level by level as tables.

Rows of a tree (one for each language, then one over their roots) are numbered; numbers divided by the fanout group them;
each group's sorted children are hashed into the parent, until a tree has one node. Then each level's children are
joined with their parent's path, from the root down, and append their siblings: a leaf's path proves that it is in the dataset.

Numbers are given in two steps, so that no task holds a whole tree: rows are dealt into ranges, row_number counts within a
range, and the ranges before it add their sizes. Groups have at most fanout members.
"""

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm._common import Scratch, cut, ship, table
from cairn.llm._sql import CRC_TABLE, crc32_sql

ship(__name__)

FANOUT, TAMPERED = 8, 3


def _digest(*parts) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(text: Column | str = "text") -> Column:
    """The digest of doc_id, source, lang, n_chars and text: each its bytes' count and itself, or - for null."""
    fields = [F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")] + [F.col(text) if isinstance(text, str) else text]
    return _digest(*(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields))


def numbered(rows: DataFrame, order: list[str], s: Scratch) -> DataFrame:
    """rows with idx, from 0 within each tree by order, and n, the tree's number of rows. Rows equal in order take any."""
    parts = s.cut(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("tree", "part").agg(F.count("*").alias("size"))
    tree = Window.partitionBy("tree")
    before = F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("tree", "part", F.coalesce(before, F.lit(0)).alias("start"), F.sum("size").over(tree).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    return parts.withColumn("place", place).join(starts, ["tree", "part"]).withColumn("idx", F.col("place") + F.col("start")).drop("place", "start", "part")


def _grouped(nodes: DataFrame, fanout: int, *own: str) -> DataFrame:
    """tree, idx (the parent's), n (the number of parents), alone, kids, digest. nodes: tree, idx, n, digest and own columns.

    The parent of a tree's only node is that node: alone.
    """
    kids = F.sort_array(F.collect_list(F.struct("idx", "digest", *own)))
    g = nodes.groupBy("tree", F.floor(F.col("idx") / fanout).alias("parent"), "n").agg(kids.alias("kids"))
    alone = F.col("n") == 1
    digest = F.when(alone, F.col("kids")[0]["digest"]).otherwise(_digest(F.array_join("kids.digest", "")))
    return g.select("tree", F.col("parent").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), alone.alias("alone"), "kids", digest.alias("digest"))


def _levels(first: DataFrame, fanout: int, s: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The grouped tables above first, itself grouped, and (tree, digest, level) of the trees' roots: level 0 are parents in first."""
    out, now, roots = [], first, None
    while True:
        top = now.filter("n = 1").select("tree", "digest", F.lit(len(out)).alias("level"))
        roots = top if roots is None else roots.unionByName(top)
        below = now.filter("n > 1").select("tree", "idx", "n", "digest")
        if not below.take(1):
            return out, roots
        now = s.cut(_grouped(below, fanout))
        out.append(now)


def _joined(kids: Column, lo: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.slice(kids, lo, n), lambda k: k["digest"]), "")


def _down(groups: DataFrame, paths: DataFrame) -> DataFrame:
    """A row for each child of groups: tree, subroot, kid, path: (what stands before it in its run, behind it), then its parent's path."""
    kid = groups.join(paths, ["tree", "idx"]).select("tree", "subroot", "alone", "kids", "path", F.posexplode("kids").alias("at", "kid"))
    step = F.struct(_joined(F.col("kids"), F.lit(1), F.col("at")).alias("l"), _joined(F.col("kids"), F.col("at") + 2, F.size("kids")).alias("r"))
    return kid.select("tree", "subroot", "kid", F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(step), "path")).alias("path"))


def _paths(levels: list[DataFrame], roots: DataFrame, fanout: int, s: Scratch) -> DataFrame:
    """tree, idx, subroot, path of every parent in the table below levels. roots: tree, level, subroot, path."""
    mine = lambda k: roots.filter(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("idx"), "subroot", "path")
    now = mine(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        lower = _down(levels[k], now).select("tree", F.col("kid.idx").alias("idx"), "subroot", "path")
        now = s.cut(lower.unionByName(mine(k)))
    return now


def manifest(docs: DataFrame, fanout: int = FANOUT, tampered: Column | None = None, edit: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of docs (doc_id, source, lang, n_chars, text).

    folded_root folds the leaf of what the row holds now through its siblings: edit's text where tampered, else the leaf itself.
    Rows of equal lang and doc_id are ordered by leaf; equal rows each have a leaf. Null doc_ids come first and are not
    tampered with; null lang is a tree of its own. Other columns are ignored; no rows: no rows.
    """
    spark = docs.sparkSession
    # No null stands in a key: '' is before '=' and any language.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    now = leaf_digest() if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(edit)).otherwise(leaf_digest())
    with Scratch(spark) as s:
        leaves = s.cut(docs.select(tree.alias("tree"), "doc_id", leaf_digest().alias("digest"), now.alias("now"), F.monotonically_increasing_id().alias("tie")))
        first = cut(_grouped(numbered(leaves, ["doc_id", "digest", "tie"], s), fanout, "doc_id", "now"))
        levels, roots = _levels(first, fanout, s)
        subroots = s.cut(roots)
        over = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"], s)
        top = s.cut(_grouped(over, fanout, "of"))
        above, ends = _levels(top, fanout, s)
        root = ends.select("digest").first()
        lead = _down(top, _paths(above, ends.select("tree", "level", F.col("digest").alias("subroot"), F.expr("cast(array() AS array<struct<l: string, r: string>>)").alias("path")), fanout, s))
        start = s.cut(subroots.join(lead.select(F.col("kid.of").alias("tree"), "path"), "tree").select("tree", "level", F.col("digest").alias("subroot"), "path"))
        paths = cut(_paths(levels, start, fanout, s))
    rows = _down(first, paths).select("subroot", "path", "kid.*")
    proof = _digest(F.array_join(F.transform("path", lambda p: F.concat(p["l"], p["r"])), ""))
    fold = F.aggregate("path", F.col("now"), lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]).cast("binary"), 256))
    out = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root and root.digest).cast("string").alias("root"), proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return manifest(table(spark, sf_dir, "documents"), FANOUT, hit, F.translate("text", string.ascii_uppercase, string.ascii_lowercase))


def _h(*parts: str) -> str:
    return f"sha256({' || '.join(parts)})"


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode({x}))::varchar || ':' || {x}, '-')"


def _leaf_sql(text: str) -> str:
    return _h(*(_field(x) for x in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)))


ORACLE = {
    "op12_merkle": f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("text")} AS leaf,
  CASE WHEN {crc32_sql("doc_id::varchar")} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS now FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up AS (SELECT 0 AS level, tree, idx, n, leaf AS digest FROM placed
  UNION ALL SELECT level + 1, tree, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY level, tree, idx // 8, n),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (SELECT 0 AS level, idx, n, subroot AS digest FROM subroots
  UNION ALL SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM over WHERE n > 1 GROUP BY level, idx // 8, n),
nodes AS (SELECT tree, level, idx, n, digest FROM up UNION ALL SELECT NULL, level, idx, n, digest FROM over),
steps AS (SELECT tree, level, idx, coalesce(string_agg(digest, '' ORDER BY idx) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(digest, '' ORDER BY idx) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes WHERE n > 1 WINDOW run AS (PARTITION BY tree, level, idx // 8 ORDER BY idx)),
fold AS (SELECT p.doc_id, p.leaf, p.tree AS leaf_tree, p.tree AS tree, p.idx, p.n, 0 AS level, p.now AS h, '' AS proof FROM placed p
  UNION ALL SELECT f.doc_id, f.leaf, f.leaf_tree, CASE WHEN f.n > 1 THEN f.tree END, CASE WHEN f.n > 1 THEN f.idx // 8 ELSE b.idx END, CASE WHEN f.n > 1 THEN (f.n + 7) // 8 ELSE b.n END,
    CASE WHEN f.n > 1 THEN f.level + 1 ELSE 0 END, CASE WHEN f.n > 1 THEN sha256(s.l || f.h || s.r) ELSE f.h END, CASE WHEN f.n > 1 THEN f.proof || s.l || s.r ELSE f.proof END
  FROM fold f LEFT JOIN steps s ON s.tree IS NOT DISTINCT FROM f.tree AND s.level = f.level AND s.idx = f.idx LEFT JOIN subroots b ON b.tree = f.tree WHERE f.n > 1 OR f.tree IS NOT NULL)
SELECT f.doc_id, f.leaf, b.subroot, o.digest AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = o.digest AS verified
FROM fold f JOIN subroots b ON b.tree = f.leaf_tree CROSS JOIN (SELECT digest FROM over WHERE n = 1) o WHERE f.tree IS NULL AND f.n = 1"""
}
