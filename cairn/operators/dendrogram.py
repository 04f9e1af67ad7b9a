"""Where the leaves and links of merge trees stand in a drawing, as tables.

A leaf's place is a sum along its path to the root, taken as chains are followed: within spans by a task, then by joins that
double their reach. The middles of links go from the leaves up, a span of merges at a time.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.steps import SPAN, Steps

# Leaves stand 10 apart from 5 on; colours of clusters by number, of noise, and of items without a cluster.
FIRST, APART = 5.0, 10.0
PALETTE = ("#2563EB", "#DC2626", "#059669", "#D97706", "#7C3AED", "#0891B2", "#DB2777", "#65A30D", "#EA580C", "#4338CA")
NOISE, UNKNOWN = "#9CA3AF", "#111827"


def path_sums(pointers: DataFrame, top: int, steps: Steps, span: int = SPAN) -> DataFrame:
    """tree, id, total: the sum of weights (long) along the chain from id. pointers: tree, id, next, weight, with next > id.

    top: no id reaches it. Each id has one pointer at most; ends have none and no row.
    """

    def within(g: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(g["id"].to_numpy())
        ids, at, total = (g[c].to_numpy()[order] for c in ("id", "next", "weight"))
        while True:
            place = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
            inside = ids[place] == at
            if not inside.any():
                return pd.DataFrame({"tree": g["tree"].iloc[0], "id": ids, "end": at, "total": total})
            at, total = np.where(inside, at[place], at), np.where(inside, total + total[place], total)

    now = pointers.select("tree", "id", "next", "weight").groupBy("tree", F.floor(F.col("id") / span)).applyInPandas(within, "tree string, id long, end long, total long")
    for _ in range(max(0, -(-top // span) - 1).bit_length()):
        now = steps.cut(now)
        onward = now.select("tree", F.col("id").alias("end"), F.col("end").alias("_end"), F.col("total").alias("_more"))
        now = now.join(onward, ["tree", "end"], "left").select("tree", "id", F.coalesce("_end", "end").alias("end"), (F.col("total") + F.coalesce("_more", F.lit(0))).alias("total"))
    return now.select("tree", "id", "total")


def node_places(merges: DataFrame, steps: Steps, span: int = SPAN) -> DataFrame:
    """tree, id, place (from 0) of each node but the root: its first leaf's, in the order in which the tree is walked, left before right.

    merges: tree, n, r, left, right, size; n + r is the number of merge r, less than n the leaves'.
    """
    m = merges.select("tree", "n", "r", "left", "right", "size")
    sizes = m.select("tree", (F.col("n") + F.col("r")).alias("left"), F.col("size").alias("_l"))
    m = m.join(sizes, ["tree", "left"], "left").withColumn("_l", F.coalesce("_l", F.lit(1)))
    sides = F.array(F.struct(F.col("left").alias("id"), F.lit(0).cast("long").alias("weight")), F.struct(F.col("right").alias("id"), F.col("_l").cast("long").alias("weight")))
    up = steps.cut(m.select("tree", "n", (F.col("n") + F.col("r")).alias("next"), F.explode(sides).alias("e")).select("tree", "n", "next", "e.*"))
    top = up.agg(F.max("next")).first()[0] or 0
    return steps.cut(path_sums(up, top + 1, steps, span).withColumnRenamed("total", "place"))


def leaf_places(merges: DataFrame, steps: Steps, span: int = SPAN) -> DataFrame:
    """tree, pos, place of the leaves, as node_places gives it."""
    size = merges.select("tree", "n").distinct()
    return node_places(merges, steps, span).join(size, "tree").filter("id < n").select("tree", F.col("id").alias("pos"), "place")


def _middles(g: pd.DataFrame) -> pd.DataFrame:
    """Each merge's two ends; those that an earlier span or a leaf knows come with the row, others are merges of this span."""
    g = g.sort_values("id")
    found: dict[int, float] = {}
    rows = []
    for i, a, b, x, y in zip(g["id"].tolist(), g["left"].tolist(), g["right"].tolist(), g["x1"].tolist(), g["x2"].tolist(), strict=True):
        x, y = found.get(a, x), found.get(b, y)
        found[i] = (x + y) / 2
        rows.append((i, x, y))
    return pd.DataFrame(rows, columns=["id", "x1", "x2"]).assign(tree=g["tree"].iloc[0])


def links(merges: DataFrame, places: DataFrame, steps: Steps, span: int = SPAN) -> DataFrame:
    """tree, r, x1, x2 (where the left and the right side stand), y1, y2 (their heights), height: a link for each merge.

    It is drawn from (x1, y1) up to height, across to x2 and down to y2. places: leaf_places of merges (tree, n, r, left, right, distance).
    """
    m = steps.cut(merges.select("tree", "n", "r", (F.col("n") + F.col("r")).alias("id"), "left", "right", "distance"))
    leaves = places.select("tree", F.col("pos").alias("id"), (FIRST + APART * F.col("place")).alias("x"))
    known, out = leaves, None
    for s in range((m.agg(F.max("r")).first()[0] or 0) // span + 1):
        part = m.filter(F.floor(F.col("r") / span) == s).select("tree", "id", "left", "right")
        for side, x in (("left", "x1"), ("right", "x2")):
            part = part.join(known.select("tree", F.col("id").alias(side), F.col("x").alias(x)), ["tree", side], "left")
        done = steps.cut(part.groupBy("tree").applyInPandas(_middles, "tree string, id long, x1 double, x2 double"))
        known = known.unionByName(done.select("tree", "id", ((F.col("x1") + F.col("x2")) / 2).alias("x")))
        out = done if out is None else out.unionByName(done)
    heights = m.select("tree", "id", "distance")
    rows = m.join(out, ["tree", "id"])
    for side, y in (("left", "y1"), ("right", "y2")):
        rows = rows.join(heights.select("tree", F.col("id").alias(side), F.col("distance").alias(y)), ["tree", side], "left")
    return rows.select("tree", "r", "x1", "x2", F.coalesce("y1", F.lit(0.0)).alias("y1"), F.coalesce("y2", F.lit(0.0)).alias("y2"), F.col("distance").alias("height"))


def cluster_color(cluster: Column) -> Column:
    """The colour of a cluster's leaves: by its number, of noise (-1), or of no cluster (null)."""
    by_number = F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(cluster, F.lit(len(PALETTE))) + 1).cast("int"))
    return F.when(cluster.isNull(), UNKNOWN).when(cluster == -1, NOISE).otherwise(by_number)


def layout(merges: DataFrame, points: DataFrame, clusters: DataFrame | None = None, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """The leaves (tree, id, place, x, and with clusters also cluster_id and color) and the links of merge trees.

    merges: tree, n, r, left, right, distance, size. points: tree, pos, id; one that is alone in its tree has place 0. clusters:
    id, cluster_id, each id once; items without a row are in no cluster.
    """
    with Steps(merges.sparkSession) as steps:
        places = steps.cut(leaf_places(merges, steps, span))
        leaves = points.select("tree", "pos", "id").join(places, ["tree", "pos"], "left").withColumn("place", F.coalesce("place", F.lit(0).cast("long")))
        leaves = leaves.select("tree", "id", "place", (FIRST + APART * F.col("place")).alias("x"))
        if clusters is not None:
            leaves = leaves.join(clusters.select("id", F.col("cluster_id").cast("long").alias("cluster_id")), "id", "left").withColumn("color", cluster_color(F.col("cluster_id")))
        return steps.keep(leaves), steps.keep(links(merges, places, steps, span))


def legend(leaves: DataFrame) -> DataFrame:
    """name, color, n of the clusters that leaves are in: clusters by number, then noise, then none."""
    each = leaves.groupBy("cluster_id", "color").agg(F.count("*").alias("n"))
    c = F.col("cluster_id")
    name = F.when(c.isNull(), "cluster N/A").when(c == -1, "cluster -1 (noise)").otherwise(F.concat(F.lit("cluster "), c.cast("string")))
    return each.orderBy(c.isNull(), F.coalesce(c == -1, F.lit(False)), c).select(name.alias("name"), "color", "n")
