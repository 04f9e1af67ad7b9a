"""Branches within density clusters: a second hierarchy, over how far a cluster's members are from its centre."""

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from cairn.functions.vectors import doubles, euclidean
from cairn.operators import density, hdbscan
from cairn.operators.knn import knn_within
from cairn.operators.steps import Steps, numbered


def _edges(points: DataFrame, near: int, method: str, metric: str, steps: Steps) -> DataFrame:
    """The lightest spanning trees of the clusters' graphs, where an edge weighs the larger inverse eccentricity of its ends.

    core: each member and its nearest, and the edges of the cluster's lightest tree. full: all pairs no further apart, in mutual
    reachability, than that tree's heaviest edge; pairs of blocks keep their own trees, so they are never listed.
    """
    tree = steps.cut(density.spanning_trees(points, steps, [""], metric))
    if method == "full":
        limit = tree.groupBy("tree").agg(F.max("w").alias("limit"))

        def weigh(d: np.ndarray, rows: list) -> list[np.ndarray]:
            core, far, limit = (density.rows_of(rows, c)[:, 0] for c in ("cores", "closeness", "limit"))
            reach = np.maximum(d, np.maximum(core[:, None], core[None]))
            return [np.where(reach <= limit[0], np.maximum(far[:, None], far[None]), np.inf)]

        return density.spanning_trees(points.join(limit, "tree"), steps, [""], metric, weigh=weigh).filter(F.col("w") < float("inf"))
    pairs = knn_within(points, near, metric).groupBy("tree", "pos").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "near"))), 1, near).alias("e")).select("tree", "pos", F.explode("e.near").alias("near"))
    ends = pairs.select("tree", F.least("pos", "near").alias("a"), F.greatest("pos", "near").alias("b")).unionByName(tree.select("tree", "a", "b")).distinct()
    for c in ("a", "b"):
        ends = ends.join(points.select("tree", F.col("pos").alias(c), F.col("closeness").alias(f"_{c}")), ["tree", c])
    return density.contracted(ends.select("tree", "a", "b", F.greatest("_a", "_b").alias("w")), steps)


def detect(items: DataFrame, c: hdbscan.Config = hdbscan.Config(), least: int | None = None, selection: str = "eom", method: str = "core", sides: bool = False) -> tuple[DataFrame, DataFrame]:
    """Subgroups of items (row_idx, id, embedding), and the branches' persistences.

    id, subgroup_label, subgroup_probability, base_cluster_label, base_cluster_probability, branch_label, branch_probability. A
    cluster's branches are the clusters of its hierarchy by eccentricity (distance from its centre, the mean weighted by
    probability), of least members (min_cluster_size). With two or fewer branches (one, with sides) a cluster is one
    subgroup, its branch label 0 of probability 1; else each branch is one, and the members between them (branch label -1) are
    another. Noise is -1 everywhere, with probability 0. Clusters are numbered as by hdbscan, subgroups in order of cluster
    and branch.

    base_cluster_index, branch_index, branch_persistence: a branch's stability by its size and its largest lambda; a
    cluster without branches has a row of nulls.
    """
    if method not in ("core", "full") or selection not in ("eom", "leaf"):
        raise ValueError("method is core or full, selection eom or leaf")
    least = least or c.min_cluster_size
    with Steps(items.sparkSession) as steps:
        base = steps.cut(hdbscan.cluster(items, c))
        members = items.select("row_idx", "id", doubles("embedding").alias("embedding")).join(base.filter("cluster_id <> -1"), "id").withColumn("tree", F.col("cluster_id").cast("string"))
        centre = members.groupBy("tree").agg(Summarizer.mean(array_to_vector("embedding"), F.col("prob")).alias("m")).select("tree", vector_to_array("m").alias("centre"))
        ecc = euclidean(F.col("embedding"), F.col("centre"))
        members = members.join(centre, "tree").withColumn("closeness", F.when(ecc > 0, 1 / ecc).otherwise(float("inf"))).drop("centre")
        points = steps.cut(numbered(members.select("tree", "row_idx", "id", "embedding", "closeness"), ["tree"], ["row_idx", "id"], steps, "pos"))
        cored = steps.cut(density.core_distances(points.drop("row_idx", "id"), [c.samples], c.metric))
        merges = steps.cut(density.single_linkage(_edges(cored, c.samples, method, c.metric, steps), steps))
        tree = steps.cut(density.condensed(merges.withColumn("least", F.lit(least)), steps))
        config = tree.select("tree").distinct().select("tree", F.col("tree").alias("of"), F.lit(selection == "leaf").alias("leaf"), F.lit(False).alias("root_ok"), F.lit(0.0).alias("epsilon"))
        got = steps.cut(density.selected(tree, config, steps))
        rows, clusters = density.clusters_of(tree, steps)
        size = got.groupBy("tree", "cluster").agg(F.count("*").alias("m"), F.first("label").alias("label"))
        top = rows.join(got.select("tree", F.col("pos").alias("child"), "cluster"), ["tree", "child"]).groupBy("tree", "cluster").agg(F.max("lam").alias("top"))
        strength = clusters.join(size, ["tree", "cluster"]).join(top, ["tree", "cluster"]).select("tree", "label", F.coalesce(F.try_divide("score", F.col("m") * F.col("top")), F.lit(1.0)).alias("branch_persistence"))
        whole = points.select("tree").distinct()
        persistences = whole.join(strength, "tree", "left").select(F.col("tree").cast("int").alias("base_cluster_index"), F.col("label").alias("branch_index"), "branch_persistence")
        count = whole.join(size.groupBy("tree").agg(F.count("*").alias("branches")), "tree", "left").withColumn("split", F.coalesce("branches", F.lit(0)) > (1 if sides else 2))
        mine = points.select("tree", "pos", "id").join(count, "tree").join(got, ["tree", "pos"], "left")
        branch = F.when(F.col("split"), F.coalesce("label", F.lit(-1))).otherwise(0)
        mine = mine.select("id", F.col("tree").cast("int").alias("base"), "split", branch.alias("branch_label"), F.when(F.col("split"), F.coalesce("prob", F.lit(0.0))).otherwise(1.0).alias("branch_probability"))
        # The members between branches come behind their cluster's branches.
        kinds = mine.groupBy("base", "branch_label").agg(F.lit("").alias("tree")).withColumn("late", F.col("branch_label") < 0)
        kinds = numbered(kinds, ["tree"], ["base", "late", "branch_label"], steps, "subgroup", "_n").select("base", "branch_label", "subgroup")
        mine = mine.join(F.broadcast(kinds), ["base", "branch_label"])
        out = base.join(mine.drop("base"), "id", "left")
        within = F.when(F.col("split"), F.when(F.col("branch_label") < 0, F.col("prob")).otherwise(F.col("branch_probability"))).otherwise(F.col("prob"))
        out = out.select("id", F.coalesce(F.col("subgroup").cast("int"), F.lit(-1)).alias("subgroup_label"), F.coalesce(within, F.lit(0.0)).alias("subgroup_probability"), F.col("cluster_id").alias("base_cluster_label"), F.col("prob").alias("base_cluster_probability"), F.coalesce("branch_label", F.lit(-1)).alias("branch_label"), F.coalesce("branch_probability", F.lit(0.0)).alias("branch_probability"))
        return steps.keep(out), steps.keep(persistences)


def summary(labels: DataFrame) -> DataFrame:
    """One row of detect's labels: n_samples, and the number of groups and the share of noise among clusters, subgroups and branches."""
    kinds = {"base_clusters": "base_cluster_label", "subgroups": "subgroup_label", "branch_labels": "branch_label"}
    shares = {"base_noise_ratio": "base_cluster_label", "subgroup_noise_ratio": "subgroup_label", "branch_noise_ratio": "branch_label"}
    n = F.greatest(F.count("*"), F.lit(1))
    return labels.agg(F.count("*").alias("n_samples"), *(F.count_distinct(F.when(F.col(c) != -1, F.col(c))).alias(f"n_{k}") for k, c in kinds.items()), *((F.count_if(F.col(c) == -1) / n).alias(k) for k, c in shares.items()))


def flattened(nested: DataFrame, index: str = "base_cluster_index", value: str = "branch_persistence") -> DataFrame:
    """index, branch_index, value: one row for each number in nested arrays (index, value), however deep.

    Deeper places are dotted ("1.0"); a plain number has place 0; null, and an array without numbers, is a row of nulls.
    """
    out, depth = nested.select(F.col(index), F.lit("").alias("branch_index"), F.col(value)), 0
    while isinstance(out.schema[value].dataType, ArrayType):
        out = out.select(index, "branch_index", F.posexplode_outer(value).alias("_at", value))
        out = out.select(index, F.when(F.col("branch_index") == "", F.col("_at").cast("string")).otherwise(F.concat_ws(".", "branch_index", "_at")).alias("branch_index"), value)
        depth += 1
    place = F.col("branch_index") if depth else F.lit("0")
    return out.select(index, F.when(F.col(value).isNotNull(), place).alias("branch_index"), value)
