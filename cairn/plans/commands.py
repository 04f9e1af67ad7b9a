"""Reports from files to files: each reads its inputs, runs its operators, writes its tables, and returns its main table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import cluster_metrics, fusion_grid, hdbscan, knn, metadata, routing
from cairn.sources.files import read_labels, read_rates, write_object, write_table


def _first(df: DataFrame) -> dict:
    """The one row of a report as a dict; {} of none."""
    row = df.first()
    return {} if row is None else row.asDict(recursive=True)


def evaluate_clusters(spark: SparkSession, clusters: str, labels: str, out: str) -> DataFrame:
    """Agreement of clusters (CSV of specimen_id, cluster_id) with labels, over the items that have both; noise is a cluster.

    Writes metrics.json, class_confusion (label, cluster_id, n: the pairs that occur), cluster_purity and category_noise_rate.
    """
    given = read_rates(spark, clusters, ("specimen_id", "cluster_id"))
    c = given.select(F.col("specimen_id").cast("string").alias("id"), F.col("cluster_id").cast("int").alias("cluster_id"))
    known = read_labels(spark, labels)
    table = cluster_metrics.contingency(c, known)
    whole = cluster_metrics.agreement(table).join(cluster_metrics.adjusted_mutual_information(table)).join(cluster_metrics.purity(table))
    names = {"ari": "ARI", "v_measure": "NMI", "ami": "AMI", "purity": "Purity", "homogeneity": "Homogeneity", "completeness": "Completeness"}
    metrics = whole.select(*(F.col(k).alias(v) for k, v in names.items()), F.col("v_measure").alias("V-measure"))
    found = _first(metrics)
    write_object(spark, found, f"{out}/metrics.json")
    write_table(table, f"{out}/class_confusion")
    write_table(cluster_metrics.cluster_purity(table), f"{out}/cluster_purity")
    rates = cluster_metrics.noise_rate(c, known).withColumn("n_noise", F.round(F.col("n") * F.col("noise_rate")).cast("long"))
    write_table(rates.select("label", "n", "n_noise", "noise_rate"), f"{out}/category_noise_rate")
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"`{k}` double" for k in found))


def fusion_ablation(items: DataFrame, sizes: DataFrame, labels: DataFrame, settings: list[tuple[str, str, float]], out: str, k: int = 10, rerank: int = 50, metric: str = "cosine", prefilter: str = "off", strategy: str = "adjacent", norm: str = "robust", threshold: float = 1.5, penalty: float = 0.05) -> DataFrame:
    """Neighbour lists under all settings and of shape alone, against labels; the settings by place.

    items: row_idx, id, embedding and, unless prefilter is off, pregroup_id. sizes: row_idx and the features; settings whose
    feature it lacks fail, the others run. Writes fusion_ablation_overall, fusion_ablation_per_category,
    delta_vs_shape_only and best_fusion_config.json. Candidates are searched for once.
    """
    has = [s for s in settings if fusion_grid.ALIASES.get(s[0], s[0]) in sizes.columns]
    failures = [{"size_feature": f, "size_penalty_mode": m, "lambda_size": w, "error": f"sizes lack {f}"} for f, m, w in settings if (f, m, w) not in has]
    if not has:
        raise ValueError(f"no setting can be run: {failures}")
    if prefilter == "off":
        pairs = knn.knn(items.select("row_idx", "embedding"), max(k, rerank), metric).select("query_idx", F.col("neighbor_idx").alias("candidate_idx"), "distance")
    else:
        pairs = routing.nearest(items, max(k, rerank), prefilter, strategy, pool_k=rerank, metric=metric).drop("rank")
    ranked = fusion_grid.grid_ranked(pairs, sizes, has, k, max(k, rerank), norm, threshold, penalty)
    names = items.select("row_idx", "id")
    ranked = ranked.join(names.toDF("query_idx", "query_id"), "query_idx").join(names.toDF("candidate_idx", "neighbor_id"), "candidate_idx")
    path = f"{out}/fusion_eval_per_query"
    write_table(fusion_grid.grid_rates(ranked, labels), path, "parquet")
    rates = items.sparkSession.read.parquet(path)
    overall, best = fusion_grid.grid_overall(rates), fusion_grid.grid_best(rates)
    write_table(overall.orderBy(F.desc("mean_match_rate")), f"{out}/fusion_ablation_overall")
    write_table(fusion_grid.grid_by_label(rates), f"{out}/fusion_ablation_per_category")
    write_table(best.select(*fusion_grid.SETTING, "delta_mean_match_rate", "n_category_worse", "place"), f"{out}/delta_vs_shape_only")
    base = _first(overall.filter("size_feature = 'baseline'"))
    report = {"baseline_shape_only_mean_match_rate": base.get("mean_match_rate"), "best_config": _first(best.filter("place = 1")), "n_successful_shape_size_runs": len(has), "n_failed_runs": len(failures), "failures": failures}
    write_object(items.sparkSession, report, f"{out}/best_fusion_config.json")
    return best


def export_trees(items: DataFrame, out: str, config: hdbscan.Config = hdbscan.Config(), clusters: DataFrame | None = None) -> DataFrame:
    """The single linkage and condensed tree of items, and where its leaves and links stand; clusters colour the leaves.

    Writes single_linkage_tree, condensed_tree, leaves and links as Parquet; returns the leaves.
    """
    merges, tree = hdbscan.tree_tables(items, config)
    leaves, links = hdbscan.tree_drawing(items, config, clusters)
    for name, df in {"single_linkage_tree": merges, "condensed_tree": tree, "leaves": leaves, "links": links}.items():
        write_table(df, f"{out}/{name}", "parquet")
    return leaves


def metadata_report(records: DataFrame, out: str, errors: DataFrame | None = None, color: str = "auto", slow: float = 60.0) -> DataFrame:
    """The records' summary. Writes metadata_summary.json (with counts by size_metric and whether colour is used), pregroup_counts
    and features (specimen_id, features) as Parquet."""
    spark = records.sparkSession
    row = metadata.run_summary(records, errors, slow)
    use = bool(_first(metadata.use_color(records.withColumn("has_color", F.col("has_color").cast("int") == 1), color))["use_color"])
    features, names = metadata.feature_matrix(records, use)
    # A handful of metrics, whatever the number of records.
    metrics = {r.size_metric: r.n for r in records.groupBy(F.col("size_metric").cast("string").alias("size_metric")).agg(F.count("*").alias("n")).collect()}
    write_object(spark, _first(row) | {"use_color_mode": color, "use_color_resolved": use, "used_feature_columns": names, "size_metric_counts": metrics}, f"{out}/metadata_summary.json")
    counts = records.groupBy("pregroup_id").agg(F.count("*").alias("count"))
    write_table(counts.orderBy(F.desc("count"), "pregroup_id"), f"{out}/pregroup_counts")
    write_table(features.select("specimen_id", "features"), f"{out}/features", "parquet")
    return row
