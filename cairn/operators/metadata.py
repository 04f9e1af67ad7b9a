"""Size, shape and colour records of point clouds, and the groups they make."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Flatness and thinness under this are degenerate.
DEGENERATE = 0.02
AXES = ("x", "y", "z")


def positive(c: Column) -> Column:
    """c if it is finite and over 0, else null."""
    return F.when((c > 0) & (c < float("inf")) & ~F.isnan(c), c)


def log10(c: Column) -> Column:
    return F.log10(F.greatest(c, F.lit(1e-12)))


def equivalent_diameter(volume: Column) -> Column:
    return F.cbrt(6 * positive(volume) / F.pi())


def boxes(points: DataFrame, key: str) -> DataFrame:
    """key, sides, longest side, volume, their logarithms and aspect ratios of the axis-aligned boxes of points (x, y, z)."""
    g = points.groupBy(key).agg(F.count("*").alias("n_points"), *((F.max(a) - F.min(a)).alias(f"size_{a}") for a in AXES))
    x, y, z = (F.col(f"size_{a}") for a in AXES)
    g = g.withColumns({"bbox_longest": F.greatest(x, y, z), "bbox_volume": x * y * z})
    ratio = lambda a, b: a / F.greatest(b, F.lit(1e-8))
    return g.withColumns({"log_bbox_longest": log10(F.col("bbox_longest")), "log_bbox_volume": log10(F.col("bbox_volume")), "aspect_xy": ratio(x, y), "aspect_xz": ratio(x, z), "aspect_yz": ratio(y, z)})


def axis_lengths(points: DataFrame, key: str) -> DataFrame:
    """key, pc1_length to pc3_length: twice the deviations along the principal axes; null under three points."""
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    cov = points.groupBy(key).agg(F.count("*").alias("n"), *(F.covar_samp(a, b).alias(a + b) for a, b in pairs))

    @F.pandas_udf("array<double>")
    def lengths(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        m = np.stack([np.stack(r, -1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], -2).astype(float)
        ok = np.isfinite(m).all((1, 2))
        out = np.full((len(m), 3), np.nan)
        out[ok] = 2 * np.sqrt(np.clip(np.linalg.eigvalsh(m[ok]), 0, None))[:, ::-1]
        return pd.Series(list(out))

    v = F.when(F.col("n") >= 3, lengths(*(a + b for a, b in pairs)))
    c = cov.withColumn("_v", v).select(key, *(F.nanvl(F.col("_v")[i], F.lit(None)).alias(f"pc{i + 1}_length") for i in range(3)))
    a, b, d = (F.col(f"pc{i}_length") for i in (1, 2, 3))
    ratio = lambda p, q: p / F.greatest(q, F.lit(1e-8))
    return c.withColumns({"elongation_12": ratio(a, b), "elongation_13": ratio(a, d), "elongation_23": ratio(b, d), "flatness_ratio": ratio(d, b), "thinness_ratio": ratio(d, a), "is_planar_degenerate": (ratio(d, b) < DEGENERATE).cast("int"), "is_linear_degenerate": (ratio(b, a) < DEGENERATE).cast("int")})


def robust_normalize(points: DataFrame, key: str, low: float = 0.01, high: float = 0.99, trim: bool = False) -> DataFrame:
    """points centred on the box of their low and high quantiles and scaled so that its longest side is 1."""
    q = points.groupBy(key).agg(*(F.percentile(a, F.array(F.lit(low), F.lit(high))).alias(f"_{a}") for a in AXES))
    j = points.join(q, key)
    side = F.greatest(*(F.col(f"_{a}")[1] - F.col(f"_{a}")[0] for a in AXES), F.lit(1e-8))
    if trim:
        for a in AXES:
            j = j.filter(F.col(a).between(F.col(f"_{a}")[0], F.col(f"_{a}")[1]))
    return j.select(*(c for c in points.columns if c not in AXES), *(((F.col(a) - (F.col(f"_{a}")[0] + F.col(f"_{a}")[1]) / 2) / side).alias(a) for a in AXES))


def colour_stats(pixels: DataFrame, key: str) -> DataFrame:
    """Mean and population deviation of r, g, b; values over 1 anywhere in a group mean a range of 255."""
    top = F.max(F.greatest("r", "g", "b"))
    g = pixels.groupBy(key).agg(top.alias("_t"), *(f(c).alias(f"{n}_{c}") for c in "rgb" for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    scale = F.when(F.col("_t") > 1, 255.0).otherwise(1.0)
    return g.select(key, *((F.col(f"{n}_{c}") / scale).alias(f"{n}_{c}") for c in "rgb" for n in ("mean", "std")))


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row, edges: the distinct linear quantiles at 0, 1/bins, ..., 1."""
    return df.agg(F.array_distinct(F.percentile(value, [i / bins for i in range(bins + 1)])).alias("edges"))


def quantile_bin(x: Column, edges: Column) -> Column:
    """The right-closed bin of x; the least value is in bin 0."""
    return F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e < x)) - 1)


def physical_groups(items: DataFrame, bins: int = 5, split: str | None = None) -> DataFrame:
    """items with volume_bin and pregroup_id: bins of log_bbox_volume, split at the median of the column split."""
    e = quantile_edges(items, "log_bbox_volume", max(2, bins))
    out = items.crossJoin(F.broadcast(e)).withColumn("volume_bin", quantile_bin(F.col("log_bbox_volume"), F.col("edges"))).drop("edges")
    token = F.concat(F.lit("vol_q"), F.col("volume_bin").cast("string"))
    if split:
        m = items.agg(F.percentile(split, 0.5).alias("_m"))
        out = out.crossJoin(F.broadcast(m))
        band = F.when(F.coalesce(F.nanvl(F.col(split), F.lit(None)), "_m") <= F.col("_m"), "low").otherwise("high")
        return out.withColumn("pregroup_id", F.concat(token, F.lit(f"__{split}_"), band)).drop("_m")
    return out.withColumn("pregroup_id", token)


def robust_scaled(items: DataFrame, columns: list[str], logs: tuple[str, ...] = ()) -> DataFrame:
    """items with the columns centred on their median by their quartile range (1, if that is 0).

    First what isn't finite becomes the column's median (0, if it has none), and columns in logs log(1 + x), with 0 for less.
    """
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in columns}
    medians = items.agg(*(F.percentile(finite[c], 0.5).alias(f"_{c}") for c in columns))
    filled = {c: F.coalesce(finite[c], F.col(f"_{c}"), F.lit(0.0)) for c in columns}
    filled = {c: F.log1p(F.greatest(x, F.lit(0.0))) if c in logs else x for c, x in filled.items()}
    out = items.crossJoin(F.broadcast(medians)).withColumns(filled).drop(*(f"_{c}" for c in columns))
    q = out.agg(*(F.percentile(c, [0.25, 0.5, 0.75]).alias(f"_{c}") for c in columns))
    scaled = {c: (F.col(c) - F.col(f"_{c}")[1]) / F.when(F.col(f"_{c}")[2] > F.col(f"_{c}")[0], F.col(f"_{c}")[2] - F.col(f"_{c}")[0]).otherwise(1.0) for c in columns}
    return out.crossJoin(F.broadcast(q)).withColumns(scaled).drop(*(f"_{c}" for c in columns))


def metadata_summary(items: DataFrame) -> DataFrame:
    """One row of counters and extremes over box records."""
    v = F.col("bbox_volume")
    return items.agg(F.count("*").alias("n"), F.count_if(v > 0).alias("n_positive_volume"), *(F.count_if(F.col("aspect_xy") < t).alias(f"n_aspect_under_{int(t * 100)}") for t in (0.02, 0.05, 0.10)), F.avg("bbox_longest").alias("mean_longest"), F.max("bbox_longest").alias("max_longest"), F.max_by("id", F.struct("bbox_longest", "id")).alias("longest_id"))


def fibonacci_sphere(spark, n: int, radius: float = 1.0) -> DataFrame:
    """i, x, y, z: n directions spread evenly over a sphere."""
    i = F.col("i")
    z = 1 - 2 * (i + 0.5) / n
    t = i * np.pi * (3 - 5**0.5)
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    return spark.range(n).withColumnRenamed("id", "i").select("i", (radius * r * F.cos(t)).alias("x"), (radius * r * F.sin(t)).alias("y"), (radius * z).alias("z"))


def mesh_measures(triangles: DataFrame, key: str) -> DataFrame:
    """key, surface_area, mesh_volume of triangles (ax .. cz): half cross products, signed tetrahedra."""
    a, b, c = ([F.col(p + k) for k in AXES] for p in "abc")
    u, v = ([q - p for p, q in zip(a, w, strict=True)] for w in (b, c))
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    n, m = cross(u, v), cross(b, c)
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    volume = (a[0] * m[0] + a[1] * m[1] + a[2] * m[2]) / 6
    return triangles.groupBy(key).agg(F.sum(area).alias("surface_area"), F.abs(F.sum(volume)).alias("mesh_volume"))


def size_volume(source: str = "auto") -> Column:
    """The volume that groups are made by. hull: of the hull as it is; mesh: of the mesh if positive, else of the hull; auto:
    the first positive one of box, hull and watertight mesh."""
    hull, mesh = F.col("convex_hull_volume"), F.col("mesh_volume")
    if source == "hull":
        return hull
    if source == "mesh":
        return F.coalesce(F.when(mesh > 0, mesh), hull)
    return F.coalesce(positive(F.col("bbox_volume")), positive(hull), F.when(F.col("is_watertight") >= 0.5, positive(mesh)))


def size_scalar(full: bool = True, mesh: bool = True, hull: bool = True) -> Column:
    """struct(metric, size, log_size). full: volume of a watertight mesh, else of the hull, unless flat or thin; else the area; else,
    and where none is positive, the longest side of the box."""
    solid = ~F.coalesce((F.col("is_planar_degenerate") == 1) | (F.col("is_linear_degenerate") == 1), F.lit(False))
    ways = [("mesh_volume", "mesh_volume", solid & (F.col("is_watertight") == 1), mesh), ("hull_volume", "convex_hull_volume", solid, hull), ("surface_area", "surface_area", F.lit(True), True)]
    used = [F.when(when, F.when(positive(F.col(c)).isNotNull(), F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("size")))) for name, c, when, on in ways if full and on]
    box = F.struct(F.lit("bbox_longest").alias("metric"), F.col("bbox_longest").cast("double").alias("size"))
    best = F.coalesce(*used, box)
    return F.struct(best["metric"].alias("metric"), best["size"].alias("size"), log10(best["size"]).alias("log_size"))


def use_color(items: DataFrame, mode: str = "auto", least: float = 0.2) -> DataFrame:
    """One row: n, n_color, use_color. items: has_color. off and force decide alone; auto needs a share of least, and rows."""
    n = items.agg(F.count("*").alias("n"), F.count_if(F.col("has_color")).alias("n_color"))
    share = F.coalesce(F.try_divide("n_color", "n") >= least, F.lit(False))
    return n.withColumn("use_color", F.lit(mode == "force") if mode in ("off", "force") else share)


# The columns of the feature matrix, in order; those of which log(1 + x) is taken; and the colour columns.
FEATURE_COLUMNS = ("bbox_longest", "surface_area", "convex_hull_volume", "convex_hull_area", "equiv_diameter_hull", "aspect_xy", "aspect_xz", "aspect_yz", "elongation_12", "elongation_13", "elongation_23")
LOG_COLUMNS = FEATURE_COLUMNS[:5]
COLOR_COLUMNS = ("mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b")


def feature_matrix(records: DataFrame, color: bool = False, logs: bool = True) -> tuple[DataFrame, list[str]]:
    """records with features (an array) and the names of its columns: shape, and colour if asked, scaled by median and quartiles.

    What isn't finite is its column's median, or 0 where none is; a missing colour is 0.
    """
    names = [*FEATURE_COLUMNS, *(COLOR_COLUMNS if color else ())]
    cast = {c: F.col(c).cast("double") for c in FEATURE_COLUMNS} | {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for c in names[11:]}
    held = F.struct(*(F.col(c) for c in records.columns)).alias("_row")
    scaled = robust_scaled(records.select(held, *(cast[c].alias(c) for c in names)), names, LOG_COLUMNS if logs else ())
    return scaled.select("_row.*", F.array(*names).alias("features")), names


def run_summary(records: DataFrame, errors: DataFrame | None = None, slow: float = 60.0) -> DataFrame:
    """One row over the records of a run and its error rows: counts, shares, means of times and points, and the slowest item.

    Groups named -1 are noise. Values that are missing or not a number take no part in a mean; the slowest of equal ones is the
    first by specimen_id. slow: seconds from which an item is slow; 0: none is.
    """
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    of = lambda c: F.count_if(F.col(c).cast("int") == 1)
    n, group = F.count("*"), F.col("pregroup_id").cast("string")
    noise, shown = F.count_if(group == "-1"), {0.02: "0_02", 0.05: "0_05", 0.10: "0_10"}
    seconds = known("total_sec")
    out = [n.alias("n_success"), of("has_color").alias("n_color"), F.try_divide(of("has_color"), n).alias("color_ratio"), F.count_distinct(F.when(group != "-1", group)).alias("n_pregroups_excluding_noise"), noise.alias("n_noise"), F.try_divide(noise, n).alias("noise_ratio")]
    out += [of(c).alias("n_" + c.removeprefix("is_")) for c in ("is_planar_degenerate", "is_linear_degenerate", "is_planar_like", "is_linear_like", "hull_failed", "volume_failed")]
    out += [F.count_if(known(f"{c}_ratio") < t).alias(f"n_{c}_lt_{s}") for c in ("flatness", "thinness") for t, s in shown.items()]
    out += [F.avg(known(c)).alias(f"mean_{c.removeprefix('n_')}") for c in ("n_points_used_for_hull", "mesh_load_sec", "aabb_sec", "hull_sec", "mesh_volume_sec", "total_sec")]
    slowest = F.min_by(F.when(seconds.isNotNull(), F.col("specimen_id").cast("string")), F.when(seconds.isNotNull(), F.struct(-seconds, F.col("specimen_id").cast("string"))))
    out += [F.max(seconds).alias("max_total_sec"), slowest.alias("slowest_specimen_id"), (F.count_if(seconds >= slow) if slow > 0 else F.lit(0).cast("long")).alias("n_slow_specimens"), F.lit(float(slow)).alias("slow_threshold_sec")]
    row = records.agg(*out)
    skipped = records.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_skipped")) if errors is None else errors.agg(n.alias("n_skipped"))
    return row.join(F.broadcast(skipped)).withColumn("n_input_files", F.col("n_success") + F.col("n_skipped"))
