"""Camera distances for views of point sets: how much of the image each view fills, and a search for the distance that fits.

Directions are few and given; points are many. Every step of a search is one pass over the points of the items that are still
searched, summed up by item and view.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.steps import Steps

#: Views that one call may have.
VIEWS = 4096


def light_direction(x: Column, y: Column, z: Column) -> Column:
    """From the eye to the centre, of length 1; null for an eye in the centre."""
    n = F.sqrt(x * x + y * y + z * z)
    return F.when(n > 0, F.array(-x / n, -y / n, -z / n))


def safe_radius(points: DataFrame, key: str, floor: float = 0.25, margin: float = 0.05) -> DataFrame:
    """key, radius: the farthest point's distance and a margin, floor at least; floor if that is not a positive number."""
    far = F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    good = far.isNotNull() & ~F.isnan(far) & (far < float("inf")) & (far > 0)
    return points.groupBy(key).agg(F.when(good, F.greatest(F.lit(floor), far * (1 + margin))).otherwise(floor).alias("radius"))


def _axes(directions: DataFrame, up: tuple[float, float, float]) -> list[tuple[int, tuple, tuple, tuple]]:
    """Of each view: its number, direction, and the image's axes to the right and up, of length 1."""
    rows = directions.select(directions.columns[0], "x", "y", "z").limit(VIEWS + 1).collect()
    if len(rows) > VIEWS:
        raise ValueError(f"more than {VIEWS} views")
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    unit = lambda a: tuple(c / math.sqrt(sum(v * v for v in a)) for c in a)
    out = []
    for i, *d in sorted(map(tuple, rows)):
        d = unit(d)
        right = cross(up, d)
        if math.sqrt(sum(v * v for v in right)) < 1e-9:  # seen along up
            right = cross((1.0, 0.0, 0.0), d) if abs(d[0]) < 0.9 else cross((0.0, 1.0, 0.0), d)
        right = unit(right)
        out.append((i, d, right, cross(d, right)))
    return out


def fills(points: DataFrame, key: str, radius: DataFrame, directions: DataFrame, fov: float = 60.0, width: int = 224, height: int = 224, up: tuple[float, float, float] = (0.0, 1.0, 0.0)) -> DataFrame:
    """key, view, fill_ratio, touches_border: the box of an item's points in the image of each view, by its area.

    points: key, x, y, z about the centre. radius: key, radius of the eye. directions: a number, x, y, z. fov is the vertical
    angle. The box is in whole pixels and cut off at the border; a view with a point beside or behind the eye is full and
    touches it.
    """
    views = F.array(*(F.struct(F.lit(i).alias("view"), *(F.lit(float(v)).alias(f"{n}{a}") for n, axis in zip("dru", axes, strict=True) for a, v in zip("xyz", axis, strict=True))) for i, *axes in _axes(directions, up)))
    p = points.select(key, "x", "y", "z").join(radius.select(key, "radius"), key).withColumn("v", F.explode(views))
    along = lambda n: F.col("x") * F.col(f"v.{n}x") + F.col("y") * F.col(f"v.{n}y") + F.col("z") * F.col(f"v.{n}z")
    half = math.tan(math.radians(fov) / 2)
    depth = F.col("radius") - along("d")
    ahead = depth > 1e-9
    # The image's half height is 1; its half width is width / height.
    px = F.floor((along("r") / (depth * half) * (height / width) + 1) / 2 * width)
    py = F.floor((1 - along("u") / (depth * half)) / 2 * height)
    seen = p.select(key, F.col("v.view").alias("view"), (~ahead).alias("near"), F.when(ahead, px).alias("px"), F.when(ahead, py).alias("py"))
    box = seen.groupBy(key, "view").agg(F.bool_or("near").alias("near"), *(f(c).alias(f"{c}{n}") for c in ("px", "py") for n, f in (("0", F.min), ("1", F.max))))
    side = lambda c, most: F.greatest(F.lit(0), F.least(F.col(f"{c}1"), F.lit(most - 1)) - F.greatest(F.col(f"{c}0"), F.lit(0)) + 1)
    touches = (F.col("px0") <= 0) | (F.col("py0") <= 0) | (F.col("px1") >= width - 1) | (F.col("py1") >= height - 1)
    return box.select(key, "view", F.when(F.col("near"), 1.0).otherwise(side("px", width) * side("py", height) / (width * height)).alias("fill_ratio"), (F.col("near") | touches).alias("touches_border"))


def _span(points, key, state, directions, how) -> DataFrame:
    """key, fill_min, fill_max, touching (views) at each item's radius."""
    f = fills(points, key, state, directions, **how)
    return f.groupBy(key).agg(F.min("fill_ratio").alias("fill_min"), F.max("fill_ratio").alias("fill_max"), F.count_if("touches_border").alias("touching"))


def autotune(points: DataFrame, key: str, directions: DataFrame, target: tuple[float, float] = (0.4, 0.6), initial: float = 2.0, bounds: tuple[float, float] = (0.25, 8.0), rounds: int = 12, **how) -> DataFrame:
    """key, radius, fill_min, fill_max, iterations: where all views' fill is within target, found by halving bounds.

    Too full a view moves the eye away, else too empty a one moves it closer. An item that rounds don't bring there has the radius
    that missed by least, the first of equals. All items are searched together; those found take no further part.
    """
    low, high = target
    miss = F.greatest(F.lit(0.0), F.col("fill_max") - high) + F.greatest(F.lit(0.0), low - F.col("fill_min"))
    found = (F.col("fill_min") >= low) & (F.col("fill_max") <= high)
    with Steps(points.sparkSession) as steps:
        start = points.select(key).distinct().withColumns({"radius": F.lit(min(max(initial, bounds[0]), bounds[1])), "lo": F.lit(float(bounds[0])), "hi": F.lit(float(bounds[1]))})
        now = steps.cut(start.join(_span(points, key, start, directions, how), key).withColumns({"miss": miss, "iterations": F.lit(0)}).withColumn("best", F.struct("radius", "fill_min", "fill_max", "miss")))
        done = [now.filter(found)]
        for i in range(1, rounds + 1):
            now = now.filter(~found)
            if not now.take(1):
                break
            full = F.col("fill_max") > high
            moved = now.select(key, "best", F.when(full, F.col("radius")).otherwise(F.col("lo")).alias("lo"), F.when(full, F.col("hi")).otherwise(F.col("radius")).alias("hi")).withColumn("radius", (F.col("lo") + F.col("hi")) / 2)
            now = moved.join(_span(points, key, moved, directions, how), key).withColumns({"miss": miss, "iterations": F.lit(i)})
            better = F.struct("radius", "fill_min", "fill_max", "miss")
            now = steps.cut(now.withColumn("best", F.when(F.col("miss") < F.col("best.miss"), better).otherwise(F.col("best"))))
            done.append(now.filter(found))
        out = now.filter(~found).select(key, "best.radius", "best.fill_min", "best.fill_max", F.lit(rounds).alias("iterations"))
        for d in done:
            out = out.unionByName(d.select(key, "radius", "fill_min", "fill_max", "iterations"))
        return steps.keep(out)


def kept_inside(points: DataFrame, key: str, radius: DataFrame, directions: DataFrame, margin: float = 0.05, most_steps: int = 10, most: float = 8.0, **how) -> DataFrame:
    """key, radius, touching, steps, fill_min, fill_max: radii (key, radius) grown by margin until no view touches the border, or
    after most_steps, or at most."""
    with Steps(points.sparkSession) as steps:
        start = radius.select(key, F.least("radius", F.lit(float(most))).alias("radius"))
        now = steps.cut(start.join(_span(points, key, start, directions, how), key).withColumn("steps", F.lit(0)))
        done = []
        for _ in range(most_steps):
            goes = (F.col("touching") > 0) & (F.col("radius") < most)
            done.append(now.filter(~goes))
            now = now.filter(goes)
            if not now.take(1):
                break
            grown = now.select(key, F.least(F.col("radius") * (1 + margin), F.lit(float(most))).alias("radius"), F.col("steps") + 1)
            grown = grown.toDF(key, "radius", "steps")
            now = steps.cut(grown.join(_span(points, key, grown, directions, how), key))
        columns = (key, "radius", "touching", "steps", "fill_min", "fill_max")
        out = now.select(*columns)
        for d in done:
            out = out.unionByName(d.select(*columns))
        return steps.keep(out)


def equal_radii(zoom: DataFrame, key: str = "specimen", scales: tuple[str, str] = ("loose", "up")) -> DataFrame:
    """key, equal: whether both scales' final_radius are the same up to rounding, for items that have both. zoom: key, scale,
    final_radius; of repeated rows the largest counts."""
    radius = lambda s: F.max(F.when(F.col("scale") == s, F.col("final_radius")))
    both = zoom.groupBy(key).agg(radius(scales[0]).alias("a"), radius(scales[1]).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return both.select(key, (F.abs(F.col("a") - F.col("b")) <= 1e-8 + 1e-5 * F.abs("b")).alias("equal"))
