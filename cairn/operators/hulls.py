"""Convex hulls of point sets, with volumes and areas, and the samples that are taken of large sets first.

A point on a hull is on the hull of any part that holds it. So parts of a set, dealt by hash, first keep only their own hulls'
corners; then one task has what is left of an item. Bounds: PART points in a part, and of all parts' corners
an item may keep MOST, else its hull is given up as failed.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART, MOST = 20_000, 200_000


class Flat(ValueError):
    """The points lie in a plane, on a line or in one place."""


def _start(p: np.ndarray, tiny: float) -> list[int]:
    """Four corners of a solid tetrahedron."""
    a, b = int(p[:, 0].argmin()), int(p[:, 0].argmax())
    if p[b, 0] - p[a, 0] <= tiny:
        a, b = 0, int(np.linalg.norm(p - p[0], axis=1).argmax())
    line = p[b] - p[a]
    if np.linalg.norm(line) <= tiny:
        raise Flat("one place")
    off = np.linalg.norm(np.cross(p - p[a], line / np.linalg.norm(line)), axis=1)
    c = int(off.argmax())
    if off[c] <= tiny:
        raise Flat("a line")
    n = np.cross(line, p[c] - p[a])
    height = np.abs((p - p[a]) @ (n / np.linalg.norm(n)))
    d = int(height.argmax())
    if height[d] <= tiny:
        raise Flat("a plane")
    return [a, b, c, d]


def quickhull(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners and outward triangles (rows of three places in corners) of the hull of finite points; flat sets raise Flat.

    Each round takes the point farthest outside some face, removes the faces that it sees, and joins their rim with it.
    """
    p = np.unique(points, axis=0)
    if len(p) < 4:
        raise Flat("fewer than four places")
    tiny = 1e-9 * max(float(np.ptp(p, axis=0).max()), 1e-300)
    inside = p[first := _start(p, tiny)].mean(0)

    def face(a: int, b: int, c: int):
        n = np.cross(p[b] - p[a], p[c] - p[a])
        n = n / max(np.linalg.norm(n), 1e-300)
        if n @ (inside - p[a]) > 0:
            a, b, n = b, a, -n
        return (a, b, c), n, float(n @ p[a])

    faces = {}
    todo = np.setdiff1d(np.arange(len(p)), first)

    def add(f, candidates: np.ndarray) -> np.ndarray:
        """Gives the face the candidates outside it; the rest stays without one."""
        (abc, n, at) = f
        out = p[candidates] @ n - at > tiny
        faces[abc] = n, at, candidates[out]
        return candidates[~out]

    a, b, c, d = first
    for abc in ((a, b, c), (a, b, d), (a, c, d), (b, c, d)):
        todo = add(face(*abc), todo)
    while True:
        abc = next((k for k, (_, _, out) in faces.items() if len(out)), None)
        if abc is None:
            break
        n, at, out = faces[abc]
        top = int(out[(p[out] @ n).argmax()])
        seen = [k for k, (m, h, _) in faces.items() if p[top] @ m - h > tiny]
        rim = {}
        for i, j, k in seen:
            for edge in ((i, j), (j, k), (k, i)):
                if edge[::-1] in rim:
                    del rim[edge[::-1]]
                else:
                    rim[edge] = True
        loose = np.unique(np.concatenate([faces.pop(k)[2] for k in seen]))
        loose = loose[loose != top]
        for i, j in rim:
            loose = add(face(i, j, top), loose)
    tri = np.array(list(faces))
    corners, places = np.unique(tri, return_inverse=True)
    return p[corners], places.reshape(-1, 3)


def measures(corners: np.ndarray, triangles: np.ndarray) -> tuple[float, float]:
    """Volume and surface area of a closed surface."""
    a, b, c = (corners[triangles[:, i]] for i in range(3))
    n = np.cross(b - a, c - a)
    centre = corners.mean(0)
    return float(np.abs(np.einsum("ij,ij->i", a - centre, np.cross(b - centre, c - centre))).sum() / 6), float(np.linalg.norm(n, axis=1).sum() / 2)


def _finite() -> Column:
    bad = [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in "xyz"]
    return ~(bad[0] | bad[1] | bad[2])


def convex_hulls(points: DataFrame, key: str, part: int = PART, most: int = MOST) -> DataFrame:
    """key, convex_hull_volume, convex_hull_area, n_corners, hull_failed (1 or 0) of each item of points (key, x, y, z).

    Failed, with null measures: fewer than four different points, points in a plane, coordinates that aren't finite, or
    more than most corners left after the parts.
    """
    good = points.select(F.col(key).alias("_key"), "x", "y", "z", _finite().alias("_ok"))
    sizes = good.groupBy("_key").agg(F.count("*").alias("_n"), F.bool_and("_ok").alias("_all"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / part))
    dealt = good.join(sizes.filter("_all"), "_key").withColumn("_part", F.pmod(F.xxhash64("x", "y", "z"), parts))

    def corners(g: pd.DataFrame) -> pd.DataFrame:
        p = g[["x", "y", "z"]].to_numpy(float)
        try:
            p = quickhull(p)[0]
        except Flat:
            p = np.unique(p, axis=0)  # flat parts keep all their places
        return pd.DataFrame({"_key": g["_key"].iloc[0], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    types = {c: t for c, t in good.dtypes}
    kept = dealt.filter(F.col("_n") > part).groupBy("_key", "_part").applyInPandas(corners, f"_key {types['_key']}, x double, y double, z double")
    left = kept.unionByName(dealt.filter(F.col("_n") <= part).select("_key", *(F.col(c).cast("double").alias(c) for c in "xyz")))
    left = left.join(left.groupBy("_key").agg(F.count("*").alias("_m")).filter(F.col("_m") <= most), "_key")

    def hull(g: pd.DataFrame) -> pd.DataFrame:
        try:
            c, t = quickhull(g[["x", "y", "z"]].to_numpy(float))
            v, a = measures(c, t)
            row = (v, a, len(c))
        except Flat:
            row = (None, None, None)
        return pd.DataFrame([(g["_key"].iloc[0], *row)], columns=["_key", "v", "a", "c"])

    found = left.groupBy("_key").applyInPandas(hull, f"_key {types['_key']}, v double, a double, c long")
    out = sizes.join(found, "_key", "left")
    return out.select(F.col("_key").alias(key), F.col("v").alias("convex_hull_volume"), F.col("a").alias("convex_hull_area"), F.col("c").alias("n_corners"), F.col("v").isNull().cast("int").alias("hull_failed"))


def hash_sample(points: DataFrame, key: str, most: int, seed: int = 0, by: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """most of each item's points, those of least hash of by; ties by place. Smaller items stay whole; reruns agree."""
    w = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), *by), "x", "y", "z")
    return points.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def voxel_sample(points: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """key, x, y, z: of items over most points, the mean of each cube's points; of those, if they are still more, a hash sample.

    A cube's side is the longest side of the item's box by the cube root of most (8 at least). Smaller items stay whole.
    """
    box = points.groupBy(key).agg(F.count("*").alias("_n"), *(F.min(c).alias(f"_{c}0") for c in "xyz"), F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("_long"))
    side = F.greatest(F.col("_long") / max(most, 8) ** (1 / 3), F.lit(1e-9))
    p = points.select(key, "x", "y", "z").join(box, key).withColumn("_side", side)
    large = p.filter(F.col("_n") > most).groupBy(key, *(F.floor((F.col(c) - F.col(f"_{c}0")) / F.col("_side")).alias(f"_v{c}") for c in "xyz")).agg(*(F.avg(c).alias(c) for c in "xyz"))
    small = p.filter(F.col("_n") <= most).select(key, *(F.col(c).cast("double").alias(c) for c in "xyz"))
    # Means depend on the order of their sum in the last bits; cubes do not.
    return hash_sample(large, key, most, seed, ("_vx", "_vy", "_vz")).select(key, "x", "y", "z").unionByName(small)


def hull_sample(points: DataFrame, key: str, most: int = 2000, sampling: str = "voxel", seed: int = 0) -> DataFrame:
    """points for a hull, at most `most` of each item: by hash (random) or by cubes (voxel)."""
    if sampling not in ("random", "voxel"):
        raise ValueError(f"sampling is random or voxel, not {sampling}")
    return (voxel_sample if sampling == "voxel" else hash_sample)(points.select(key, "x", "y", "z"), key, most, seed)
