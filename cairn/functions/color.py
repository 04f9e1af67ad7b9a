"""Colour spaces and histogram descriptors over r, g, b columns in [0, 1]."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue, saturation and value in [0, 1]; of tied channels, blue's branch wins over green's over red's."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, 0.0).when(top == b, 4 + (r - g) / d).when(top == g, 2 + (b - r) / d).otherwise(F.pmod((g - b) / d, F.lit(6.0)))
    return [F.pmod(h / 6, F.lit(1.0)), F.when(top == 0, 0.0).otherwise(d / top), top]


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """CIE Lab (sRGB, D65), scaled to [0, 1]: L / 100, (a + 128) / 255, (b + 128) / 255."""
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    r, g, b = linear(r), linear(g), linear(b)
    # The sRGB matrix and the D65 white point.
    x = f((0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047)
    y = f(0.2126729 * r + 0.7151522 * g + 0.0721750 * b)
    z = f((0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883)
    out = [(116 * y - 16) / 100, (500 * (x - y) + 128) / 255, (200 * (y - z) + 128) / 255]
    return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) for c in out]


SPACES = {"rgb": lambda r, g, b: [r, g, b], "hsv": hsv, "lab": lab}


def histogram(pixels: DataFrame, key: str, space: str = "lab", bins: int = 16, white: float = 0.985) -> DataFrame:
    """key, channel, bin, value: 3 x bins shares of each channel, together of unit length.

    Pixels of mean rgb from white on are background, unless all of an image's are. The last bin holds 1.0.
    Places are rounded to 9 decimals first, so that a value on an edge falls right of it whatever its last bits are.
    """
    fore = (F.col("r") + F.col("g") + F.col("b")) / 3 < white
    p = pixels.withColumn("_any", F.max(fore).over(Window.partitionBy(key))).filter(fore | ~F.col("_any"))
    c = SPACES[space](F.col("r"), F.col("g"), F.col("b"))
    long = p.select(key, F.posexplode(F.array(*c)).alias("channel", "x"))
    counts = long.groupBy(key, "channel", F.least(F.floor(F.round(F.col("x") * bins, 9)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = counts.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(3 * bins - 1))).alias("i")).select(key, F.floor(F.col("i") / bins).cast("int").alias("channel"), (F.col("i") % bins).alias("bin"))
    full = grid.join(counts, [key, "channel", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key, "channel"))
    full = full.withColumn("share", share)
    return full.select(key, "channel", "bin", (F.col("share") / F.sqrt(F.sum(F.col("share") * F.col("share")).over(Window.partitionBy(key)))).alias("value"))
