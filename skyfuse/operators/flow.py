"""Motion between consecutive images by windowed least squares.

Within a window, the change between two images is regressed on the first
image's differences along rows and columns. The sums over a square window are
sums over columns of sums over rows: two window passes instead of a 2-D join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfuse.functions.scalar import flow_angle


def pairs(images: DataFrame, keys: list[str], time: str = "t") -> DataFrame:
    """(keys, pair, lat_i, lon_i, a, b): each image and the one a step later; a pair
    with an absent image is absent."""
    a = images.select(*keys, F.col(time).alias("pair"), "lat_i", "lon_i", F.col("aod").alias("a"))
    b = images.select(*keys, (F.col(time) - 1).alias("pair"), "lat_i", "lon_i", F.col("aod").alias("b"))
    return a.join(b, [*keys, "pair", "lat_i", "lon_i"])


SUMS = {"y": "y", "x": "x", "z": "z", "xx": "x * x", "zz": "z * z", "xz": "x * z", "xy": "x * y", "zy": "z * y"}
LEAST = 10
PIVOT = 1e-12


def flat_window(n: Column, x: Column, z: Column, xx: Column, xz: Column, zz: Column) -> Column:
    """Whether the normal equations of a window (its number of cells, sums and products of its
    gradients) have a pivot below PIVOT when rows are exchanged for the largest one.

    The first pivot is the largest of n, x and z. Which row it takes decides which two entries
    the second is the larger of; the product of all three is the determinant."""
    one = F.greatest(F.abs(n), F.abs(x), F.abs(z))
    centred = F.greatest(F.abs(xx - x * x / n), F.abs(xz - x * z / n))
    by_x = F.greatest(F.abs(x - F.try_divide(n * xx, x)), F.abs(xz - F.try_divide(z * xx, x)))
    by_z = F.greatest(F.abs(xx - F.try_divide(x * xz, z)), F.abs(x - F.try_divide(n * xz, z)))
    two = F.when(F.abs(n) >= one, centred).when(F.abs(x) >= one, by_x).otherwise(by_z)
    whole = F.abs(((xx - x * x / n) * (zz - z * z / n) - (xz - x * z / n) * (xz - x * z / n)) * n)
    return (one < PIVOT) | (two < PIVOT) | (whole < PIVOT * one * two)


def optical_flow(pairs: DataFrame, keys: list[str], nr: int, window: int = 15, row: str = "lon_i", col: str = "lat_i") -> DataFrame:
    """(keys, lat_i, lon_i, speed, angle in degrees) for every cell; cells at the
    border have neither, windows with a missing value no speed and angle 0, and
    windows without gradients a zero vector."""
    half = window // 2
    p = pairs.select(*keys, F.col(row).alias("r"), F.col(col).alias("c"), "a", "b")
    down, along = Window.partitionBy(*keys, "c").orderBy("r"), Window.partitionBy(*keys, "r").orderBy("c")
    f = p.select(*keys, "r", "c", (F.col("b") - F.col("a")).alias("y"), (F.lead("a").over(down) - F.col("a")).alias("x"), (F.lead("a").over(along) - F.col("a")).alias("z"))
    f = f.where((F.col("r") <= nr - 3) & (F.col("c") <= nr - 3))
    f = f.withColumn("good", F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull(), 1).otherwise(0)).withColumn("n", F.lit(1))
    for name, expr in SUMS.items():
        f = f.withColumn(f"s_{name}", F.expr(expr))
    names = ["n", "good", *[f"s_{k}" for k in SUMS]]
    for w in (down, along):
        frame = w.rowsBetween(-half, half - 2)
        f = f.select(*keys, "r", "c", *[F.sum(k).over(frame).alias(k) for k in names])
    n = F.col("n")

    def centred(xy: str, x: str, y: str):
        return F.col(f"s_{xy}") - F.col(f"s_{x}") * F.col(f"s_{y}") / n

    sxx, szz, sxz, sxy, szy = centred("xx", "x", "x"), centred("zz", "z", "z"), centred("xz", "x", "z"), centred("xy", "x", "y"), centred("zy", "z", "y")
    flat = flat_window(n, *[F.col(f"s_{k}") for k in ("x", "z", "xx", "xz", "zz")])
    s = f.where((F.col("r") >= 1) & (F.col("c") >= 1)).select(*keys, "r", "c", "n", "good", flat.alias("flat"), sxx.alias("sxx"), szz.alias("szz"), sxz.alias("sxz"), sxy.alias("sxy"), szy.alias("szy"))
    d, flat = F.col("sxx") * F.col("szz") - F.col("sxz") * F.col("sxz"), F.col("flat")
    slope = lambda e: F.when(flat, 0.0).otherwise(F.try_divide(F.expr(e), d))
    known = (F.col("n") >= LEAST) & (F.col("good") == F.col("n"))
    v = s.select(*keys, "r", "c", "n", "good", F.when(known, -slope("sxy * szz - szy * sxz")).alias("vr"), F.when(known, -slope("szy * sxx - sxy * sxz")).alias("vc"))
    out = v.select(*keys, "r", "c", F.sqrt(F.col("vr") * F.col("vr") + F.col("vc") * F.col("vc")).alias("speed"), F.when(F.col("n") >= LEAST, flow_angle(F.col("vr"), F.col("vc"))).alias("angle"))
    every = p.select(*keys, "r", "c").join(out, [*keys, "r", "c"], "left")
    return every.select(*keys, F.col("r").alias(row), F.col("c").alias(col), "speed", "angle").select(*keys, "lat_i", "lon_i", "speed", "angle")


def average(flow: DataFrame, first: int, last: int, keys: list[str] | None = None, coupled: bool = True) -> DataFrame:
    """Mean speed and angle (radians) over pairs first..last. Coupled: a cell that
    lacks either in any pair has neither; else each mean is by itself."""
    keys = keys or []
    rad = F.col("angle") * F.lit(3.141592653589793) / F.lit(180.0)
    rows = flow.where(F.col("pair").between(first, last)).groupBy(*keys, "lat_i", "lon_i")
    got = rows.agg(F.count("*").alias("n"), F.count("speed").alias("ns"), F.count("angle").alias("na"), F.avg("speed").alias("speed"), F.avg(rad).alias("angle"))
    good = (F.col("n") == F.col("ns")) & (F.col("n") == F.col("na"))
    alone = {"speed": F.col("n") == F.col("ns"), "angle": F.col("n") == F.col("na")}
    return got.select(*keys, "lat_i", "lon_i", *[F.when(good if coupled else alone[c], F.col(c)).alias(c) for c in ("speed", "angle")])
