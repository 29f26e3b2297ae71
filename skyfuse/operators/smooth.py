"""Kernel smoothing and finite differences on whole grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfuse.config import DEFAULT, Config

REACH = 6  # cells; beyond, the weight is under exp(-36) of the centre's


def kernel_smooth(grid: DataFrame, values: list[str], keys: list[str] | None = None, cfg: Config = DEFAULT, reach: int = REACH) -> DataFrame:
    """Weighted means with weights 0.5 exp(-distance**2 / range**2) over the cells
    that have a value; NULL where the weights' sum is within tol of 0. grid must
    hold every cell. The kernel is a product, so one pass per axis does."""
    keys = keys or []
    scale = max(reach, math.ceil(reach * cfg.smooth_range))
    weight = [math.exp(-(d * d) / (cfg.smooth_range**2)) for d in range(scale + 1)]
    cols = [(f"__s_{v}", F.coalesce(F.col(v), F.lit(0.0))) for v in values] + [(f"__w_{v}", F.when(F.col(v).isNotNull(), 1.0).otherwise(0.0)) for v in values]
    rest = [c for c in grid.columns if c not in values]
    out = grid.select(*rest, *[e.alias(n) for n, e in cols])
    for across, along in (("lon_i", "lat_i"), ("lat_i", "lon_i")):
        w = Window.partitionBy(*keys, across).orderBy(along)

        def summed(c: str, w=w) -> Column:
            total = F.col(c) * weight[0]
            for d in range(1, scale + 1):
                total = total + (F.lag(c, d, 0.0).over(w) + F.lead(c, d, 0.0).over(w)) * weight[d]
            return total

        out = out.select(*rest, *[summed(n).alias(n) for n, _ in cols])
    mean = lambda v: F.when(F.col(f"__w_{v}") * 0.5 > cfg.smooth_tol, F.try_divide(F.col(f"__s_{v}"), F.col(f"__w_{v}"))).alias(v)
    return out.select(*rest, *[mean(v) for v in values])


def velocity(mean_flow: DataFrame, keys: list[str] | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Smoothed speed in grid sides per step, smoothed angle, and the components."""
    s = kernel_smooth(mean_flow, ["speed", "angle"], keys, cfg).withColumn("speed", F.col("speed") / cfg.nr)
    return s.withColumn("v_x", F.col("speed") * F.cos("angle")).withColumn("v_y", F.col("speed") * F.sin("angle"))


def _step(x: str, keys: list[str], along: str) -> Column:
    other = "lat_i" if along == "lon_i" else "lon_i"
    return F.lead(x).over(Window.partitionBy(*keys, other).orderBy(along)) - F.col(x)


def smagorinsky(v: DataFrame, keys: list[str] | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Diffusivity K from forward differences of v_x and v_y; the last row and
    column have none."""
    keys, n = keys or [], float(cfg.nr)
    d = v.select(*keys, "lat_i", "lon_i", *[(_step(x, keys, along) * n).alias(f"{x}_{along}") for x in ("v_x", "v_y") for along in ("lat_i", "lon_i")])
    stretch, shear = F.col("v_x_lat_i") - F.col("v_y_lon_i"), F.col("v_x_lon_i") + F.col("v_y_lat_i")
    k = F.lit(cfg.smagorinsky * (1.0 / n) * (1.0 / n)) * F.sqrt(stretch * stretch + shear * shear)
    inner = (F.col("lat_i") < cfg.nr - 1) & (F.col("lon_i") < cfg.nr - 1)
    return d.select(*keys, "lat_i", "lon_i", F.when(inner, k).alias("K"))


def gradient(grid: DataFrame, value: str = "K", keys: list[str] | None = None, nr: int = DEFAULT.nr) -> DataFrame:
    """dK_dx along latitude and dK_dy along longitude, forward; the last cell
    repeats the difference before it."""
    keys = keys or []

    def diff(along: str) -> Column:
        other = "lat_i" if along == "lon_i" else "lon_i"
        w = Window.partitionBy(*keys, other).orderBy(along)
        forward, back = F.lead(value).over(w) - F.col(value), F.col(value) - F.lag(value).over(w)
        return F.when(F.col(along) < nr - 1, forward).otherwise(back) * float(nr)

    return grid.select(*keys, "lat_i", "lon_i", value, diff("lat_i").alias("dK_dx"), diff("lon_i").alias("dK_dy"))
