"""Gridding: mean of the points in each cell's closed box, per image.

A point on an edge counts in two cells and one on a corner in four. Each point
finds its cells by itself, among the three nearest along either axis with the
exact bounds, so there is no join: one explosion (by 1 to 4) and one aggregation
with partial sums. A crowded image or cell therefore needs no salting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfuse.config import DEFAULT, Config
from skyfuse.functions.scalar import inside, missing
from skyfuse.operators.grid import bounds, complete


def clean_points(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Points with a value, strictly inside the domain; values below 0 count as 0."""
    lat, lon, aod = (missing(F.col(c).cast("double")) for c in ("lat", "lon", "aod"))
    kept = points.where(lat.isNotNull() & lon.isNotNull() & aod.isNotNull() & inside(lat, lon, cfg))
    return kept.withColumn("aod", F.greatest(F.col("aod"), F.lit(0.0)))


def _axis(x, low: float, cfg: Config):
    guess = F.floor((x - low) / cfg.resolution)
    near = F.array(*[(guess + d).cast("int") for d in (-1, 0, 1)])

    def holds(i):
        lo, hi = bounds(i, low, cfg)
        return (i >= 0) & (i < cfg.nr) & (x >= lo) & (x <= hi)

    return F.filter(near, holds)


def in_cells(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """points, a row for each cell that holds the point: lat_i, lon_i."""
    rows = points.withColumn("lat_i", F.explode(_axis(F.col("lat"), cfg.lat_min, cfg)))
    return rows.withColumn("lon_i", F.explode(_axis(F.col("lon"), cfg.lon_min, cfg)))


def regrid(points: DataFrame, keys: list[str] | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(keys, lat_i, lon_i, n, aod) of every cell that holds points."""
    keys = ["t"] if keys is None else keys
    return in_cells(points, cfg).groupBy(*keys, "lat_i", "lon_i").agg(F.count("*").alias("n"), F.avg("aod").alias("aod"))


def images(points: DataFrame, keys: list[str] | None = None, cfg: Config = DEFAULT, digits: int = 6) -> DataFrame:
    """Whole images (keys, lat_i, lon_i, aod), empty cells NULL, values rounded so
    that equal values compare equal whatever order they were summed in."""
    keys = ["t"] if keys is None else keys
    grid = regrid(points, keys, cfg).select(*keys, "lat_i", "lon_i", F.round("aod", digits).alias("aod"))
    return complete(grid, keys, cfg.nr)


def coverage(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Missing and present cells per image."""
    return grid.groupBy(*keys).agg(F.count("*").alias("cells"), F.count("aod").alias("present"), F.count(F.when(F.col("aod").isNull(), 1)).alias("missing"))


def merge_series(images: DataFrame, step: Column | None = None) -> DataFrame:
    """The images of all steps as one series: time_index, from 1, in place of the step t (from 0).
    Steps are rows of one table from the start, so nothing is united."""
    index = F.col("t") + 1 if step is None else step
    return images.withColumn("time_index", index.cast("int")).drop("t")


def series_gaps(series: DataFrame, steps: int, cells: int) -> DataFrame:
    """Expected steps that are absent or lack rows: time_index, n_rows."""
    spark = series.sparkSession
    got = series.groupBy("time_index").agg(F.count("*").alias("n_rows"))
    want = spark.range(1, steps + 1).select(F.col("id").cast("int").alias("time_index"))
    return want.join(got, "time_index", "left").select("time_index", F.coalesce("n_rows", F.lit(0)).alias("n_rows")).where(F.col("n_rows") != cells)
