"""The regular grid: cells, lattice, transposition, and long-to-wide forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfuse.config import DEFAULT, Config


def centre(i: Column, low: float, cfg: Config = DEFAULT) -> Column:
    """Cell centre; the order of operations decides which points lie on an edge."""
    return (i + 0.5) * cfg.resolution + low


def bounds(i: Column, low: float, cfg: Config = DEFAULT) -> tuple[Column, Column]:
    half = 0.5 * cfg.resolution
    return centre(i, low, cfg) - half, centre(i, low, cfg) + half


def cells(spark: SparkSession, cfg: Config = DEFAULT) -> DataFrame:
    """site, lat_i, lon_i, lat, lon of every cell; longitude runs fastest."""
    i = spark.range(cfg.nr * cfg.nr).select(F.col("id").cast("int").alias("site"))
    at = i.select("site", F.floor(F.col("site") / cfg.nr).cast("int").alias("lat_i"), (F.col("site") % cfg.nr).cast("int").alias("lon_i"))
    return at.select("*", centre(F.col("lat_i"), cfg.lat_min, cfg).alias("lat"), centre(F.col("lon_i"), cfg.lon_min, cfg).alias("lon"))


def with_cells(images: DataFrame, keys: list[str], nr: int) -> DataFrame:
    """Every cell of each image in images (its keys), without values."""
    site = F.explode(F.sequence(F.lit(0), F.lit(nr * nr - 1)))
    every = images.select(*keys).distinct().withColumn("site", site)
    return every.select(*keys, F.floor(F.col("site") / nr).cast("int").alias("lat_i"), (F.col("site") % nr).cast("int").alias("lon_i"))


def complete(grid: DataFrame, keys: list[str], nr: int) -> DataFrame:
    """grid with a row for each cell of its images; absent cells have NULL values."""
    return with_cells(grid, keys, nr).join(grid, [*keys, "lat_i", "lon_i"], "left")


def transpose(grid: DataFrame) -> DataFrame:
    """Swap the axes: in long form, the names of the key columns."""
    other = {"lat_i": "lon_i", "lon_i": "lat_i"}
    return grid.select(*[F.col(other.get(c, c)).alias(c) for c in grid.columns])


def wide(grid: DataFrame, row: str, column: str, value: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """One row per key and `row` value, with columns V1..Vn."""
    keys = keys or []
    out = grid.groupBy(*keys, row).pivot(column, list(range(n))).agg(F.first(value))
    return out.select(*keys, row, *[F.col(str(i)).alias(f"V{i + 1}") for i in range(n)])


def lattice(spark: SparkSession, nr: int, n: int) -> DataFrame:
    """Chosen indices along an axis: idx = trunc(nr / n * k) - 1, k = 1..n."""
    k = spark.range(1, n + 1)
    return k.select((F.floor(F.col("id") * (float(nr) / n)).cast("int") - 1).alias("idx"))


def down_sample(grid: DataFrame, value: str, nr: int, n: int) -> DataFrame:
    """Values off the n x n lattice become NULL; all cells stay."""
    chosen = sorted({int(float(nr) / n * k) - 1 for k in range(1, n + 1)})
    on = F.col("lat_i").isin(chosen) & F.col("lon_i").isin(chosen)
    return grid.withColumn(value, F.when(on, F.col(value)))


def observed(grid: DataFrame, value: str, nr: int) -> DataFrame:
    """Cells that hold a value, with their site number."""
    return grid.where(F.col(value).isNotNull()).withColumn("site", F.col("lat_i") * nr + F.col("lon_i"))
