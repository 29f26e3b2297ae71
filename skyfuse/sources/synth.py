"""Deterministic inputs derived from the driver's tables by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfuse.session import table


def points(spark: SparkSession, sf_dir: str, steps: int = 5) -> DataFrame:
    """A point cloud over the domain: sat, t (0 to steps - 1), lat, lon, aod, a row per lineitem row."""
    k = F.col
    lat = F.round(F.lit(35.0) + ((k("l_partkey") * 37 + k("l_linenumber") * 11) % 239 + 1) / F.lit(100.0), 2)
    lon = F.round(F.lit(-124.0) + ((k("l_orderkey") * 53 + k("l_suppkey") * 7) % 239 + 1) / F.lit(100.0), 2)
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((k("l_linenumber") % 2).cast("int").alias("sat"), (k("l_suppkey") % steps).cast("int").alias("t"), lat.alias("lat"), lon.alias("lon"), (k("l_discount") * 10).alias("aod"))


def state(spark: SparkSession, steps: int, size: int) -> DataFrame:
    """Coefficient series in long form: time_step, coef_idx, value."""
    grid = spark.range(steps * size).select((F.floor(F.col("id") / size) + 1).cast("int").alias("time_step"), (F.col("id") % size + 1).cast("int").alias("coef_idx"))
    return grid.withColumn("value", ((F.col("coef_idx") * 31 + F.col("time_step") * 17) % 101) / F.lit(100.0))
