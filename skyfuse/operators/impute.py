"""Nearest-neighbour imputation with a categorical distance.

The units of an image are its rows; two rows differ where either value is
missing or the values are not equal. A missing cell takes the mode of the k
nearest rows that have a value in its column: ties of distance go to the smaller
row, ties of the mode to the value met first. All joins are within an image and
a column, so a group never exceeds the grid's side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def row_distances(grid: DataFrame, keys: list[str], row: str, col: str, nr: int) -> DataFrame:
    """(keys, r, s, d) for pairs of rows that agree somewhere; others are nr apart."""
    a = grid.where(F.col("aod").isNotNull()).select(*keys, F.col(row).alias("r"), F.col(col).alias("c"), "aod")
    b = a.withColumnRenamed("r", "s")
    same = a.join(b, [*keys, "c", "aod"]).where(F.col("r") != F.col("s"))
    return same.groupBy(*keys, "r", "s").agg((F.lit(nr) - F.count("*")).cast("int").alias("d"))


def knn_impute(grid: DataFrame, keys: list[str], k: int, nr: int, row: str = "lon_i", col: str = "lat_i") -> DataFrame:
    """grid (keys, lat_i, lon_i, aod; every cell) with missing values filled where
    any row has a value in the column."""
    g = grid.select(*keys, F.col(row).alias("r"), F.col(col).alias("c"), "aod")
    gaps = g.where(F.col("aod").isNull()).select(*keys, "r", "c")
    donors = g.where(F.col("aod").isNotNull()).select(*keys, F.col("r").alias("s"), "c", F.col("aod").alias("v"))
    near = row_distances(grid, keys, row, col, nr)
    found = gaps.join(donors, [*keys, "c"]).join(near, [*keys, "r", "s"], "left").withColumn("d", F.coalesce("d", F.lit(nr)))
    cell = [*keys, "r", "c"]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("d", "s"))).where(F.col("rank") <= k)
    votes = ranked.groupBy(*cell, "v").agg(F.count("*").alias("votes"), F.min("rank").alias("first"))
    mode = votes.groupBy(*cell).agg(F.max_by("v", F.struct("votes", -F.col("first"))).alias("filled"))
    out = g.join(mode, cell, "left").select(*keys, F.col("r").alias(row), F.col("c").alias(col), F.coalesce("aod", "filled").alias("aod"))
    return out.select(*grid.columns)
