"""Comparison of two versions of a field, a filter or a forecast."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def both(a: DataFrame, b: DataFrame, keys: list[str], value: str = "aod") -> DataFrame:
    """(keys, a, b) side by side; cells of either side, absent values NULL."""
    return a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full")


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows that hold both; NULL where either does not vary at all
    (least and largest tell, not a deviation that rounding may leave above 0)."""
    good = x.isNotNull() & y.isNotNull()
    a, b = F.when(good, x), F.when(good, y)
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def agreement(pairs: DataFrame, step: str = "t") -> DataFrame:
    """Per step, and over all (step NULL): n, Pearson r, RMSE, MAE, means, and the
    percentages of values missing; pairs with both values count."""
    d = F.col("a") - F.col("b")
    good = F.col("a").isNotNull() & F.col("b").isNotNull()
    x, y = F.when(good, F.col("a")), F.when(good, F.col("b"))
    return pairs.cube(step).agg(
        F.count(F.when(good, 1)).alias("n"),
        pearson(x, y).alias("r"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d)).alias("mae"),
        F.avg(x).alias("mean_a"),
        F.avg(y).alias("mean_b"),
        (F.avg(F.when(F.col("a").isNull(), 100.0).otherwise(0.0))).alias("missing_a"),
        (F.avg(F.when(F.col("b").isNull(), 100.0).otherwise(0.0))).alias("missing_b"),
    )


def verdict(r: Column) -> Column:
    return F.when(r >= 0.99, "PASS").when(r >= 0.85, "CLOSE").otherwise("DIFFERS")


def mismatch(pairs: DataFrame, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """Cells missing on one side only, largest and mean difference, and how many exceed the tolerance."""
    d = F.abs(F.col("a") - F.col("b"))
    return pairs.groupBy(*(keys or [])).agg(
        F.count("*").alias("cells"), F.count(F.when(F.col("a").isNull() != F.col("b").isNull(), 1)).alias("missing_mismatch"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"), F.count(F.when(d > tolerance, 1)).alias("over")
    )


def split_by_origin(pairs: DataFrame, original: DataFrame, keys: list[str], value: str = "aod") -> DataFrame:
    """Largest differences of imputed and of untouched cells."""
    own = original.select(*keys, F.col(value).alias("o"))
    d = F.abs(F.col("a") - F.col("b"))
    return pairs.join(own, keys).agg(F.max(F.when(F.col("o").isNull(), d)).alias("imputed"), F.max(F.when(F.col("o").isNotNull(), d)).alias("untouched"))


def worst(pairs: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k cells that differ most; ties by key."""
    d = pairs.withColumn("diff", F.abs(F.col("a") - F.col("b"))).where("diff is not null")
    return d.orderBy(F.desc("diff"), *keys).limit(k).select(*keys, "a", "b", "diff")


def rmse_by_step(pairs: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("a") - F.col("b")
    return pairs.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_diff"), F.avg(d).alias("bias"))


def coefficient_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per step: correlation of two state series, and the ratio of their mean sizes."""
    p = both(a, b, ["time_step", "coef_idx"], "value").groupBy("time_step")
    return p.agg(pearson(F.col("a"), F.col("b")).alias("corr"), F.try_divide(F.avg(F.abs("a")), F.avg(F.abs("b"))).alias("size_ratio"))


def same_counts(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Per key both counts and whether they are equal; an absent side is not."""
    p = both(a, b, [key], value)
    return p.select(key, "a", "b", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equal"))


SORTED = 1 << 16  # values that a percentile sorts at most, but for equal ones


def percentile(df: DataFrame, value: Column, p: float, name: str = "p") -> DataFrame:
    """Exact, by linear interpolation, NULL of no values. Histograms narrow down where the
    value lies, so only those of one bin are sorted, equal ones as one; nothing else is gathered."""
    rows = df.select(value.cast("double").alias("x")).where("x IS NOT NULL")
    low, high, n = rows.agg(F.min("x"), F.max("x"), F.count("*")).head()
    place, below = p * max(n - 1, 0), 0  # ranks from 0 that the answer lies between; values below `low`
    first, last = int(place), min(int(place) + 1, max(n - 1, 0))
    inside = n
    while n and inside > SORTED and low < high:
        at = F.least(F.floor((F.col("x") - low) / (high - low) * 1024), F.lit(1023))
        bins = rows.where(F.col("x").between(low, high)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect()
        upto, took = below, []
        for b in bins:  # 1,024 at most
            if upto + b["n"] > first and upto <= last:
                took.append((upto, b))
            upto += b["n"]
        (below, one), inside = took[0], sum(b["n"] for _, b in took)
        if (one["lo"], took[-1][1]["hi"]) == (low, high):
            break
        low, high = one["lo"], took[-1][1]["hi"]
    counted = rows.where(F.col("x").between(F.lit(low), F.lit(high))).groupBy("x").agg(F.count("*").alias("n"))
    upto = F.lit(below) + F.sum("n").over(Window.orderBy("x"))
    placed = counted.withColumn("upto", upto)
    holds = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
    return placed.agg(holds(first).alias("a"), holds(last).alias("b")).select((F.col("a") + (F.col("b") - F.col("a")) * (place - first)).alias(name))


def histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """bin (from 0), count and density over `bins` equal widths from the least to the
    largest value; the last bin is closed. A constant column has one full bin."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("total"))
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counted = rows.join(F.broadcast(ends)).groupBy(at.alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select("bin", "n", F.try_divide(F.col("n"), F.col("total") * width).alias("density"))


def rescale(df: DataFrame, value: str, low: float = 0.05, high: float = 0.10) -> DataFrame:
    """value stretched to low..high over the whole column; a constant column is low."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    span = F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(1.0)
    out = df.join(F.broadcast(ends)).withColumn("scaled", (F.col(value) - F.col("__lo")) / span * (high - low) + low)
    return out.drop("__lo", "__hi")


def prediction_pool(forecast_a: DataFrame, forecast_b: DataFrame) -> DataFrame:
    """Differences of two forecasts (k, site, field), all steps in one pool."""
    return both(forecast_a, forecast_b, ["k", "site"], "field").select("k", "site", (F.col("a") - F.col("b")).alias("diff"))


def gate(df: DataFrame, name: str, least: int) -> DataFrame:
    """One row: the gate's name, the rows counted, and whether they suffice."""
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("gate"), "n_rows", (F.col("n_rows") >= least).alias("passed"))


def running_mean(df: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)
    return df.withColumn(f"{value}_mean", F.avg(value).over(w))


class Stages:
    """Wall-clock seconds of named stages, as a table (section, unit, value)."""

    def __init__(self):
        self.rows: list[tuple[str, str, float]] = []

    @contextmanager
    def time(self, section: str):
        began = time.perf_counter()
        yield
        self.rows.append((section, "sec", time.perf_counter() - began))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "section string, unit string, value double")
