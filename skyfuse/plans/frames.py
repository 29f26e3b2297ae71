"""The chain from points to transition inputs, and the small inputs of the queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfuse.config import DEFAULT, Config
from skyfuse.operators import flow, impute, regrid, smooth, spectral
from skyfuse.operators import grid as cells
from skyfuse.session import written
from skyfuse.sources import synth

SMALL = Config(nr=12, resolution=0.2)
SMALL_N = 4


def images(spark: SparkSession, sf_dir: str, keys=("t",), cfg: Config = DEFAULT, steps: int = 5) -> DataFrame:
    return regrid.images(regrid.clean_points(synth.points(spark, sf_dir, steps), cfg), list(keys), cfg)


def small(spark: SparkSession, sf_dir: str, keys=("t",), cfg: Config = DEFAULT) -> DataFrame:
    """The images as a table of their own: of a size fixed by the grid and the steps, however
    many points they come from, and read several times by what follows."""
    return written(images(spark, sf_dir, keys, cfg))


def filled(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    return written(impute.knn_impute(small(spark, sf_dir) if raw is None else raw, ["t"], DEFAULT.k, DEFAULT.nr))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.optical_flow(flow.pairs(filled(spark, sf_dir), []), ["pair"], DEFAULT.nr, DEFAULT.window)


def mean_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.average(flows(spark, sf_dir), 0, 3)


def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(smooth.velocity(mean_flow(spark, sf_dir)))


def diffusivity(spark: SparkSession, sf_dir: str, v: DataFrame | None = None) -> DataFrame:
    return smooth.smagorinsky(velocity(spark, sf_dir) if v is None else v)


def gradients(spark: SparkSession, sf_dir: str, v: DataFrame | None = None) -> DataFrame:
    return smooth.gradient(smooth.kernel_smooth(diffusivity(spark, sf_dir, v), ["K"]))


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, site from 1, x, y, vx, vy, K, dKx, dKy) of the whole grid; absent values count as 0."""
    v = velocity(spark, sf_dir)
    return design_of(v, gradients(spark, sf_dir, v))


def design_of(v: DataFrame, k: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    v, n = v.select("lat_i", "lon_i", "v_x", "v_y"), cfg.nr
    zero = lambda c, a: F.coalesce(c, F.lit(0.0)).alias(a)
    return v.join(k, ["lat_i", "lon_i"]).select(
        F.lit(0).alias("domain"), (F.col("lat_i") * n + F.col("lon_i") + 1).alias("site"), (F.col("lon_i") / float(n)).alias("x"), (F.col("lat_i") / float(n)).alias("y"),
        zero("v_x", "vx"), zero("v_y", "vy"), zero("K", "K"), zero("dK_dx", "dKx"), zero("dK_dy", "dKy"),
    )


def small_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, sat, t from 1, site from 1, y) on a coarse grid."""
    own = cells.observed(images(spark, sf_dir, ("sat", "t"), SMALL), "aod", SMALL.nr)
    return own.select(F.lit(0).alias("chain"), "sat", (F.col("t") + 1).alias("t"), (F.col("site") + 1).alias("site"), F.col("aod").alias("y"))


def small_basis(spark: SparkSession) -> DataFrame:
    return spectral.fourier_basis(spectral.sites(spark, SMALL.nr), spectral.basis_columns(spark, SMALL_N))


def basis_matrix(nr: int, n: int) -> np.ndarray:
    """The basis as a dense matrix, sites by columns."""
    rows = spectral.omega_rows(n)
    one, two = [r[2:] for r in rows if r[0] == 1], [r[2:] for r in rows if r[0] == 2]
    site = np.arange(nr**2)
    x, y = site % nr / nr, site // nr / nr
    th = lambda ks: 2 * np.pi * (np.outer(x, [k[0] for k in ks]) + np.outer(y, [k[1] for k in ks]))
    return np.hstack([np.cos(th(one)), 2 * np.cos(th(two)), 2 * np.sin(th(two))])


def small_basis_matrix() -> np.ndarray:
    return basis_matrix(SMALL.nr, SMALL_N)


def simple_design(spark: SparkSession, sf_dir: str, cfg: Config = SMALL) -> DataFrame:
    """(domain, site from 1, x, y, vx, vy, K, dKx, dKy) of every step, straight from its image: a domain a step."""
    a = F.coalesce("aod", F.lit(0.0))
    return images(spark, sf_dir, ("t",), cfg).select(
        F.col("t").alias("domain"), (F.col("lat_i") * cfg.nr + F.col("lon_i") + 1).alias("site"), (F.col("lon_i") / float(cfg.nr)).alias("x"), (F.col("lat_i") / float(cfg.nr)).alias("y"),
        (a * 0.01).alias("vx"), (a * 0.02 - 0.01).alias("vy"), (a * 0.001).alias("K"), (a * 0.002).alias("dKx"), (a * -0.001).alias("dKy"),
    )


def small_transition(spark: SparkSession, size: int) -> DataFrame:
    """0.9 on the diagonal, 0.05 below it."""
    i = spark.range(1, size + 1).select(F.col("id").cast("int").alias("i"))
    return i.select("i", F.col("i").alias("j"), F.lit(0.9).alias("v")).union(i.where("i > 1").select("i", F.col("i") - 1, F.lit(0.05)))
