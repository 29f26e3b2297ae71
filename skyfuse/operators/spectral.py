"""Spectral basis, generator matrix and forecasts, as relations over (i, j, v).

Everything indexed by frequency has a size fixed by N; what grows is the number
of sites, times and domains, over which the sums are plain aggregations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfuse.functions.scalar import wave_phase
from skyfuse.session import ship

TWO_PI = 2 * math.pi


def omega_rows(n: int) -> list[tuple[int, int, int, int]]:
    """(grp, ord, k1, k2): 4 corner frequencies, then half the plane without them."""
    h = n // 2
    first = [(k1, k2) for k1 in (0, h) for k2 in (0, h)]
    second = [(k, h) for k in range(1, h)]
    second += [(k1, k2) for k2 in range(1, h) for k1 in range(h + 1)]
    second += [(k1, k2) for k2 in range(1 - h, 1) for k1 in range(1, h)]
    return [(g, i, *k) for g, ks in ((1, first), (2, second)) for i, k in enumerate(ks, 1)]


def omega(spark: SparkSession, n: int) -> DataFrame:
    return spark.createDataFrame(omega_rows(n), "grp int, ord int, k1 int, k2 int")


def basis_columns(spark: SparkSession, n: int) -> DataFrame:
    """(col from 1, kind, k1, k2): cosines of the corners, cosines, then sines of the rest."""
    rows = omega_rows(n)
    one, two = [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 2]
    kinds = [("c1", r) for r in one] + [("c2", r) for r in two] + [("s2", r) for r in two]
    return spark.createDataFrame([(i, kind, r[2], r[3]) for i, (kind, r) in enumerate(kinds, 1)], "col int, kind string, k1 int, k2 int")


def sites(spark: SparkSession, nr: int) -> DataFrame:
    """(site from 1, x, y) in grid sides; x is the longitude's, which runs fastest."""
    i = spark.range(nr * nr)
    return i.select((F.col("id") + 1).cast("int").alias("site"), ((F.col("id") % nr) / float(nr)).alias("x"), (F.floor(F.col("id") / nr) / float(nr)).alias("y"))


def fourier_basis(at: DataFrame, columns: DataFrame) -> DataFrame:
    """(site, col, v). columns has N * N rows and is broadcast to the sites."""
    th = wave_phase(F.col("x"), F.col("y"), F.col("k1"), F.col("k2"))
    v = F.when(F.col("kind") == "c1", F.cos(th)).when(F.col("kind") == "c2", F.cos(th) * 2.0).otherwise(F.sin(th) * 2.0)
    return at.join(F.broadcast(columns)).select("site", "col", v.alias("v"))


def dft(grid: DataFrame, frequencies: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Per frequency the sums of value * cos and value * sin over an n x n grid
    (i, j from 0, value), divided by n * n. frequencies is small and broadcast."""
    keys = keys or []
    th = (F.col("i") * F.col("k1") + F.col("j") * F.col("k2")) * (TWO_PI / n)
    wave = grid.join(F.broadcast(frequencies)).select(*keys, "k1", "k2", (F.col("value") * F.cos(th)).alias("c"), (F.col("value") * F.sin(th)).alias("s"))
    return wave.groupBy(*keys, "k1", "k2").agg((F.sum("c") / float(n * n)).alias("re"), (F.sum("s") / float(n * n)).alias("im"))


def uniform_generator(spark: SparkSession, n: int) -> DataFrame:
    """The generator of a constant drift: only (cosine, sine) pairs of a frequency couple."""
    rows = omega_rows(n)
    k1 = sum(r[0] == 1 for r in rows)
    k2 = len(rows) - k1
    two = omega(spark, n).where("grp = 2")
    rate = (F.col("k1") + F.col("k2")) * TWO_PI
    up = two.select((F.col("ord") + k1).alias("i"), (F.col("ord") + k1 + k2).alias("j"), (-rate).alias("v"))
    return up.union(two.select((F.col("ord") + k1 + k2).alias("i"), (F.col("ord") + k1).alias("j"), rate.alias("v")))


def generator_matrix(design: DataFrame, n: int, delta: float, key: str = "domain", strict_reference: bool = True) -> DataFrame:
    """(key, i, j, v), 1-based, of the advection-diffusion generator over the sites of
    each domain's design (key, site, x, y, vx, vy, K, dKx, dKy).

    An entry is one sum over sites. Each task makes the sums over its own sites as three dense
    products and sends one row for each entry, whatever the number of sites, so neither a
    domain nor a site is shuffled. strict_reference: the sign that the published model gives the
    gradient's part in the sines' images; without it the derivative's own."""
    ship(design.sparkSession)
    kind, columns = design.schema[key].dataType.simpleString(), ["x", "y", "vx", "vy", "K", "dKx", "dKy"]

    def run(batches):
        sums: dict = {}

        def sent():
            for k, total in sums.items():
                i, j = np.meshgrid(np.arange(1, len(total) + 1), np.arange(1, len(total) + 1), indexing="ij")
                yield pd.DataFrame({key: k, "i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "v": total.ravel()})
            sums.clear()

        for batch in batches:
            for k, rows in batch.groupby(key, dropna=False):
                own = generator_dense(rows, n, delta, strict_reference)
                sums[k] = sums[k] + own if k in sums else own
                if len(sums) > 16:
                    yield from sent()
        yield from sent()

    parts = design.select(key, *columns).mapInPandas(run, f"{key} {kind}, i int, j int, v double")
    return parts.groupBy(key, "i", "j").agg(F.sum("v").alias("v"))


def generator_dense(design: pd.DataFrame, n: int, delta: float, strict_reference: bool = True) -> np.ndarray:
    """The generator over some sites, as three dense products.

    Rows and columns are the basis' functions. A row's test function meets each column's image
    under the operator at every site; the columns multiply the sums by constants."""
    rows = omega_rows(n)
    one = np.array([r[2:] for r in rows if r[0] == 1], float)
    two = np.array([r[2:] for r in rows if r[0] == 2], float)
    freq = np.vstack([one, two])
    x, y, vx, vy, k, kx, ky = (design[c].to_numpy(float)[:, None] for c in ("x", "y", "vx", "vy", "K", "dKx", "dKy"))
    th = TWO_PI * (x * freq[:, 0] + y * freq[:, 1])
    c, s = np.cos(th), np.sin(th)
    v = TWO_PI * (vx * freq[:, 0] + vy * freq[:, 1])
    lap = -4 * math.pi**2 * (freq**2).sum(1) * k
    slope = TWO_PI * (kx * freq[:, 0] + ky * freq[:, 1])
    a, b = lap * c - slope * s, lap * s - slope * c if strict_reference else lap * s + slope * c
    k1 = len(one)
    dd = delta * delta
    # a constant test function has half the weight of the other corners'
    ca = np.where(np.arange(len(freq)) < k1, 1.0, 2.0)
    cb = np.where((np.arange(len(freq)) > 0) & (np.arange(len(freq)) < k1), 2.0, 1.0)
    pc, ps = (v * s + a), (-v * c + b)[:, k1:]
    top = np.hstack([(c.T @ pc) * ca, (c.T @ ps) * 2.0]) * cb[:, None] * dd
    s2 = s[:, k1:]
    low = np.hstack([(s2.T @ pc) * ca * dd, 2 * dd * (-(v[:, k1:] * s2).T @ c[:, k1:] + b[:, k1:].T @ s2)])
    return np.vstack([top, low])


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) product of two matrices of that form; absent entries are 0."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j2"), F.col("v").alias("w"))
    return a.join(right, a["j"] == right["k"]).groupBy("i", F.col("j2").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def matvec(a: DataFrame, x: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """a (i, j, v) times vectors (keys, coef_idx, value)."""
    keys = keys or []
    return a.join(x, a["j"] == x["coef_idx"]).groupBy(*keys, F.col("i").alias("coef_idx")).agg(F.sum(F.col("v") * F.col("value")).alias("value"))


def reconstruct(basis: DataFrame, state: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    """Field and bias per site: the first `size` coefficients are the field's, the next the bias'."""
    keys = ["time_step"] if keys is None else keys
    part = state.select(*keys, F.when(F.col("coef_idx") > size, F.col("coef_idx") - size).otherwise(F.col("coef_idx")).alias("col"), (F.col("coef_idx") > size).alias("bias"), "value")
    got = basis.join(part, "col").groupBy(*keys, "site")
    field = F.sum(F.when(~F.col("bias"), F.col("v") * F.col("value")).otherwise(0.0))
    return got.agg(field.alias("field"), F.sum(F.when(F.col("bias"), F.col("v") * F.col("value")).otherwise(0.0)).alias("bias"))


def forecast(basis: DataFrame, transition: DataFrame, last: DataFrame, steps: int, size: int) -> DataFrame:
    """(k, site, field) for k = 1..steps: basis * transition**k * last (coef_idx, value)."""
    x = last.where(F.col("coef_idx") <= size).select("coef_idx", "value")
    out = None
    for k in range(1, steps + 1):
        x = matvec(transition, x)
        step = basis.join(x, basis["col"] == x["coef_idx"]).groupBy("site").agg(F.sum(F.col("v") * F.col("value")).alias("field")).select(F.lit(k).alias("k"), "site", "field")
        out = step if out is None else out.union(step)
    return out


def sources_signal(at: DataFrame, centres: list[tuple[float, float] | None], size: float, reach: float) -> DataFrame:
    """(site, signal): up to four sources whose strength falls with distance; None adds nothing."""
    total = F.lit(0.0)
    for c in centres:
        if c is not None:
            d = F.sqrt((F.col("x") - c[0]) * (F.col("x") - c[0]) + (F.col("y") - c[1]) * (F.col("y") - c[1]))
            total = total + F.exp(-d / (2 * reach * reach)) * (size / (TWO_PI * reach * reach))
    return at.select("site", total.alias("signal"))


def augmented(transition: DataFrame, size: int) -> DataFrame:
    """[[G, I], [0, I]] in (i, j, v) form."""
    eye = transition.sparkSession.range(1, size + 1).select(F.col("id").cast("int").alias("d"))
    return transition.select("i", "j", "v").union(eye.select("d", F.col("d") + size, F.lit(1.0))).union(eye.select(F.col("d") + size, F.col("d") + size, F.lit(1.0)))


def max_row_sum(matrix: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The largest sum of absolute values of a row, per key."""
    keys = keys or []
    return matrix.groupBy(*keys, "i").agg(F.sum(F.abs("v")).alias("s")).groupBy(*keys).agg(F.max("s").alias("norm"))


def identity(spark: SparkSession, size: int) -> DataFrame:
    i = spark.range(1, size + 1).select(F.col("id").cast("int").alias("i"))
    return i.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))


def axpby(a: float, x: DataFrame, b: float, y: DataFrame) -> DataFrame:
    """a * x + b * y of two (i, j, v) matrices; absent entries are 0."""
    both = x.select("i", "j", (F.col("v") * a).alias("v")).union(y.select("i", "j", (F.col("v") * b).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def scaled(matrix: DataFrame, by: float) -> DataFrame:
    return matrix.select("i", "j", (F.col("v") * by).alias("v"))


def add_diagonal(matrix: DataFrame, size: int, value: float) -> DataFrame:
    """The matrix with value added along the diagonal, also where it had no entry."""
    return axpby(1.0, matrix, value, identity(matrix.sparkSession, size))


def clip(field: DataFrame, value: str, least: float = 0.0) -> DataFrame:
    """Values below `least` become it; missing ones stay missing."""
    return field.withColumn(value, F.when(F.col(value).isNotNull(), F.greatest(F.col(value), F.lit(least))))


def stack(obs: DataFrame, basis: DataFrame, variance: dict, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The sources' observations below each other at each step, by source, then site: rows
    (keys, t, row from 1, sat, site, y, variance), and the design rows (keys, t, row, col, v).
    The design's second half, of the bias, is 0 and has no entries."""
    keys = keys or []
    noise = F.element_at(F.create_map(*[F.lit(x) for kv in variance.items() for x in kv]), F.col("sat"))
    # a step's rows are bounded by the grid's sites and the sources
    place = F.row_number().over(Window.partitionBy(*keys, "t").orderBy("sat", "site"))
    rows = obs.where("y IS NOT NULL").select(*keys, "t", place.alias("row"), "sat", "site", "y", noise.alias("variance"))
    return rows, rows.join(basis, "site").select(*keys, "t", "row", "col", "v")


def residuals(obs: DataFrame, basis: DataFrame, path: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, sat, n, sum_sq): per source the observations and the sum of squares of what
    a path of states (keys, time_step, coef_idx, value) leaves of them."""
    keys = keys or []
    fitted = basis.join(path, F.col("col") == F.col("coef_idx")).groupBy(*keys, F.col("time_step").alias("t"), "site").agg(F.sum(F.col("v") * F.col("value")).alias("fit"))
    left = obs.where("y IS NOT NULL").join(fitted, [*keys, "t", "site"])
    e = F.col("y") - F.col("fit")
    return left.groupBy(*keys, "sat").agg(F.count("*").alias("n"), F.sum(e * e).alias("sum_sq"))


def state_residuals(path: DataFrame, transition: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, time_step, coef_idx, value): each state less what the transition makes of the one before."""
    keys = keys or []
    said = matvec(transition, path, [*keys, "time_step"]).select(*keys, (F.col("time_step") + 1).alias("time_step"), "coef_idx", F.col("value").alias("said"))
    return path.join(said, [*keys, "time_step", "coef_idx"]).select(*keys, "time_step", "coef_idx", (F.col("value") - F.col("said")).alias("value"))
