"""Table functions for SQL: SELECT * FROM omega(20), grid(60, 0.04, 35.0, -124.0), lattice(60, 20)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from skyfuse.operators.spectral import omega_rows
from skyfuse.session import ship


@udtf(returnType="grp int, ord int, k1 int, k2 int")
class Omega:
    def eval(self, n: int):
        yield from omega_rows(n)


@udtf(returnType="site int, lat_i int, lon_i int, lat double, lon double")
class Grid:
    def eval(self, nr: int, resolution: float, lat_min: float, lon_min: float):
        for site in range(nr * nr):
            i, j = divmod(site, nr)
            yield site, i, j, float(lat_min) + (i + 0.5) * float(resolution), float(lon_min) + (j + 0.5) * float(resolution)


@udtf(returnType="idx int")
class Lattice:
    def eval(self, nr: int, n: int):
        for k in range(1, n + 1):
            yield (int(float(nr) / n * k) - 1,)


def register(spark: SparkSession) -> None:
    ship(spark)
    for name, function in (("omega", Omega), ("grid", Grid), ("lattice", Lattice)):
        spark.udtf.register(name, function)
