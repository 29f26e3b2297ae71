"""Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(x: Column) -> Column:
    """NaN becomes NULL: inside the engine a missing value is always NULL."""
    return F.when(~F.isnan(x), x)


def inside(lat: Column, lon: Column, cfg) -> Column:
    """Strictly inside the domain."""
    return (lat > cfg.lat_min) & (lat < cfg.lat_max) & (lon > cfg.lon_min) & (lon < cfg.lon_max)


def flow_angle(vr: Column, vc: Column) -> Column:
    """Direction in degrees [0, 360); 0 where there is no direction."""
    slope = F.degrees(F.atan(F.try_divide(vr, vc)))
    return (
        F.when((vc > 0) & (vr >= 0), slope)
        .when(vc < 0, slope + 180.0)
        .when((vc > 0) & (vr < 0), slope + 360.0)
        .when((vc == 0) & (vr > 0), 90.0)
        .when((vc == 0) & (vr < 0), 270.0)
        .otherwise(0.0)
    )


def geos_inverse(x: Column, y: Column, height: float, lon_0: float, sweep: str = "x", radius: float = 6378137.0) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a geostationary scan angle (radians), on
    a sphere; NULL off the disk."""
    r1 = height / radius
    rg = 1.0 + r1
    a, b = x * height / radius / r1, y * height / radius / r1
    if sweep == "x":
        vz = F.tan(b)
        vy = F.tan(a) * F.hypot(F.lit(1.0), vz)
    else:
        vy = F.tan(a)
        vz = F.tan(b) * F.hypot(F.lit(1.0), vy)
    qa = vy * vy + vz * vz + 1.0
    qb = F.lit(-2.0 * rg)
    d = qb * qb - qa * (4.0 * (rg * rg - 1.0))
    k = (-qb - F.sqrt(F.when(d >= 0, d))) / (qa * 2.0)
    px, py, pz = rg - k, k * vy, k * vz
    lam = F.atan2(py, px)
    phi = F.atan(pz * F.cos(lam) / px)
    return F.degrees(lam) + lon_0, F.degrees(phi)


def speed_kmh(speed: Column) -> Column:
    return speed * 60 * 0.04 * 111 * 12


def diffusivity_km2h(k: Column) -> Column:
    return k * 60 * 60 * 0.04 * 111 * 0.04 * 111 * 12


def wave_phase(x: Column, y: Column, k1: Column, k2: Column) -> Column:
    return (x * k1 + y * k2) * (2 * math.pi)


def slot_index(hour: Column, j: Column, cfg) -> Column:
    """Time step, from 1, of the j-th image (from 0) of an hour."""
    return (hour - cfg.first_hour) * cfg.images_per_hour + j + 1
