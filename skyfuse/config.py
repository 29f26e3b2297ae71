"""Parameters of the grid and the model, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    nr: int = 60  # cells along either axis
    lon_min: float = -124.0
    lon_max: float = -121.6
    lat_min: float = 35.0
    lat_max: float = 37.4
    resolution: float = 0.04
    k: int = 10  # neighbours of an imputation
    window: int = 15  # cells along either axis of a flow window
    flow_pairs: int = 20
    averaged_pairs: int = 19
    fourier: int = 20
    steps: int = 20
    lattice: int = 20
    gibbs_samples: int = 10
    seed: int = 222
    m0: float = 0.1
    c0: float = 0.01
    smooth_range: float = 1.0
    smooth_tol: float = 1e-8
    smagorinsky: float = 0.28
    images_per_hour: int = 12
    first_hour: int = 18


DEFAULT = Config()
