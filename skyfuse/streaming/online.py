"""Streaming forms: gridding by event time, last known values, an online filter."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyfuse.config import DEFAULT, Config
from skyfuse.operators import dense
from skyfuse.operators.regrid import clean_points, in_cells


def windowed_regrid(points: DataFrame, every: str = "5 minutes", late: str = "10 minutes", cfg: Config = DEFAULT) -> DataFrame:
    """Mean and count per window and cell of points (ts, lat, lon, aod); points later
    than the watermark are left out."""
    rows = in_cells(clean_points(points, cfg), cfg).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", every).alias("window"), "lat_i", "lon_i").agg(F.count("*").alias("n"), F.avg("aod").alias("aod"))


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value per window and type."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", every).alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def _latest(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    when, value = state.get if state.exists else (None, None)
    for b in batches:
        newest = b.loc[b["ts"].idxmax()]
        if when is None or newest["ts"].value >= when:
            when, value = newest["ts"].value, float(newest["aod"])
    if when is not None:
        state.update((when, value))
        yield pd.DataFrame({"lat_i": [key[0]], "lon_i": [key[1]], "ts": [pd.Timestamp(when)], "aod": [value]})


def last_known(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The newest value of each cell so far, whatever order points come in."""
    rows = in_cells(clean_points(points, cfg), cfg).select("lat_i", "lon_i", "ts", "aod")
    return rows.groupBy("lat_i", "lon_i").applyInPandasWithState(_latest, "lat_i int, lon_i int, ts timestamp, aod double", "ts long, aod double", "update", GroupStateTimeout.NoTimeout)


def online_filter(obs: DataFrame, basis: np.ndarray, g: np.ndarray, w: np.ndarray, variance: float | dict, m0: np.ndarray, c0: np.ndarray, first: int = 1) -> DataFrame:
    """The filter of each domain, a step for each new t: obs (domain, t, site, y), and sat where
    variance is by source; emits (domain, t, coef_idx, value) for every step from `first` on.
    Steps that nothing was observed in are predicted through, as in the batch filter. A step that
    comes after a later one was filtered is left out; one step's rows come in one batch. A
    domain's moments and its last step are its state."""

    def run(key, batches, state):
        m, c, last = pickle.loads(state.get[0]) if state.exists else (m0, c0, first - 1)
        rows = pd.concat(list(batches))
        order = ["sat", "site"] if isinstance(variance, dict) else ["site"]
        for t, now in rows[rows["t"] > last].groupby("t"):
            now = now.sort_values(order)
            v = now["sat"].map(variance).to_numpy(float) if isinstance(variance, dict) else np.full(len(now), variance)
            for step in range(last + 1, int(t) + 1):
                seen = now if step == t else now.iloc[:0]
                _, _, m, c = dense.filter_step(m, c, g, w, basis[seen["site"].to_numpy(int) - 1], seen["y"].to_numpy(float), v[: len(seen)])
                yield pd.DataFrame({"domain": key[0], "t": step, "coef_idx": np.arange(1, len(m) + 1), "value": m})
            last = int(t)
        state.update((pickle.dumps((m, c, last)),))

    return obs.groupBy("domain").applyInPandasWithState(run, "domain int, t int, coef_idx int, value double", "moments binary", "append", GroupStateTimeout.NoTimeout)
