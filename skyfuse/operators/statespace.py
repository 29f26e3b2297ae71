"""State-space models run per chain or scenario, one Arrow group each.

A chain's matrices have a size fixed by the model, so a group fits one task;
the cluster's width goes to chains, scenarios and domains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfuse.operators import dense, spectral
from skyfuse.session import ship

STATE = "time_step int, coef_idx int, value double"


def _matrix(rows, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for r in rows:
        out[int(r["i"]) - 1, int(r["j"]) - 1] = r["v"]
    return out


def expm(matrices: DataFrame, size: int, key: str = "matrix_id") -> DataFrame:
    """(key, i, j, v) -> the exponentials, same form, all entries."""
    ship(matrices.sparkSession)
    kind = matrices.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((size, size))
        a[group["i"].to_numpy(int) - 1, group["j"].to_numpy(int) - 1] = group["v"].to_numpy(float)
        i, j = np.meshgrid(np.arange(1, size + 1), np.arange(1, size + 1), indexing="ij")
        return pd.DataFrame({key: group[key].iloc[0], "i": i.ravel(), "j": j.ravel(), "v": dense.expm(a).ravel()})

    return matrices.select(key, "i", "j", "v").groupBy(key).applyInPandas(run, f"{key} {kind}, i int, j int, v double")


def transition(design: DataFrame, n: int, delta: float, key: str = "domain", strict_reference: bool = True) -> DataFrame:
    """(key, i, j, v): the exponential of each domain's generator, from the rows of its
    design (key, site, x, y, vx, vy, K, dKx, dKy). Sums over sites are made where the sites are;
    a task gets matrices, whose size N fixes."""
    return expm(spectral.generator_matrix(design, n, delta, key, strict_reference), n * n, key)


def _by_time(group: pd.DataFrame, basis: np.ndarray, steps: int, source) -> list:
    rows = group[group["sat"] == source]
    out = []
    for t in range(1, steps + 1):
        now = rows[rows["t"] == t].sort_values("site")
        out.append((basis[now["site"].to_numpy(int) - 1], now["y"].to_numpy(float)))
    return out


def _state(chain, key: str, means: np.ndarray, **more) -> pd.DataFrame:
    t, p = means.shape
    return pd.DataFrame({key: chain, **more, "time_step": np.repeat(np.arange(1, t + 1), p), "coef_idx": np.tile(np.arange(1, p + 1), t), "value": means.ravel()})


def kalman_filter(obs: DataFrame, basis: np.ndarray, g: np.ndarray, w: np.ndarray, variance: dict, m0, c0, steps: int, key: str = "chain") -> DataFrame:
    """Filtered means of each chain. obs: (key, sat, t, site, y), sites and steps from
    1; variance: of each source's noise. Steps without observations are predicted."""
    ship(obs.sparkSession)
    kind = obs.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _state(group[key].iloc[0], key, np.array([x[2] for x in _moments(group, basis, g, w, variance, m0, c0, steps)]))

    return obs.groupBy(key).applyInPandas(run, f"{key} {kind}, {STATE}")


def _moments(group: pd.DataFrame, basis, g, w, variance: dict, m0, c0, steps: int):
    own = {s: _by_time(group, basis, steps, s) for s in sorted(variance)}
    fs = [np.vstack([own[s][t][0] for s in own]) for t in range(steps)]
    ys = [np.concatenate([own[s][t][1] for s in own]) for t in range(steps)]
    vs = [np.concatenate([np.full(len(own[s][t][1]), variance[s]) for s in own]) for t in range(steps)]
    return dense.kalman(fs, ys, vs, g, w, m0, c0)


def kalman_moments(obs: DataFrame, basis: np.ndarray, g: np.ndarray, w: np.ndarray, variance: dict, m0, c0, steps: int, key: str = "chain", strict_reference: bool = False) -> DataFrame:
    """(key, kind, time_step, i, j, value): predicted and filtered moments of each chain; j = 0 is
    the mean, else an entry of the covariance. The prediction goes on to step steps + 1;
    strict_reference: from the filtered covariance of the last step without the state's noise."""
    ship(obs.sparkSession)
    kind = obs.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        moments = _moments(group, basis, g, w, variance, m0, c0, steps)
        m, c = moments[-1][2:]
        ahead = [("predicted", steps + 1, g @ m, g @ c @ g.T + (0 if strict_reference else w))]
        for name, t, mean, cov in [x for t, s in enumerate(moments, 1) for x in (("predicted", t, *s[:2]), ("filtered", t, *s[2:]))] + ahead:
            p = len(mean)
            i, j = np.meshgrid(np.arange(1, p + 1), np.arange(p + 1), indexing="ij")
            out.append(pd.DataFrame({key: group[key].iloc[0], "kind": name, "time_step": t, "i": i.ravel(), "j": j.ravel(), "value": np.hstack([mean[:, None], cov]).ravel()}))
        return pd.concat(out)

    return obs.groupBy(key).applyInPandas(run, f"{key} {kind}, kind string, time_step int, i int, j int, value double")


def backward_sample(obs: DataFrame, basis: np.ndarray, g: np.ndarray, w: np.ndarray, variance: dict, m0, c0, steps: int, seed: int = 222, key: str = "chain") -> DataFrame:
    """(key, time_step, coef_idx, value): a path of states drawn backwards from each chain's
    filter. A chain's draws depend on its key and the seed alone."""
    ship(obs.sparkSession)
    kind = obs.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        chain = group[key].iloc[0]
        moments = _moments(group, basis, g, w, variance, m0, c0, steps)
        return _state(chain, key, dense.backward_sample(np.random.default_rng(seed + int(chain)), moments, g))

    return obs.groupBy(key).applyInPandas(run, f"{key} {kind}, {STATE}")


def gibbs_ffbs(obs: DataFrame, basis: np.ndarray, g: np.ndarray, m0, c0, steps: int, samples: int = 10, seed: int = 222, sats: tuple = (0, 1), key: str = "chain", strict_reference: bool = False) -> DataFrame:
    """(key, pass, time_step, coef_idx, value): filter means of the last sample
    (pass 'sample') and of one more pass with the final parameters (pass 'final').
    A chain's draws depend on its key and the seed alone. One source: sats of one.
    strict_reference: the accelerated recipe of the state noise's draws."""
    ship(obs.sparkSession)
    kind = obs.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        chain = group[key].iloc[0]
        sources = [_by_time(group, basis, steps, s) for s in sats]
        sampled, final, _, _ = dense.gibbs(sources, g, m0, c0, samples, seed + int(chain), strict_reference=strict_reference)
        return pd.concat([_state(chain, key, sampled, **{"pass": "sample"}), _state(chain, key, final, **{"pass": "final"})])

    return obs.groupBy(key).applyInPandas(run, f"{key} {kind}, pass string, {STATE}")


def gibbs_low_rank(obs: DataFrame, basis: np.ndarray, m0, c0, steps: int, samples: int = 8, seed: int = 222, key: str = "chain") -> DataFrame:
    """(key, i, j, v): the learned transition of each chain. obs must be complete."""
    ship(obs.sparkSession)
    kind = obs.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        chain = group[key].iloc[0]
        y = [group[group["t"] == t].sort_values("site")["y"].to_numpy(float) for t in range(1, steps + 1)]
        g, _ = dense.gibbs_low_rank(basis, y, m0, c0, samples, seed + int(chain))
        i, j = np.meshgrid(np.arange(1, len(g) + 1), np.arange(1, len(g) + 1), indexing="ij")
        return pd.DataFrame({key: chain, "i": i.ravel(), "j": j.ravel(), "v": g.ravel()})

    return obs.groupBy(key).applyInPandas(run, f"{key} {kind}, i int, j int, v double")


def fusion_study(scenarios: DataFrame, basis: np.ndarray, coef: np.ndarray, generator: np.ndarray, bias: float, seed: int = 222, samples: int = 5, steps: int = 30, fitted: int = 20, step: float = 0.015, noise: float = 0.1) -> DataFrame:
    """(scenario, t, mse_weighted, mse_model) for scenarios (scenario, sigma1, sigma2):
    a simulated field observed by two sources, fused by inverse variances and by
    the model; beyond `fitted` steps the model forecasts."""
    ship(scenarios.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        s = group.iloc[0]
        rng = np.random.default_rng(seed + int(s["scenario"]))
        g, alpha, truth = dense.expm(step * generator), coef, []
        for t in range(steps):
            alpha = g @ alpha if t else alpha
            truth.append(np.maximum(basis @ alpha + noise * rng.standard_normal(len(basis)), 0))
        y1 = [y + s["sigma1"] * rng.standard_normal(len(y)) + bias for y in truth]
        y2 = [y + s["sigma2"] * rng.standard_normal(len(y)) for y in truth]
        rho = (s["sigma1"] / s["sigma2"]) ** 2
        weighted = [((a / (1 + rho) + b * rho / (1 + rho) - y) ** 2).mean() for a, b, y in zip(y1, y2, truth, strict=True)]
        p = basis.shape[1]
        big = np.block([[g, np.eye(p)], [np.zeros((p, p)), np.eye(p)]])
        f1, f2 = np.hstack([basis, np.zeros_like(basis)]), np.hstack([basis, np.zeros_like(basis)])
        sources = [[(f1, y) for y in y1[:fitted]], [(f2, y) for y in y2[:fitted]]]
        _, final, _, _ = dense.gibbs(sources, big, np.full(2 * p, 0.1), 0.01 * np.eye(2 * p), samples, seed)
        model = [((f1 @ final[t] - truth[t]) ** 2).mean() for t in range(fitted)]
        for t in range(fitted, steps):
            ahead = dense.expm((t - fitted + 1) * step * generator)
            model.append(((basis @ ahead @ final[-1][:p] - truth[t]) ** 2).mean())
        return pd.DataFrame({"scenario": int(s["scenario"]), "t": np.arange(1, steps + 1), "mse_weighted": weighted, "mse_model": model})

    return scenarios.groupBy("scenario").applyInPandas(run, "scenario int, t int, mse_weighted double, mse_model double")


def noise_settings(biased: bool) -> list[tuple[int, float, float]]:
    pairs = [(0.36, 0.36), (0.36, 3.6), (3.6, 0.36), (3.6, 3.6)] if biased else [(0.36, 0.36), (0.36, 3.6), (3.6, 3.6)]
    return [(i, a, b) for i, (a, b) in enumerate(pairs, 1)]


def fuse(obs: DataFrame, sigma1: float, sigma2: float) -> DataFrame:
    """Inverse-variance mean of two sources where both have a value: (t, site, y)."""
    rho = (sigma1 / sigma2) ** 2
    a, b = (obs.where(F.col("sat") == s).select("t", "site", F.col("y").alias(f"y{s}")) for s in (0, 1))
    return a.join(b, ["t", "site"]).select("t", "site", (F.col("y0") / (1 + rho) + F.col("y1") * (rho / (1 + rho))).alias("y"))
