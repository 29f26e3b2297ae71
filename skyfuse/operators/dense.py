"""Small dense linear algebra: pure functions on numpy arrays."""

from __future__ import annotations

import numpy as np

# fixed values: coefficients and radius of the Padé approximant of order 13
PADE = (64764752532480000.0, 32382376266240000.0, 7771770303897600.0, 1187353796428800.0, 129060195264000.0, 10559470521600.0, 670442572800.0, 33522128640.0, 1323241920.0, 40840800.0, 960960.0, 16380.0, 182.0, 1.0)
THETA = 5.371920351148152
JITTER = 1e-8


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a rational approximation and squaring."""
    norm = np.abs(a).sum(1).max() if a.size else 0.0
    s = max(0, int(np.ceil(np.log2(norm / THETA)))) if norm > 0 else 0
    x = a / 2.0**s
    eye = np.eye(len(x))
    powers = {0: eye, 2: x @ x}
    powers[4] = powers[2] @ powers[2]
    powers[6] = powers[2] @ powers[4]

    def poly(first: int) -> np.ndarray:
        high = sum(PADE[first + 6 + p] * powers[p] for p in (2, 4, 6))
        return powers[6] @ high + sum(PADE[first + p] * powers[p] for p in (0, 2, 4, 6))

    odd, even = x @ poly(1), poly(0)
    out = np.linalg.solve(even - odd, even + odd)
    for _ in range(s):
        out = out @ out
    return out


def filter_step(m, c, g, w, f, y, v, jitter: float = JITTER):
    """One Kalman step: predicted and filtered mean and covariance. v: variances of y."""
    mp, cp = g @ m, g @ c @ g.T + w
    if not len(y):
        return mp, cp, mp, cp
    q = f @ cp @ f.T + np.diag(v) + jitter * np.eye(len(y))
    gain = np.linalg.solve(q, f @ cp).T
    return mp, cp, mp + gain @ (y - f @ mp), cp - gain @ f @ cp


def kalman(fs, ys, vs, g, w, m0, c0, jitter: float = JITTER):
    """Predicted and filtered moments of every step."""
    m, c, out = m0, c0, []
    for f, y, v in zip(fs, ys, vs, strict=True):
        mp, cp, m, c = filter_step(m, c, g, w, f, y, v, jitter)
        out.append((mp, cp, m, c))
    return out


def draw(rng, mean, cov):
    cov = (cov + cov.T) / 2
    for jitter in (0.0, 1e-12, 1e-10, 1e-8, 1e-6):
        try:
            return mean + np.linalg.cholesky(cov + jitter * max(1.0, np.abs(cov).max()) * np.eye(len(mean))) @ rng.standard_normal(len(mean))
        except np.linalg.LinAlgError:
            continue
    values, vectors = np.linalg.eigh(cov)
    return mean + vectors @ (np.sqrt(np.maximum(values, 0)) * rng.standard_normal(len(mean)))


def backward_sample(rng, steps, g):
    """A path of states given the filter's moments."""
    theta = [draw(rng, steps[-1][2], steps[-1][3])]
    for t in range(len(steps) - 2, -1, -1):
        _, _, m, c = steps[t]
        mp, cp = steps[t + 1][:2]
        gain = np.linalg.solve(cp, g @ c).T
        theta.append(draw(rng, m + gain @ (theta[-1] - mp), c - gain @ g @ c))
    return np.array(theta[::-1])


def wishart(rng, df: float, scale: np.ndarray) -> np.ndarray:
    """Bartlett's construction; mean df * scale."""
    p = len(scale)
    a = np.tril(rng.standard_normal((p, p)), -1) + np.diag(np.sqrt(rng.chisquare(df - np.arange(p))))
    la = np.linalg.cholesky(scale) @ a
    return la @ la.T


def inverse_wishart(rng, df: float, phi: np.ndarray, strict_reference: bool = False) -> np.ndarray:
    """Mean phi / (df - p - 1). strict_reference: the accelerated recipe instead, whose
    diagonal has df degrees of freedom throughout and which scales like phi's inverse."""
    p = len(phi)
    if not strict_reference:
        return np.linalg.inv(wishart(rng, df, np.linalg.inv(phi)))
    a = np.tril(rng.standard_normal((p, p)), -1) + np.diag(np.sqrt(rng.chisquare(df, p)))
    z = np.linalg.solve(np.linalg.cholesky(phi), np.linalg.inv(a))
    return z.T @ z


def inverse_gamma(rng, alpha: float, beta: float) -> float:
    return 1.0 / rng.gamma(alpha, 1.0 / beta)


def residual_sums(source, theta) -> tuple[int, float]:
    """Observations of a source, and the sum of squares of what the states leave of them."""
    return sum(len(y) for _, y in source), sum(((y - f @ th) ** 2).sum() for (f, y), th in zip(source, theta, strict=True))


def gibbs(sources, g, m0, c0, samples: int, seed: int, extra_pass: bool = True, draw_first: bool = False, strict_reference: bool = False):
    """Forward filtering and backward sampling with unknown noise.

    sources: for each source a list over time of (design rows, values). Returns the
    last sample's filter means, those of one more pass with the final parameters,
    the variances and the state noise. The parameters of the noise accumulate from
    sample to sample. strict_reference: as of inverse_wishart()."""
    rng, p, t = np.random.default_rng(seed), len(m0), len(sources[0])
    alpha, beta = np.ones(len(sources)), np.full(len(sources), 0.1)
    nu, phi = float(p), 0.01 * np.eye(p)
    var = np.array([inverse_gamma(rng, a, b) for a, b in zip(alpha, beta, strict=True)]) if draw_first else beta / (alpha + 1)
    w = wishart(rng, nu, phi)
    fs = [np.vstack([s[k][0] for s in sources]) for k in range(t)]
    ys = [np.concatenate([s[k][1] for s in sources]) for k in range(t)]

    def forward():
        vs = [np.concatenate([np.full(len(s[k][1]), var[i]) for i, s in enumerate(sources)]) for k in range(t)]
        return kalman(fs, ys, vs, g, w, m0, c0)

    for _ in range(samples):
        steps = forward()
        theta = backward_sample(rng, steps, g)
        for i, s in enumerate(sources):
            n, squares = residual_sums(s, theta)
            alpha[i], beta[i] = alpha[i] + n / 2, beta[i] + squares / 2
        r = theta[1:] - theta[:-1] @ g.T
        nu, phi = nu + t - 1, phi + r.T @ r
        var = np.array([inverse_gamma(rng, a, b) for a, b in zip(alpha, beta, strict=True)])
        w = inverse_wishart(rng, nu, phi, strict_reference)
    sampled = np.array([s[2] for s in steps])
    final = np.array([s[2] for s in forward()]) if extra_pass else sampled
    return sampled, final, var, w


def gibbs_low_rank(f, y, m0, c0, samples: int, seed: int, rank: int = 8):
    """Learned dynamics: the transition is drawn through a truncated pseudo-inverse of
    the sampled path. y: values by time. Returns its mean over the last three
    quarters of the samples, and the last filter means."""
    rng, p, t = np.random.default_rng(seed), len(m0), len(y)
    alpha, beta, nu, phi, var = 8.0, 1.0, float(p), 0.01 * np.eye(p), 0.01
    w, g = inverse_wishart(rng, nu, phi), inverse_wishart(rng, nu, phi)
    kept, start = [], round(samples / 4 + 1)
    for k in range(2, samples + 1):
        steps = kalman([f] * t, y, [np.full(len(v), var) for v in y], g, w, m0, c0)
        theta = backward_sample(rng, steps, g)
        n, squares = residual_sums([(f, v) for v in y], theta)
        alpha, beta = alpha + n / 2, beta + squares / 2
        var = inverse_gamma(rng, alpha, beta)
        before, after = theta[:-1].T, theta[1:].T
        u, s, vt = np.linalg.svd(before, full_matrices=False)
        r = min(rank, len(s))
        noise = np.array([draw(rng, np.zeros(p), w) for _ in range(t - 1)]).T
        g = (after - noise) @ vt[:r].T @ np.diag(1 / s[:r]) @ u[:, :r].T
        e = after - g @ before
        nu, phi = nu + t - 1, phi + e @ e.T
        w = inverse_wishart(rng, nu, phi)
        if k >= start:
            kept.append(g)
    return np.mean(kept, 0), np.array([s[2] for s in steps])
