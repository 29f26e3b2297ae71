"""Operators against plain loops and closed forms, with the edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfuse.config import DEFAULT, Config
from skyfuse.functions import scalar
from skyfuse.operators import compare, dense, flow, grid, impute, regrid, smooth, spectral, statespace

IMAGE = "t int, lat_i int, lon_i int, aod double"


def image(spark, a, t=0):
    n = len(a)
    return spark.createDataFrame([(t, i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(n) for j in range(n)], IMAGE)


def to_matrix(df, value, n):
    out = np.full((n, n), np.nan)
    for r in df.collect():
        if r[value] is not None:
            out[r["lat_i"], r["lon_i"]] = r[value]
    return out


def test_edge_point_counts_in_two_cells_and_corner_in_four(spark):
    unit = Config(nr=3, lon_min=0.0, lon_max=3.0, lat_min=0.0, lat_max=3.0, resolution=1.0)
    p = spark.createDataFrame([(0, 1.0, 0.5, 4.0), (0, 2.0, 2.0, 8.0), (0, 0.5, 0.5, 1.0), (0, 3.0, 0.5, 9.0), (0, float("nan"), 0.5, 9.0), (0, 2.5, 0.5, -3.0)], "t int, lat double, lon double, aod double")
    got = {(r["lat_i"], r["lon_i"]): (r["n"], r["aod"]) for r in regrid.regrid(regrid.clean_points(p, unit), cfg=unit).collect()}
    assert got == {(0, 0): (2, 2.5), (1, 0): (1, 4.0), (1, 1): (1, 8.0), (1, 2): (1, 8.0), (2, 1): (1, 8.0), (2, 2): (1, 8.0), (2, 0): (1, 0.0)}


def test_regrid_matches_direct_scan(spark):
    rng = np.random.default_rng(1)
    lat, lon = np.round(rng.uniform(35.0, 37.4, 400), 2), np.round(rng.uniform(-124.0, -121.6, 400), 2)
    aod = rng.uniform(0, 3, 400).round(3)
    p = spark.createDataFrame([(0, *map(float, x)) for x in zip(lat, lon, aod, strict=True)], "t int, lat double, lon double, aod double")
    got = {(r["lat_i"], r["lon_i"]): r["n"] for r in regrid.regrid(regrid.clean_points(p)).collect()}
    want = {}
    ok = (lat > 35.0) & (lat < 37.4) & (lon > -124.0) & (lon < -121.6)
    for i in range(60):
        for j in range(60):
            a, o = (i + 0.5) * 0.04 + 35.0, (j + 0.5) * 0.04 + -124.0
            n = int((ok & (lat >= a - 0.02) & (lat <= a + 0.02) & (lon >= o - 0.02) & (lon <= o + 0.02)).sum())
            if n:
                want[i, j] = n
    assert got == want


def test_empty_points_give_no_images(spark):
    p = spark.createDataFrame([], "t int, lat double, lon double, aod double")
    assert regrid.images(regrid.clean_points(p)).count() == 0


def knn_loop(a, k):
    """Rows are units: the plain double loop."""
    n, out = len(a), a.copy()
    for r in range(n):
        d = [(n + 1 if s == r else sum(np.isnan(a[r, c]) or np.isnan(a[s, c]) or a[r, c] != a[s, c] for c in range(n)), s) for s in range(n)]
        order = [s for _, s in sorted(d)]
        for c in range(n):
            if np.isnan(a[r, c]):
                votes = [a[s, c] for s in order if s != r and not np.isnan(a[s, c])][:k]
                if votes:
                    out[r, c] = max(dict.fromkeys(votes), key=votes.count)
    return out


@pytest.mark.parametrize("share", [0.1, 0.4, 0.9])
def test_knn_matches_loop(spark, share):
    rng = np.random.default_rng(int(share * 10))
    a = rng.integers(0, 4, (12, 12)).astype(float)
    a[rng.random((12, 12)) < share] = np.nan
    a[:, 5] = np.nan
    a[3] = np.nan
    got = to_matrix(impute.knn_impute(image(spark, a), ["t"], 3, 12, row="lat_i", col="lon_i"), "aod", 12)
    np.testing.assert_array_equal(got, knn_loop(a, 3))


def flow_loop(a, b, n, w):
    speed, angle = np.full((n, n), np.nan), np.full((n, n), np.nan)
    for r in range(1, n - 2):
        for c in range(1, n - 2):
            rs, re, cs, ce = max(r - w // 2, 0), min(r + w // 2, n - 1) - 2, max(c - w // 2, 0), min(c + w // 2, n - 1) - 2
            x = np.array([[1.0, a[i + 1, j] - a[i, j], a[i, j + 1] - a[i, j]] for i in range(rs, re + 1) for j in range(cs, ce + 1)])
            y = np.array([b[i, j] - a[i, j] for i in range(rs, re + 1) for j in range(cs, ce + 1)])
            if len(y) < 10:
                continue
            if np.isnan(x).any() or np.isnan(y).any():
                angle[r, c] = 0.0
                continue
            if np.ptp(x[:, 1]) < 1e-9 and np.ptp(x[:, 2]) < 1e-9:
                vr = vc = 0.0
            else:
                _, p, q = np.linalg.lstsq(x, y, rcond=None)[0]
                vr, vc = -p, -q
            speed[r, c], angle[r, c] = math.hypot(vr, vc), math.degrees(math.atan2(vr, vc)) % 360
    return speed, angle


def test_flow_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    n = 16
    a, b = rng.random((n, n)), rng.random((n, n))
    b[12, 13] = np.nan
    pairs = flow.pairs(image(spark, a).union(image(spark, b, 1)), [])
    got = flow.optical_flow(pairs, ["pair"], n, 7, row="lat_i", col="lon_i")
    speed, angle = flow_loop(a, b, n, 7)
    np.testing.assert_allclose(to_matrix(got, "speed", n), speed, atol=1e-9)
    np.testing.assert_allclose(to_matrix(got, "angle", n), angle, atol=1e-7)


def test_constant_image_has_zero_flow(spark):
    a = np.ones((12, 12))
    got = flow.optical_flow(flow.pairs(image(spark, a).union(image(spark, a * 2, 1)), []), ["pair"], 12, 7)
    inner = got.where("speed IS NOT NULL").collect()
    assert inner and all(r["speed"] == 0 and r["angle"] == 0 for r in inner)


def test_flow_angles(spark):
    v = [(1.0, 0.0, 90.0), (-1.0, 0.0, 270.0), (0.0, 0.0, 0.0), (1.0, 1.0, 45.0), (1.0, -1.0, 135.0), (-1.0, -1.0, 225.0), (-1.0, 1.0, 315.0), (0.0, 1.0, 0.0), (0.0, -1.0, 180.0), (None, None, 0.0)]
    df = spark.createDataFrame(v, "vr double, vc double, want double")
    for r in df.select("want", scalar.flow_angle(F.col("vr"), F.col("vc")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"])


def test_missing_pair_and_average(spark):
    a = np.arange(9.0).reshape(3, 3)
    assert flow.pairs(image(spark, a).union(image(spark, a, 2)), []).count() == 0
    rows = [(0, 0, 0, 1.0, 90.0), (1, 0, 0, 3.0, 180.0), (0, 0, 1, None, 0.0), (1, 0, 1, 1.0, 180.0)]
    df = spark.createDataFrame(rows, "pair int, lat_i int, lon_i int, speed double, angle double")
    got = {r["lon_i"]: (r["speed"], r["angle"]) for r in flow.average(df, 0, 1).collect()}
    assert got[0] == (2.0, pytest.approx(math.radians(135))) and got[1] == (None, None)
    alone = {r["lon_i"]: (r["speed"], r["angle"]) for r in flow.average(df, 0, 1, coupled=False).collect()}
    assert alone[1] == (None, pytest.approx(math.pi / 2))


def test_smooth_matches_direct_sum(spark):
    rng = np.random.default_rng(5)
    n, cfg = 14, Config(nr=14)
    a = rng.random((n, n))
    a[rng.random((n, n)) < 0.5] = np.nan
    a[:, :] = np.where(np.add.outer(np.arange(n), np.arange(n)) > 22, np.nan, a)
    i = np.arange(n)
    w = np.exp(-((i[:, None] - i) ** 2.0))
    ok = ~np.isnan(a)
    below = w @ ok @ w
    want = np.where(0.5 * below > 1e-8, (w @ np.where(ok, a, 0) @ w) / np.maximum(below, 1e-300), np.nan)
    np.testing.assert_allclose(to_matrix(smooth.kernel_smooth(image(spark, a), ["aod"], ["t"], cfg), "aod", n), want, atol=1e-10)
    assert smooth.kernel_smooth(image(spark, a * np.nan), ["aod"], ["t"], cfg).where("aod IS NOT NULL").count() == 0


def test_differences(spark):
    n, cfg = 5, Config(nr=5)
    rng = np.random.default_rng(6)
    vx, vy = rng.random((n, n)), rng.random((n, n))
    rows = [(i, j, float(vx[i, j]), float(vy[i, j])) for i in range(n) for j in range(n)]
    v = spark.createDataFrame(rows, "lat_i int, lon_i int, v_x double, v_y double")
    k = to_matrix(smooth.smagorinsky(v, cfg=cfg), "K", n)
    for i in range(n):
        for j in range(n):
            if i == n - 1 or j == n - 1:
                assert np.isnan(k[i, j])
            else:
                p1, p2, p3, p4 = vx[i + 1, j] - vx[i, j], vy[i, j + 1] - vy[i, j], vx[i, j + 1] - vx[i, j], vy[i + 1, j] - vy[i, j]
                assert k[i, j] == pytest.approx(0.28 / 25 * 5 * math.hypot(p1 - p2, p3 + p4))
    g = smooth.gradient(v.withColumnRenamed("v_x", "K"), nr=n)
    x, y = to_matrix(g, "dK_dx", n), to_matrix(g, "dK_dy", n)
    assert x[n - 1, 2] == x[n - 2, 2] == pytest.approx((vx[n - 1, 2] - vx[n - 2, 2]) * n)
    assert y[2, n - 1] == y[2, n - 2]


def test_frequency_sets():
    rows = spectral.omega_rows(20)
    assert sum(r[0] == 1 for r in rows) == 4 and sum(r[0] == 2 for r in rows) == 198
    assert [r[2:] for r in rows[:4]] == [(0, 0), (0, 10), (10, 0), (10, 10)]
    assert rows[4][2:] == (1, 10) and rows[-1][2:] == (9, 0)
    assert len({r[2:] for r in rows}) == 202


def test_lattice(spark):
    assert [r["idx"] for r in grid.lattice(spark, 60, 20).orderBy("idx").collect()] == list(range(2, 60, 3))
    assert sorted({int(60 / 25 * k) - 1 for k in range(1, 26)}) == [r["idx"] for r in grid.lattice(spark, 60, 25).orderBy("idx").collect()]


def plain_entry(rows, n, delta, i, j, sign):
    """One entry of the generator by its definition: a sum over the sites of a test function and an image."""
    omega = spectral.omega_rows(n)
    one, two = [r[2:] for r in omega if r[0] == 1], [r[2:] for r in omega if r[0] == 2]
    kinds = [("c1", k) for k in one] + [("c2", k) for k in two] + [("s2", k) for k in two]
    (ik, m), (jk, k) = kinds[i], kinds[j]
    total = 0.0
    for _, _, x, y, vx, vy, kk, kx, ky in rows:
        def parts(f):
            th = 2 * math.pi * (x * f[0] + y * f[1])
            lap, slope = -4 * math.pi**2 * (f[0] ** 2 + f[1] ** 2) * kk, 2 * math.pi * (kx * f[0] + ky * f[1])
            return math.cos(th), math.sin(th), 2 * math.pi * (vx * f[0] + vy * f[1]), lap * math.cos(th) - slope * math.sin(th), lap * math.sin(th) + sign * slope * math.cos(th)

        mc, ms, mv, _, mb = parts(m)
        kc, ks, kv, ka, kb = parts(k)
        if ik == jk == "s2":
            total += -mv * ms * kc + mb * ks
        else:
            total += (ms if ik == "s2" else mc) * (-kv * kc + kb if jk == "s2" else kv * ks + ka)
    return total * delta**2 * (1 if jk == "c1" else 2) * (2 if ik == "c1" and i > 0 else 1)


@pytest.mark.parametrize("strict", [True, False])
def test_generator_by_definition(spark, strict):
    rng = np.random.default_rng(7)
    nr, n = 6, 4
    rows = [(d, s + 1, (s % nr) / nr, (s // nr) / nr, *map(float, rng.normal(size=5))) for d in (1, 2) for s in range(nr * nr)]
    design = spark.createDataFrame(rows, "domain int, site int, x double, y double, vx double, vy double, K double, dKx double, dKy double").repartition(5)
    got = {(r["domain"], r["i"], r["j"]): r["v"] for r in spectral.generator_matrix(design, n, 1 / nr, strict_reference=strict).collect()}
    assert len(got) == 2 * n**4
    for d in (1, 2):
        for i, j in [(0, 0), (0, 7), (1, 3), (2, 12), (5, 1), (6, 6), (7, 15), (11, 0), (12, 5), (13, 13), (15, 11)]:
            assert got[d, i + 1, j + 1] == pytest.approx(plain_entry([r for r in rows if r[0] == d], n, 1 / nr, i, j, -1 if strict else 1), abs=1e-9)


def eliminated(n, x, z, xx, xz, zz):
    """Whether elimination with the largest pivot of each column meets one below 1e-12."""
    a = [[n, x, z], [x, xx, xz], [z, xz, zz]]
    for k in range(3):
        r = max(range(k, 3), key=lambda i: (abs(a[i][k]), -i))
        a[k], a[r] = a[r], a[k]
        if abs(a[k][k]) < 1e-12:
            return True
        for i in range(k + 1, 3):
            f = a[i][k] / a[k][k]
            a[i] = [p - f * q for p, q in zip(a[i], a[k], strict=True)]
    return False


def test_flat_windows_are_those_of_an_elimination(spark):
    rng, rows = np.random.default_rng(17), []
    for _ in range(400):
        size, scale = int(rng.integers(10, 200)), 10.0 ** rng.uniform(-9, 2)
        gx = scale * (rng.normal(size=size) + rng.choice([0, 5]))
        gz = rng.choice([0.0, 1.0]) * gx * rng.normal() + 10.0 ** rng.uniform(-10, 1) * rng.normal(size=size) * rng.choice([0.0, 1.0])
        rows.append((float(size), gx.sum(), gz.sum(), (gx * gx).sum(), (gx * gz).sum(), (gz * gz).sum()))
    rows += [(20.0, 0.0, 0.0, 0.0, 0.0, 0.0), (20.0, 2.0, 0.0, 0.2, 0.0, 0.0), (10.0, 100.0, 30.0, 1000.5, 300.2, 91.0), (10.0, 30.0, 100.0, 91.0, 300.2, 1000.5)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, n double, x double, z double, xx double, xz double, zz double")
    got = {r["i"]: r["flat"] for r in df.select("i", flow.flat_window(*[F.col(c) for c in ("n", "x", "z", "xx", "xz", "zz")]).alias("flat")).collect()}
    near = lambda r: any(eliminated(*[v * (1 + e) for v in r]) != eliminated(*r) for e in (1e-6, -1e-6, 1e-9))
    want = {i: eliminated(*r) for i, r in enumerate(rows)}
    # a determinant that rounding alone decides is no test of either
    clear = [i for i, r in enumerate(rows) if not near(r) and abs(r[3] * r[5] - r[4] ** 2) > 1e-9 * max(r[3] * r[5], 1e-300) or r[4] == 0]
    assert len(clear) > 150 and {i: got[i] for i in clear} == {i: want[i] for i in clear} and len({want[i] for i in clear}) == 2


@pytest.mark.parametrize("most", [1 << 16, 10])
def test_percentile_is_exact(spark, monkeypatch, most):
    monkeypatch.setattr(compare, "SORTED", most)
    rng = np.random.default_rng(18)
    for values in (rng.normal(size=3000), np.round(rng.normal(size=2000), 1), np.full(500, 2.5), np.array([1.0]), 10.0 ** rng.uniform(-8, 8, 1500), np.array([])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(4)
        for p in (0.0, 0.5, 0.98, 1.0):
            got = compare.percentile(df, F.col("x"), p).head()[0]
            assert got is None if not len(values) else got == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_a_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(0.1, float(i)) for i in range(7)], "a double, b double")
    assert df.agg(compare.pearson(F.col("a"), F.col("b"))).head()[0] is None
    small = spark.createDataFrame([(1.0 + i * 1e-13, float(i)) for i in range(7)], "a double, b double")
    assert small.agg(compare.pearson(F.col("a"), F.col("b"))).head()[0] == pytest.approx(1.0, abs=0.2)


def chain_obs(spark, steps=(1, 2, 4), chains=1):
    rng = np.random.default_rng(19)
    rows = [(c, s, t, site, float(rng.normal())) for c in range(chains) for t in steps for s in (0, 1) for site in (1, 2, 3)]
    return rows, spark.createDataFrame(rows, "chain int, sat int, t int, site int, y double")


BASIS = np.array([[1.0, 0.2], [0.3, 1.0], [-0.5, 0.7]])
G, W = np.array([[0.9, 0.1], [0.0, 0.8]]), 0.1 * np.eye(2)


def test_moments_of_the_filter(spark):
    rows, df = chain_obs(spark)
    got = {(r["kind"], r["time_step"], r["i"], r["j"]): r["value"] for r in statespace.kalman_moments(df, BASIS, G, W, {0: 0.3, 1: 0.6}, np.zeros(2), np.eye(2), 4).collect()}
    m, c = np.zeros(2), np.eye(2)
    for t in range(1, 6):
        m, c = G @ m, G @ c @ G.T + W
        assert [got["predicted", t, i + 1, 0] for i in (0, 1)] == pytest.approx(m) and [got["predicted", t, i + 1, j + 1] for i in (0, 1) for j in (0, 1)] == pytest.approx(c.ravel())
        now = sorted((s, site, y) for _, s, u, site, y in rows if u == t)
        for s, site, y in now:  # one observation after the other
            f, v = BASIS[site - 1], {0: 0.3, 1: 0.6}[s] + 1e-8
            gain = c @ f / (f @ c @ f + v)
            m, c = m + gain * (y - f @ m), c - np.outer(gain, f @ c)
        if t < 5:
            assert [got["filtered", t, i + 1, 0] for i in (0, 1)] == pytest.approx(m) and got["filtered", t, 1, 2] == pytest.approx(c[0, 1])
    stale = {(r["time_step"], r["i"], r["j"]): r["value"] for r in statespace.kalman_moments(df, BASIS, G, W, {0: 0.3, 1: 0.6}, np.zeros(2), np.eye(2), 4, strict_reference=True).where("kind = 'predicted'").collect()}
    assert stale[5, 1, 1] == pytest.approx(got["predicted", 5, 1, 1] - 0.1)


def test_backward_paths_have_the_smoothed_mean(spark):
    rows, df = chain_obs(spark, (1, 2, 3), 1)
    every = df.drop("chain").withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(599))))
    paths = statespace.backward_sample(every, BASIS, G, W, {0: 0.3, 1: 0.6}, np.zeros(2), np.eye(2), 3)
    assert sorted(map(tuple, paths.where("chain < 3").collect())) == sorted(map(tuple, statespace.backward_sample(every.where("chain < 3"), BASIS, G, W, {0: 0.3, 1: 0.6}, np.zeros(2), np.eye(2), 3).collect()))
    got = {(r["time_step"], r["coef_idx"]): r["m"] for r in paths.groupBy("time_step", "coef_idx").agg(F.avg("value").alias("m")).collect()}
    # all states at once: a Gaussian, conditioned on all observations
    p, blocks = [G @ G.T + W], []
    for _ in range(2):
        p.append(G @ p[-1] @ G.T + W)
    cov = np.block([[np.linalg.matrix_power(G, max(i - j, 0)) @ p[min(i, j)] @ np.linalg.matrix_power(G, max(j - i, 0)).T for j in range(3)] for i in range(3)])
    h = np.array([np.concatenate([BASIS[site - 1] * (k == t - 1) for k in range(3)]) for _, _, t, site, _ in rows])
    v = np.diag([0.3 if s == 0 else 0.6 for _, s, *_ in rows])
    mean = cov @ h.T @ np.linalg.solve(h @ cov @ h.T + v, [r[4] for r in rows])
    for t in range(3):
        for i in range(2):
            assert got[t + 1, i + 1] == pytest.approx(mean[2 * t + i], abs=0.08)


def test_residual_tables(spark):
    rows, df = chain_obs(spark, (1, 2))
    path = {(t, i): 0.1 * t + i for t in (1, 2) for i in (1, 2)}
    states = spark.createDataFrame([(t, i, float(v)) for (t, i), v in path.items()], "time_step int, coef_idx int, value double")
    basis = spark.createDataFrame([(s + 1, c + 1, float(BASIS[s, c])) for s in range(3) for c in range(2)], "site int, col int, v double")
    got = {r["sat"]: (r["n"], r["sum_sq"]) for r in spectral.residuals(df, basis, states).collect()}
    for s in (0, 1):
        own = [(y - sum(BASIS[site - 1][i - 1] * path[t, i] for i in (1, 2))) ** 2 for _, sat, t, site, y in rows if sat == s]
        assert got[s] == (len(own), pytest.approx(sum(own)))


def test_strict_recipe_reaches_the_sampler(spark):
    _, df = chain_obs(spark, (1, 2, 3))
    runs = [sorted(map(tuple, statespace.gibbs_ffbs(df, BASIS, G, np.zeros(2), np.eye(2), 3, 3, strict_reference=s).collect())) for s in (False, True, True)]
    assert runs[1] == runs[2] != runs[0]


def test_expm():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(20, 20))
    values, vectors = np.linalg.eig(a)
    np.testing.assert_allclose(dense.expm(a), (vectors @ np.diag(np.exp(values)) @ np.linalg.inv(vectors)).real, rtol=1e-8, atol=1e-9)
    np.testing.assert_allclose(dense.expm(a) @ dense.expm(-a), np.eye(20), atol=1e-7)
    np.testing.assert_allclose(dense.expm(np.zeros((3, 3))), np.eye(3), atol=1e-15)


def test_kalman_against_joint_posterior():
    rng = np.random.default_rng(9)
    g, w, f, v = np.array([[0.9, 0.1], [0.0, 0.8]]), 0.1 * np.eye(2), rng.normal(size=(3, 2)), np.full(3, 0.4)
    m0, c0, ys = np.zeros(2), np.eye(2), [rng.normal(size=3) for _ in range(3)]
    last = dense.kalman([f] * 3, ys, [v] * 3, g, w, m0, c0, jitter=0.0)[-1]
    # all states at once: x_t = g x_(t-1) + noise as one Gaussian, conditioned on all observations
    p = [c0]
    for _ in range(3):
        p.append(g @ p[-1] @ g.T + w)
    cov = np.block([[p[i + 1] @ np.linalg.matrix_power(g, j - i).T if j >= i else np.linalg.matrix_power(g, i - j) @ p[j + 1] for j in range(3)] for i in range(3)])
    h = np.kron(np.eye(3), f)
    gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + 0.4 * np.eye(9))
    np.testing.assert_allclose(last[2], (gain @ np.concatenate(ys))[-2:], atol=1e-10)
    np.testing.assert_allclose(last[3], (cov - gain @ h @ cov)[-2:, -2:], atol=1e-10)
    nothing = dense.filter_step(np.ones(2), c0, g, w, np.zeros((0, 2)), np.zeros(0), np.zeros(0))
    np.testing.assert_array_equal(nothing[2], g @ np.ones(2))


def test_sampler_moments():
    rng = np.random.default_rng(10)
    phi = np.diag([1.0, 2.0, 3.0, 4.0])
    np.testing.assert_allclose(np.mean([dense.wishart(rng, 12, phi) for _ in range(4000)], 0), 12 * phi, atol=1.5)
    np.testing.assert_allclose(np.mean([np.diag(dense.inverse_wishart(rng, 40, phi)) for _ in range(4000)], 0), np.diag(phi) / 35, rtol=0.05)
    strict = np.mean([np.diag(dense.inverse_wishart(rng, 40, phi, strict_reference=True)) for _ in range(4000)], 0)
    assert strict[0] > strict[3]
    assert np.mean([dense.inverse_gamma(rng, 5.0, 2.0) for _ in range(8000)]) == pytest.approx(0.5, rel=0.05)
    draws = np.array([dense.draw(rng, np.array([1.0, -1.0]), np.array([[2.0, 0.5], [0.5, 1.0]])) for _ in range(8000)])
    np.testing.assert_allclose(np.cov(draws.T), [[2.0, 0.5], [0.5, 1.0]], atol=0.12)


def test_gibbs_recovers_the_field(spark):
    rng = np.random.default_rng(11)
    f, truth = rng.normal(size=(30, 3)), np.array([1.0, -2.0, 0.5])
    rows = [(0, s, t, i + 1, float(f[i] @ truth + (0.4 if s else 0.0) + 0.1 * rng.normal())) for s in (0, 1) for t in range(1, 9) for i in range(30)]
    obs = spark.createDataFrame(rows, "chain int, sat int, t int, site int, y double")
    g = np.block([[np.eye(3), np.zeros((3, 3))], [np.zeros((3, 3)), np.eye(3)]])
    basis = np.hstack([f, np.zeros_like(f)])
    got = statespace.gibbs_ffbs(obs, basis, g, np.full(6, 0.1), 0.01 * np.eye(6), 8, samples=6)
    last = {r["coef_idx"]: r["value"] for r in got.where("pass = 'final' AND time_step = 8").collect()}
    assert [last[k] for k in (1, 2, 3)] == pytest.approx(list(truth), abs=0.5)
    again = {r["coef_idx"]: r["value"] for r in statespace.gibbs_ffbs(obs, basis, g, np.full(6, 0.1), 0.01 * np.eye(6), 8, samples=6).where("pass = 'final' AND time_step = 8").collect()}
    assert again == last


def test_comparison_edges(spark):
    p = spark.createDataFrame([(1, 1, 1.0, None), (1, 2, 2.0, 2.0), (1, 3, 2.0, 3.0), (2, 1, None, None)], "t int, site int, a double, b double")
    got = {r["t"]: r for r in compare.agreement(p).collect()}
    assert got[1]["n"] == 2 and got[1]["r"] is None and got[2]["n"] == 0 and got[2]["rmse"] is None and got[None]["n"] == 2
    m = compare.mismatch(p, 0.5).head()
    assert (m["cells"], m["missing_mismatch"], m["max_diff"], m["over"]) == (4, 1, 1.0, 1)
    flat = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [(r["bin"], r["n"]) for r in compare.histogram(flat, "x").collect()] == [(0, 2)]
    assert compare.rescale(flat, "x").collect()[0]["scaled"] == pytest.approx(0.05)


def test_geos_round_trip(spark):
    # the centre of the disk is the point below the satellite; far off it there is none
    df = spark.createDataFrame([(0.0, 0.0), (0.3, 0.0)], "x double, y double")
    lon, lat = scalar.geos_inverse(F.col("x"), F.col("y"), 35786023.0, -75.0)
    a, b = df.select(lon.alias("lon"), lat.alias("lat")).collect()
    assert (a["lon"], a["lat"]) == (pytest.approx(-75.0), pytest.approx(0.0)) and b["lon"] is None


def test_series_gaps(spark):
    s = spark.createDataFrame([(1, 1.0), (1, 2.0), (3, 1.0)], "time_index int, aod double")
    assert [(r["time_index"], r["n_rows"]) for r in regrid.series_gaps(s, 3, 2).orderBy("time_index").collect()] == [(2, 0), (3, 1)]


def test_constants():
    assert (DEFAULT.nr, DEFAULT.k, DEFAULT.window, DEFAULT.fourier, DEFAULT.lattice, DEFAULT.seed) == (60, 10, 15, 20, 20, 222)
