"""The engine's queries by name, each with the SQL that gives the same rows.

Computed doubles are rounded to six decimals on both sides: sums depend on the
order of their rows in the last bits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfuse.config import DEFAULT
from skyfuse.functions import scalar
from skyfuse.operators import compare, flow, impute, regrid, smooth, spectral, statespace
from skyfuse.operators import grid as cells
from skyfuse.plans import frames
from skyfuse.plans.frames import SMALL, SMALL_N
from skyfuse.plans.sql import SQL
from skyfuse.session import table
from skyfuse.sources import files, synth


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def regrid_mean(spark, d):
    return rounded(regrid.regrid(regrid.clean_points(synth.points(spark, d))), "aod")


def regrid_coverage(spark, d):
    return regrid.coverage(frames.images(spark, d), ["t"])


def domain_filter_clamp(spark, d):
    # values shifted so that some fall below 0
    p = synth.points(spark, d).withColumn("aod", F.col("aod") - 0.45)
    return regrid.clean_points(p).groupBy("sat", "t").agg(F.count("*").alias("n"), F.count(F.when(F.col("aod") == 0, 1)).alias("clamped"), r6(F.sum("aod")).alias("total"))


def merge_series(spark, d):
    g = frames.images(spark, d)
    merged = regrid.merge_series(g)
    return merged.groupBy("time_index").agg(F.count("*").alias("n_rows"), F.count("aod").alias("present"), r6(F.sum("aod")).alias("total"))


def series_gaps(spark, d):
    g = frames.images(spark, d).where("t <> 2").withColumn("time_index", F.col("t") + 1)
    return regrid.series_gaps(g, 6, DEFAULT.nr**2)


def _scenes(spark, d):
    e = table(spark, d, "events")
    name = F.format_string("img_%08d.nc", F.col("event_id"))
    return e.select((F.col("user_id") % 2).cast("int").alias("sat"), (F.col("event_id") % 5 + DEFAULT.first_hour).cast("int").alias("hour"), name.alias("path"))


def first_k_per_hour(spark, d):
    return files.first_of_hour(_scenes(spark, d), DEFAULT.images_per_hour)


def slot_index(spark, d):
    f = files.first_of_hour(_scenes(spark, d), DEFAULT.images_per_hour)
    return f.select("sat", "path", scalar.slot_index(F.col("hour"), F.col("j"), DEFAULT).alias("t"))


def new_files(spark, d):
    e = table(spark, d, "events").select(F.format_string("img_%08d.nc", F.col("event_id")).alias("path"), F.floor(F.col("value") * 1000).alias("length"))
    return files.copy_new(e, e).select("path")


def cell_bounds(spark, d):
    c = cells.cells(spark)
    (a, b), (x, y) = cells.bounds(F.col("lat_i"), DEFAULT.lat_min), cells.bounds(F.col("lon_i"), DEFAULT.lon_min)
    return c.select("site", "lat_i", "lon_i", *[r6(e).alias(n) for n, e in (("lat", F.col("lat")), ("lon", F.col("lon")), ("lat_lo", a), ("lat_hi", b), ("lon_lo", x), ("lon_hi", y))])


def transpose_pivot(spark, d):
    g = cells.transpose(frames.images(spark, d, cfg=SMALL).select("t", "lat_i", "lon_i", "aod"))
    return rounded(cells.wide(g, "lat_i", "lon_i", "aod", SMALL.nr, ["t"]), *[f"V{i + 1}" for i in range(SMALL.nr)])


def knn_distance(spark, d):
    return impute.row_distances(frames.images(spark, d), ["t"], "lon_i", "lat_i", DEFAULT.nr)


def knn_impute(spark, d):
    return rounded(frames.filled(spark, d), "aod")


def imputed_split(spark, d):
    raw, got = frames.images(spark, d), frames.filled(spark, d)
    keys = ["t", "lat_i", "lon_i"]
    other = got.withColumn("aod", F.col("aod") + F.when(F.col("lat_i") % 2 == 0, 0.25).otherwise(0.125))
    return rounded(compare.split_by_origin(compare.both(got, other, keys), raw, keys), "imputed", "untouched")


def flow_pairs(spark, d):
    return rounded(flow.pairs(frames.filled(spark, d), []), "a", "b")


def optical_flow(spark, d):
    return rounded(frames.flows(spark, d), "speed", "angle")


def flow_average(spark, d):
    return rounded(frames.mean_flow(spark, d), "speed", "angle")


def flow_average_independent(spark, d):
    return rounded(flow.average(frames.flows(spark, d), 0, 3, coupled=False), "speed", "angle")


def kernel_smooth(spark, d):
    g = frames.images(spark, d)
    return rounded(smooth.kernel_smooth(g, ["aod"], ["t"]), "aod")


def velocity_components(spark, d):
    return rounded(frames.velocity(spark, d), "speed", "angle", "v_x", "v_y")


def _scaled(df, *names):
    """Diffusivities are small: rounded after scaling."""
    return df.withColumns({n: r6(F.col(n) * 1e4) for n in names})


def smagorinsky_k(spark, d):
    return _scaled(frames.diffusivity(spark, d), "K")


def k_gradient(spark, d):
    return _scaled(frames.gradients(spark, d), "K", "dK_dx", "dK_dy")


def unit_conversion(spark, d):
    v, k = frames.velocity(spark, d), frames.diffusivity(spark, d)
    return v.join(k, ["lat_i", "lon_i"]).select("lat_i", "lon_i", r6(scalar.speed_kmh(F.col("speed"))).alias("km_h"), r6(scalar.diffusivity_km2h(F.col("K"))).alias("km2_h"))


def arrow_rescale(spark, d):
    v = frames.velocity(spark, d).where("lat_i % 3 = 0 AND lon_i % 3 = 0")
    return rounded(compare.rescale(v.select("lat_i", "lon_i", "speed"), "speed"), "speed", "scaled")


def polar_decode(spark, d):
    v = frames.velocity(spark, d)
    return v.select("lat_i", "lon_i", r6(F.sqrt(F.col("v_x") * F.col("v_x") + F.col("v_y") * F.col("v_y"))).alias("speed"), r6(F.atan2("v_y", "v_x")).alias("direction"))


def omega_set(spark, d):
    return spectral.omega(spark, DEFAULT.fourier)


def fourier_basis(spark, d):
    return rounded(frames.small_basis(spark), "v")


def dft_coefficients(spark, d):
    g = frames.images(spark, d, cfg=SMALL).select("t", F.col("lon_i").alias("i"), F.col("lat_i").alias("j"), F.coalesce("aod", F.lit(0.0)).alias("value"))
    return rounded(spectral.dft(g, spectral.omega(spark, 6).select("k1", "k2"), SMALL.nr, ["t"]), "re", "im")


def source_signal(spark, d):
    return rounded(spectral.sources_signal(spectral.sites(spark, SMALL.nr), [(0.2, 0.3), (0.7, 0.6), None, (0.5, 0.9)], 0.5, 0.4), "signal")


def generator_uniform(spark, d):
    return rounded(spectral.uniform_generator(spark, 6), "v")


def generator_matrix_small(spark, d):
    return rounded(spectral.generator_matrix(frames.simple_design(spark, d), SMALL_N, 1.0 / SMALL.nr), "v")


def max_row_sum(spark, d):
    g = spectral.generator_matrix(frames.simple_design(spark, d), SMALL_N, 1.0 / SMALL.nr)
    return rounded(spectral.max_row_sum(g, ["domain"]), "norm")


def generator_matrix(spark, d):
    """All 400 x 400 entries, over the 3,600 sites of the mean image of all steps."""
    g = frames.images(spark, d).groupBy("lat_i", "lon_i").agg(F.coalesce(F.avg("aod"), F.lit(0.0)).alias("a"))
    n, a = DEFAULT.nr, F.col("a")
    design = g.select(
        F.lit(0).alias("domain"), (F.col("lon_i") / float(n)).alias("x"), (F.col("lat_i") / float(n)).alias("y"),
        (a * 0.01).alias("vx"), (a * 0.02 - 0.01).alias("vy"), (a * 0.001).alias("K"), (a * 0.002).alias("dKx"), (a * -0.001).alias("dKy"),
    )
    return rounded(spectral.generator_matrix(design, DEFAULT.fourier, 1.0 / n).select("i", "j", "v"), "v")


def uds_lattice(spark, d):
    return cells.lattice(spark, DEFAULT.nr, DEFAULT.lattice)


def _observations(spark, d, steps: int = 5):
    g = cells.down_sample(frames.images(spark, d, ("sat", "t"), steps=steps), "aod", DEFAULT.nr, DEFAULT.lattice)
    return cells.observed(g, "aod", DEFAULT.nr)


def obs_assembly(spark, d):
    return rounded(_observations(spark, d).select("sat", "t", "site", F.col("aod").alias("y")), "y")


def obs_rows(spark, d):
    """Observation rows of the basis: a gather by site."""
    own = frames.small_obs(spark, d).select("sat", "t", "site", "y")
    return frames.small_basis(spark).join(own, "site").groupBy("sat", "t", "col").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v") * F.col("y")), 9).alias("fy"))


def obs_summary(spark, d):
    n = _observations(spark, d).groupBy("t").pivot("sat", [0, 1]).count()
    return n.select("t", F.coalesce(F.col("0"), F.lit(0)).alias("n1"), F.coalesce(F.col("1"), F.lit(0)).alias("n2"), F.greatest(F.coalesce(F.col("0"), F.lit(0)), F.coalesce(F.col("1"), F.lit(0))).alias("most"))


def state_reconstruction(spark, d):
    size = SMALL_N**2
    return rounded(spectral.reconstruct(frames.small_basis(spark), synth.state(spark, 5, 2 * size), size), "field", "bias")


def kstep_forecast_small(spark, d):
    size = SMALL_N**2
    last = synth.state(spark, 5, 2 * size).where("time_step = 5").select("coef_idx", "value")
    # products of short decimals end in a 5 too often for six places
    return spectral.forecast(frames.small_basis(spark), frames.small_transition(spark, size), last, 5, size).withColumn("field", F.round("field", 9) + 0.0)


def forecast_error(spark, d):
    """k-step forecasts against what was observed k steps on."""
    f = kstep_forecast_small(spark, d).withColumnRenamed("field", "a")
    o = frames.small_obs(spark, d).where("sat = 0").select((F.col("t")).alias("k"), "site", F.col("y").alias("b"))
    return rounded(compare.rmse_by_step(f.join(o, ["k", "site"]), ["k"]), "rmse", "mae", "max_diff", "bias")


def prediction_pool(spark, d):
    size = SMALL_N**2
    g, f = frames.small_transition(spark, size), frames.small_basis(spark)
    s = synth.state(spark, 5, 2 * size)
    a, b = (spectral.forecast(f, g, s.where(F.col("time_step") == t).select("coef_idx", "value"), 5, size) for t in (5, 4))
    return compare.prediction_pool(a, b).withColumn("diff", F.round("diff", 9) + 0.0)


def matrix_power(spark, d):
    g = frames.small_transition(spark, SMALL_N**2)
    return rounded(spectral.matmul(spectral.matmul(g, g), g), "v")


def augmented_transition(spark, d):
    return spectral.augmented(frames.small_transition(spark, SMALL_N**2), SMALL_N**2)


def _two(spark, d):
    g = frames.images(spark, d, ("sat", "t"))
    a, b = (g.where(F.col("sat") == s).drop("sat") for s in (0, 1))
    return compare.both(a, b, ["t", "lat_i", "lon_i"])


def compare_per_step(spark, d):
    got = compare.agreement(_two(spark, d))
    return rounded(got.withColumn("verdict", compare.verdict(F.col("r"))), "r", "rmse", "mae", "mean_a", "mean_b", "missing_a", "missing_b")


def nan_mismatch(spark, d):
    return rounded(compare.mismatch(_two(spark, d), 0.5, ["t"]), "max_diff", "mean_diff")


def worst_cells(spark, d):
    p = rounded(_two(spark, d), "a", "b")
    return rounded(compare.worst(p.withColumn("a", r6("a")), ["t", "lat_i", "lon_i"], 5), "diff")


def histogram_density(spark, d):
    return rounded(compare.histogram(frames.images(spark, d), "aod", 100), "density")


def percentile_98(spark, d):
    return rounded(compare.percentile(frames.images(spark, d), F.abs("aod"), 0.98, "p98"), "p98")


def _states(spark):
    a = synth.state(spark, 5, 32)
    return a, a.withColumn("value", F.col("value") * 0.9 + ((F.col("coef_idx") * 7 + F.col("time_step")) % 13) / F.lit(50.0))


def coef_corr(spark, d):
    return rounded(compare.coefficient_agreement(*_states(spark)), "corr", "size_ratio")


def filter_rmse(spark, d):
    a, b = _states(spark)
    return rounded(compare.rmse_by_step(compare.both(a, b, ["time_step", "coef_idx"], "value"), ["time_step"]), "rmse", "mae", "max_diff", "bias")


def count_equality(spark, d):
    n = _observations(spark, d).groupBy("sat", "t").agg(F.count("*").alias("n"))
    a, b = (n.where(F.col("sat") == s).select("t", "n") for s in (0, 1))
    return compare.same_counts(a, b, "t", "n")


def row_gates(spark, d):
    g = frames.images(spark, d)
    return compare.gate(g, "grid", 5 * DEFAULT.nr**2).union(compare.gate(g.where("aod IS NOT NULL"), "present", 10))


def geos_inverse(spark, d):
    axis = spark.range(25)
    x = axis.select(F.col("id").cast("int").alias("i"), ((F.col("id") - 12) * 0.0132).alias("sx"))
    y = axis.select(F.col("id").cast("int").alias("j"), ((F.col("id") - 12) * 0.0132).alias("sy"))
    lon, lat = scalar.geos_inverse(F.col("sx"), F.col("sy"), 35786023.0, -137.0)
    lon_y, lat_y = scalar.geos_inverse(F.col("sx"), F.col("sy"), 35786023.0, -75.0, "y")
    # the mesh of two fixed axes
    return x.join(F.broadcast(y)).select("i", "j", *[r6(c).alias(n) for n, c in (("lon", lon), ("lat", lat), ("lon_y", lon_y), ("lat_y", lat_y))])


def ivw_fusion(spark, d):
    return rounded(statespace.fuse(frames.small_obs(spark, d), 0.36, 3.6), "y")


def kalman_scalar(spark, d):
    obs = frames.small_obs(spark, d).groupBy(F.col("sat").alias("chain"), "t").agg(r6(F.avg("y")).alias("y"))
    obs = obs.select("chain", F.lit(0).alias("sat"), "t", F.lit(1).alias("site"), "y")
    one = np.array([[1.0]])
    got = statespace.kalman_filter(obs, one, np.array([[0.9]]), np.array([[0.1]]), {0: 0.5}, np.array([DEFAULT.m0]), np.array([[DEFAULT.c0]]), 5)
    return rounded(got, "value")


def kalman_two_state(spark, d):
    """Predicted and filtered moments of a drifting level seen by one source, up to one step beyond the last."""
    obs = frames.small_obs(spark, d).groupBy(F.col("sat").alias("chain"), "t").agg(r6(F.avg("y")).alias("y"))
    obs = obs.select("chain", F.lit(0).alias("sat"), "t", F.lit(1).alias("site"), "y")
    g, w = np.array([[1.0, 1.0], [0.0, 0.8]]), np.diag([0.05, 0.02])
    got = statespace.kalman_moments(obs, np.array([[1.0, 0.5]]), g, w, {0: 0.5}, np.array([0.1, 0.0]), 0.01 * np.eye(2), 5)
    return rounded(got, "value")


def obs_stack(spark, d):
    """Rows of the two sources' observations below each other, and what the design has in them."""
    obs = frames.small_obs(spark, d).select("sat", "t", "site", "y")
    rows, design = spectral.stack(obs, frames.small_basis(spark), {0: 0.05, 1: 0.08})
    per = design.groupBy("t", "row").agg(F.count("*").alias("entries"), F.round(F.sum("v"), 9).alias("sum_v"))
    return rounded(rows.join(per, ["t", "row"]), "y", "variance")


def residual_sums(spark, d):
    obs = frames.small_obs(spark, d).select("sat", "t", "site", "y")
    path = synth.state(spark, 5, 2 * SMALL_N**2).where(F.col("coef_idx") <= SMALL_N**2)
    return rounded(spectral.residuals(obs, frames.small_basis(spark), path), "sum_sq")


def state_residuals(spark, d):
    size = SMALL_N**2
    g = spectral.augmented(frames.small_transition(spark, size), size)
    return spectral.state_residuals(synth.state(spark, 5, 2 * size), g).withColumn("value", F.round("value", 9) + 0.0)


def matrix_helpers(spark, d):
    """2 * (T + 0.5 I) - 0.3 * T**2."""
    size = SMALL_N**2
    g = frames.small_transition(spark, size)
    return rounded(spectral.axpby(1.0, spectral.scaled(spectral.add_diagonal(g, size, 0.5), 2.0), -0.3, spectral.matmul(g, g)), "v")


def clip_field(spark, d):
    g = frames.images(spark, d, cfg=SMALL).withColumn("aod", F.col("aod") - 0.45)
    return rounded(spectral.clip(g, "aod").select("t", "lat_i", "lon_i", "aod"), "aod")


def coordinate_rounding(spark, d):
    """Coordinates as their files hold them: two decimals."""
    e = table(spark, d, "events").select("event_id", (F.col("value") / 7.0).alias("lat"), (F.col("value") / -3.0).alias("lon"))
    return files.two_decimals(e, "lat", "lon")


def scene_listing(spark, d):
    """Scenes of one product, source and range of hours, from object names."""
    e = table(spark, d, "events")
    hour = (F.col("event_id") % 24).cast("int")
    key = F.format_string("product-%d/2024/%03d/%02d/OR_product-%d_s%d.%s", F.col("user_id") % 3, F.col("user_id") % 5 + 1, hour, F.col("user_id") % 3, F.col("event_id"), F.when(F.col("event_id") % 7 == 0, "tmp").otherwise("nc"))
    return files.list_scenes(e.select(key.alias("path"), F.col("value").cast("long").alias("length")), "product-1", 2024, 2, range(18, 23))


def matrix_expm(spark, d):
    g = spectral.generator_matrix(frames.simple_design(spark, d), SMALL_N, 1.0 / SMALL.nr)
    return rounded(statespace.expm(g, SMALL_N**2, "domain"), "v")


def transition_matrix(spark, d):
    """The whole chain from points to the 400 x 400 transition matrix."""
    return statespace.transition(frames.design(spark, d), DEFAULT.fourier, 1.0 / DEFAULT.nr)


def gibbs_full(spark, d, samples: int = DEFAULT.gibbs_samples, steps: int = DEFAULT.steps):
    """The two-source model at full size: 800 states, 20 steps, the lattice's observations."""
    p = DEFAULT.fourier**2
    f = frames.basis_matrix(DEFAULT.nr, DEFAULT.fourier)
    big = np.block([[np.eye(p), np.eye(p)], [np.zeros((p, p)), np.eye(p)]])
    obs = _observations(spark, d, steps).select(F.lit(0).alias("chain"), "sat", (F.col("t") + 1).alias("t"), (F.col("site") + 1).alias("site"), F.col("aod").alias("y"))
    return statespace.gibbs_ffbs(obs, np.hstack([f, np.zeros_like(f)]), big, np.full(2 * p, DEFAULT.m0), DEFAULT.c0 * np.eye(2 * p), steps, samples, DEFAULT.seed)


def _model():
    f = frames.small_basis_matrix()
    p = f.shape[1]
    g = np.diag(np.full(p, 0.9)) + np.diag(np.full(p - 1, 0.05), -1)
    big = np.block([[g, np.eye(p)], [np.zeros((p, p)), np.eye(p)]])
    return np.hstack([f, np.zeros_like(f)]), big, np.full(2 * p, DEFAULT.m0), DEFAULT.c0 * np.eye(2 * p)


def kalman_filter(spark, d):
    f, g, m0, c0 = _model()
    return rounded(statespace.kalman_filter(frames.small_obs(spark, d), f, g, 0.01 * np.eye(len(m0)), {0: 0.05, 1: 0.05}, m0, c0, 5), "value")


def gibbs_ffbs(spark, d):
    f, g, m0, c0 = _model()
    return statespace.gibbs_ffbs(frames.small_obs(spark, d), f, g, m0, c0, 5, DEFAULT.gibbs_samples, DEFAULT.seed)


def gibbs_one_source(spark, d):
    f, g, m0, c0 = _model()
    return statespace.gibbs_ffbs(frames.small_obs(spark, d).where("sat = 0"), f, g, m0, c0, 5, DEFAULT.gibbs_samples, DEFAULT.seed, sats=(0,))


def gibbs_lowrank(spark, d):
    f = frames.small_basis_matrix()
    g = frames.images(spark, d, cfg=SMALL)
    obs = g.select(F.lit(0).alias("chain"), (F.col("t") + 1).alias("t"), (F.col("lat_i") * SMALL.nr + F.col("lon_i") + 1).alias("site"), F.coalesce("aod", F.lit(0.0)).alias("y"))
    return statespace.gibbs_low_rank(obs, f, np.full(f.shape[1], DEFAULT.m0), DEFAULT.c0 * np.eye(f.shape[1]), 5)


def fusion_mse_study(spark, d):
    """With a biased first source, and without bias."""
    f = frames.small_basis_matrix()
    generator, coef, out = -0.5 * np.eye(f.shape[1]), np.linspace(0.1, 0.4, f.shape[1]), None
    for biased in (True, False):
        s = spark.createDataFrame(statespace.noise_settings(biased), "scenario int, sigma1 double, sigma2 double")
        one = statespace.fusion_study(s, f, coef, generator, 0.3 if biased else 0.0).withColumn("biased", F.lit(biased))
        out = one if out is None else out.union(one)
    return out


_QUERIES = (
    regrid_mean, regrid_coverage, domain_filter_clamp, merge_series, series_gaps, first_k_per_hour, slot_index, new_files, cell_bounds, transpose_pivot, knn_distance, knn_impute, imputed_split,
    flow_pairs, optical_flow, flow_average, flow_average_independent, kernel_smooth, velocity_components, smagorinsky_k, k_gradient, unit_conversion, arrow_rescale, polar_decode,
    omega_set, fourier_basis, dft_coefficients, source_signal, generator_uniform, generator_matrix_small, max_row_sum, uds_lattice, obs_assembly, obs_rows, obs_summary,
    state_reconstruction, kstep_forecast_small, forecast_error, prediction_pool, matrix_power, augmented_transition, compare_per_step, nan_mismatch, worst_cells, histogram_density, percentile_98,
    coef_corr, filter_rmse, count_equality, row_gates, geos_inverse, ivw_fusion, kalman_scalar, kalman_two_state, obs_stack, residual_sums, state_residuals, matrix_helpers, clip_field, coordinate_rounding, scene_listing, generator_matrix, matrix_expm, transition_matrix, kalman_filter, gibbs_ffbs, gibbs_one_source, gibbs_lowrank, fusion_mse_study,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
