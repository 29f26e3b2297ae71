"""python -m skyfuse TABLES OUT [--first MANIFEST] [--second MANIFEST] [-k N] [--save]

The chain from points to the transition matrix. Points come from two manifests of packed clouds,
or, without them, from the tables' synthetic cloud. Writes the velocity, the diffusivity and the
matrix below OUT; with --save, the images and imputed images as well."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfuse.config import DEFAULT
from skyfuse.operators import flow, impute, regrid, smooth, statespace
from skyfuse.operators import grid as cells
from skyfuse.operators.compare import Stages
from skyfuse.plans import frames
from skyfuse.session import local_session, written
from skyfuse.sources import files, synth


def points_of(spark: SparkSession, tables: str, manifests: list[str]) -> DataFrame:
    """(sat, t, lat, lon, aod): of each manifest its clouds, or the synthetic cloud."""
    found = None
    for sat, path in enumerate(m for m in manifests if m):
        listed = files.read_manifest(spark, path)
        paths = [r["path"] for r in listed.select("path").collect()]  # a line a scene
        own = files.read_points(spark, paths, listed).select(F.lit(sat).alias("sat"), "t", "lat", "lon", "aod")
        found = own if found is None else found.union(own)
    return synth.points(spark, tables) if found is None else found


def run(spark: SparkSession, tables: str, out: str, manifests: list[str] = (), k: int = DEFAULT.k, save: bool = False) -> None:
    cfg, stages = replace(DEFAULT, k=k), Stages()
    with stages.time("images"):
        raw = written(regrid.images(regrid.clean_points(points_of(spark, tables, list(manifests)), cfg), ["t"], cfg))
        filled = written(impute.knn_impute(raw, ["t"], cfg.k, cfg.nr))
    with stages.time("velocity and diffusivity"):
        pairs = flow.pairs(filled, [])
        last = pairs.agg(F.max("pair")).head()[0] or 0
        flows = flow.average(flow.optical_flow(pairs, ["pair"], cfg.nr, cfg.window), 0, min(last, cfg.averaged_pairs))
        v = written(smooth.velocity(flows))
        g = written(smooth.gradient(smooth.kernel_smooth(smooth.smagorinsky(v), ["K"])))
    centres = cells.cells(spark, cfg).select("lat_i", "lon_i", "lat", "lon")
    files.write_velocity(v.join(centres, ["lat_i", "lon_i"]), f"{out}/v_a")
    files.write_diffusivity(g.join(centres, ["lat_i", "lon_i"]), f"{out}/K_ifm")
    with stages.time("transition matrix"):
        m = written(statespace.transition(frames.design_of(v, g, cfg), cfg.fourier, 1.0 / cfg.nr))
    files.write_matrix(cells.wide(m.withColumn("j", F.col("j") - 1), "i", "j", "v", cfg.fourier**2), "i", f"{out}/G")
    files.write_timings(stages.table(spark), f"{out}/timing")
    if save:
        raw.write.mode("overwrite").parquet(f"{out}/images")
        filled.write.mode("overwrite").parquet(f"{out}/imputed")


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="skyfuse", description=__doc__)
    a.add_argument("tables")
    a.add_argument("out")
    a.add_argument("--first", default="")
    a.add_argument("--second", default="")
    a.add_argument("-k", type=int, default=DEFAULT.k)
    a.add_argument("--save", action="store_true")
    x = a.parse_args(argv)
    run(SparkSession.getActiveSession() or local_session(), x.tables, x.out, [x.first, x.second], x.k, x.save)


if __name__ == "__main__":
    main()
