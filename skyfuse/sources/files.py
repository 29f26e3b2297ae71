"""Readers and writers of the formats around the engine. A missing value is NULL
inside; NaN, NA and empty fields exist in files only."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from skyfuse.session import ship

MISSING = ("NaN", "NA", "nan", "")
POINT = "lat double, lon double, aod double"


def _number(c):
    text = F.trim(F.regexp_replace(c, '"', ""))
    return F.when(~text.isin(*MISSING), text.try_cast("double"))


def _clean(value):
    return F.when(~F.isnan(value), value)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(t, path) of a manifest: a number and a path a line, parted by white space; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    part = F.split(F.trim("value"), r"\s+", 2)
    return lines.select(part[0].cast("int").alias("t"), part[1].alias("path"))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("t").sortWithinPartitions("t").select(F.concat_ws("\t", F.col("t").cast("string"), "path").alias("value")).write.mode("overwrite").text(path)


def read_matrix(spark: SparkSession, path: str, columns: int, header: bool = True) -> DataFrame:
    """(i, j, v) of a CSV matrix, from 1; short rows and unreadable fields are NULL.
    Rows are numbered by their place in the file."""
    ship(spark)

    def number(batches):
        for batch in batches:
            for text in batch["content"]:
                lines = [x for x in bytes(text).decode().replace("\r", "").split("\n") if x][int(header) :]
                yield pd.DataFrame({"i": np.arange(1, len(lines) + 1, dtype=np.int32), "line": lines})

    # a matrix file is one task's: its size is fixed by the grid
    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(number, "i int, line string")
    fields = lines.select("i", F.posexplode(F.split("line", ",")).alias("j", "x")).where(F.col("j") < columns)
    seen = fields.select("i", (F.col("j") + 1).alias("j"), _clean(_number(F.col("x"))).alias("v"))
    every = lines.select("i", F.explode(F.sequence(F.lit(1), F.lit(columns))).alias("j"))
    return every.join(seen, ["i", "j"], "left")


def read_column(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The first column of a CSV file as numbers."""
    rows = spark.read.option("header", str(header).lower()).csv(path)
    if not rows.columns:
        raise ValueError(f"{path} has no column")
    return rows.select(_clean(_number(F.col(f"`{rows.columns[0]}`"))).alias("value"))


def read_long(spark: SparkSession, path: str, names: dict[str, str], time_index: int | None = None) -> DataFrame:
    """A long CSV file with a header; names: column -> type. NaN spellings are NULL,
    rows of other steps are left out where time_index is given."""
    raw = spark.read.option("header", "true").csv(path)
    out = raw.select(*[(_clean(_number(F.col(c))) if kind == "double" else F.col(c).try_cast(kind)).alias(c) for c, kind in names.items()])
    return out if time_index is None else out.where(F.col("time_index") == time_index)


def read_coords(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(y, x, value) of a white-space matrix of coordinates."""
    ship(spark)

    def rows(batches):
        for batch in batches:
            for text in batch["content"]:
                for y, line in enumerate(bytes(text).decode().splitlines()):
                    v = pd.to_numeric(pd.Series(line.split()), errors="coerce")
                    yield pd.DataFrame({"y": y, "x": np.arange(len(v)), value: v.to_numpy(float)})

    got = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, f"y int, x int, {value} double")
    return got.withColumn(value, _clean(F.col(value)))


def decode_points(data: bytes) -> pd.DataFrame:
    """A packed cloud: a 32-bit count, then latitudes, longitudes and values as
    doubles, little-endian. A count of 0 or less, or too few bytes: no points."""
    n = struct.unpack_from("<i", data)[0] if len(data) >= 4 else 0
    if n <= 0 or len(data) < 4 + 24 * n:
        return pd.DataFrame({"lat": [], "lon": [], "aod": []}, dtype=float)
    lat, lon, aod = np.frombuffer(data, "<f8", 3 * n, 4).reshape(3, n)
    return pd.DataFrame({"lat": lat, "lon": lon, "aod": aod})


def encode_points(lat, lon, aod) -> bytes:
    return struct.pack("<i", len(lat)) + b"".join(np.asarray(c, "<f8").tobytes() for c in (lat, lon, aod))


def read_points(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """(t, path, lat, lon, aod) of packed clouds; t from the manifest, else NULL."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                yield decode_points(bytes(data)).assign(path=file)[["path", "lat", "lon", "aod"]]

    got = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {POINT}")
    name = F.element_at(F.split("path", "/"), -1)
    if manifest is None:
        return got.select(F.lit(None).cast("int").alias("t"), "path", "lat", "lon", "aod")
    listed = manifest.select("t", F.element_at(F.split("path", "/"), -1).alias("file"))
    return got.withColumn("file", name).join(listed, "file").select("t", "path", "lat", "lon", "aod")


class PointCloudSource(DataSource):
    """spark.read.format("pointcloud").option("paths", "a.bin,b.bin").load(); writing
    makes one packed file for each partition under the path given. The paths must
    be reachable from every executor; in a store, use read_points."""

    @classmethod
    def name(cls):
        return "pointcloud"

    def schema(self):
        return f"path string, {POINT}"

    def reader(self, schema):
        return _PointReader([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p])

    def writer(self, schema, overwrite):
        return _PointWriter(self.options["path"], schema.names)


class _PointReader(DataSourceReader):
    def __init__(self, paths):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        import pyarrow as pa

        with open(partition.value, "rb") as f:
            points = decode_points(f.read())
        yield pa.RecordBatch.from_pandas(points.assign(path=partition.value)[["path", "lat", "lon", "aod"]], preserve_index=False)


class _PointWriter(DataSourceWriter):
    def __init__(self, path, names):
        self.path, self.names = path, names

    def write(self, rows):
        import os
        import uuid

        at = [self.names.index(c) for c in ("lat", "lon", "aod")]
        got = [[r[i] for i in at] for r in rows]
        if got:
            os.makedirs(self.path, exist_ok=True)
            target = os.path.join(self.path, f"{uuid.uuid4().hex}.bin")
            with open(target + ".part", "wb") as f:
                f.write(encode_points(*zip(*got, strict=True)))
            os.replace(target + ".part", target)
        return WriterCommitMessage()


def write_images(points: DataFrame, path: str) -> None:
    """Points as Parquet, a folder for each source and step."""
    points.repartition("sat", "t").write.mode("overwrite").partitionBy("sat", "t").parquet(path)


def write_grid(grid: DataFrame, path: str, header: bool = True) -> None:
    """long, lat, AOD as CSV in cell order (longitude fastest), missing values as NaN."""
    out = grid.orderBy("lat_i", "lon_i").select(F.format_string("%.8f", "lon").alias("long"), F.format_string("%.8f", "lat").alias("lat"), F.coalesce(F.col("aod").cast("string"), F.lit("NaN")).alias("AOD"))
    out.coalesce(1).write.mode("overwrite").option("header", str(header).lower()).csv(path)


def write_matrix(wide: DataFrame, row: str, path: str, missing: str = "NaN") -> None:
    """A matrix with columns V1..Vn as CSV, in row order, full precision."""
    names = [c for c in wide.columns if c != row]
    out = wide.orderBy(row).select(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in names])
    out.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_long(df: DataFrame, path: str, order: list[str], missing: str = "NA", hidden: tuple = ()) -> None:
    """A long table as CSV in the given order, in files by ranges of it; names in hidden only order."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*hidden)
    out.write.mode("overwrite").option("header", "true").option("nullValue", missing).csv(path)


def two_decimals(df: DataFrame, *names: str) -> DataFrame:
    """Columns as a file of coordinates holds them."""
    return df.withColumns({c: F.round(F.col(c), 2) + 0.0 for c in names})


def write_coords(coords: DataFrame, value: str, path: str) -> None:
    """(y, x, value) as a white-space matrix of two decimals, a line for each y; missing values as nan.
    A line is one row; lines go to as many files as there are partitions, in order."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", value))), lambda r: F.when(r[value].isNull(), "nan").otherwise(F.format_string("%.2f", r[value]))), " ")
    lines = coords.groupBy("y").agg(line.alias("value"))
    lines.repartitionByRange("y").sortWithinPartitions("y").select("value").write.mode("overwrite").text(path)


def _digits(c, n: int = 6):
    """A number with n significant digits, as streams print by default; missing: nan."""
    return F.when(c.isNull(), F.lit("nan")).otherwise(F.trim(F.regexp_replace(F.format_string(f"%.{n - 1}e", c), r"e([+-])(\d+)$", "e$1$2")))


def write_short(wide: DataFrame, row: str, path: str, header: bool = True, digits: int = 6) -> None:
    """A matrix or vector as CSV with so many significant digits, in row order, in files by ranges of rows."""
    names = [c for c in wide.columns if c != row]
    out = wide.repartitionByRange(row).sortWithinPartitions(row).select(*[_digits(F.col(c).cast("double"), digits).alias(c) for c in names])
    out.write.mode("overwrite").option("header", str(header).lower()).csv(path)


def write_velocity(field: DataFrame, path: str) -> None:
    """long, lat, v_x, v_y in cell order."""
    write_long(field.select("lat_i", "lon_i", F.col("lon").alias("long"), "lat", "v_x", "v_y"), path, ["lat_i", "lon_i"], "NaN", hidden=("lat_i", "lon_i"))


def write_diffusivity(field: DataFrame, path: str) -> None:
    """long, lat, K, dK_dx, dK_dy in cell order."""
    write_long(field.select("lat_i", "lon_i", F.col("lon").alias("long"), "lat", "K", "dK_dx", "dK_dy"), path, ["lat_i", "lon_i"], "NaN", hidden=("lat_i", "lon_i"))


def write_states(states: DataFrame, path: str) -> None:
    """time_step, coef_idx, value in that order."""
    write_long(states.select("time_step", "coef_idx", "value"), path, ["time_step", "coef_idx"])


def write_counts(counts: DataFrame, path: str) -> None:
    """t, n1, n2: observations of either source at each step."""
    write_long(counts.select("t", "n1", "n2"), path, ["t"])


def write_timings(stages: DataFrame, path: str) -> None:
    """section, unit, value."""
    stages.select("section", "unit", "value").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_errors(summary: DataFrame, path: str) -> None:
    """A row per step of mean errors with eight decimals; missing ones as NA."""
    numbers = [c for c in summary.columns if c != "time_step"]
    out = summary.select("time_step", *[F.when(F.col(c).isNotNull(), F.format_string("%.8f", F.col(c))).alias(c) for c in numbers])
    write_long(out, path, ["time_step"])


def read_flat(spark: SparkSession, path: str, cells: int) -> DataFrame:
    """(step from 1, site from 1, value) of a file without names that holds images of so many cells
    one after the other, a number or a line of numbers a line; what is no number is left out."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for text in batch["content"]:
                v = pd.to_numeric(pd.Series(bytes(text).decode().replace("\n", ",").split(",")).str.strip(), errors="coerce").dropna().to_numpy(float)
                at = np.arange(len(v))
                yield pd.DataFrame({"step": at // cells + 1, "site": at % cells + 1, "value": v})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "step int, site int, value double")


def list_scenes(objects: DataFrame, product: str, year: int, day: int, hours) -> DataFrame:
    """(path, length, hour) of a listing (path, length) that are scenes of a product, on a day of a year, in
    some hours, under product/year/day/hour/. Any file listing of Spark's makes such a table."""
    part = F.split("path", "/")
    hour = part[3].try_cast("int")
    own = (F.size(part) == 5) & (part[0] == product) & (part[1].try_cast("int") == year) & (part[2].try_cast("int") == day)
    return objects.where(own & hour.isin(list(hours)) & F.col("path").endswith(".nc")).select("path", "length", hour.alias("hour"))


def list_objects(spark: SparkSession, path: str, pattern: str = "*.nc") -> DataFrame:
    """(path, length) of the files below a path, in any store that Spark reads; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")


def copy_files(spark: SparkSession, source: str, rows: DataFrame, target: str, least_bytes: int = 100_000) -> dict[str, int]:
    """Copy the files that rows (path, below source) name to the same names below target, and say how many were
    copied, were there, or failed. Whole files are not copied again, so it can be repeated. The driver does it,
    one file after the other, by the file systems that Spark knows: a hundred files or so a run."""
    there = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    counts = {"copied": 0, "present": 0, "failed": 0}
    for r in rows.select("path").distinct().toLocalIterator():  # names, one partition at a time; contents go from store to store
        origin, goal = spark._jvm.org.apache.hadoop.fs.Path(f"{source}/{r['path']}"), spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{r['path']}")
        try:
            if system.exists(goal) and system.getFileStatus(goal).getLen() > least_bytes:
                counts["present"] += 1
                continue
            part = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{r['path']}.part")
            home = origin.getFileSystem(spark._jsc.hadoopConfiguration())
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(home, origin, system, part, False, True, spark._jsc.hadoopConfiguration())
            system.delete(goal, False)
            system.rename(part, goal)
            counts["copied"] += 1
        except Exception:  # noqa: BLE001 a bad file is counted, the others go on
            counts["failed"] += 1
    return counts


def copy_new(listing: DataFrame, present: DataFrame, least_bytes: int = 100_000) -> DataFrame:
    """Files of a listing (path, length) that are not yet there, or too short to be whole."""
    whole = present.where(F.col("length") > least_bytes).select("path")
    return listing.where(F.col("path").endswith(".nc")).join(whole, "path", "left_anti")


def first_of_hour(files: DataFrame, most: int = 12) -> DataFrame:
    """(sat, hour, j, path): the first files of each hour by name, hidden ones left out; j from 0."""
    from pyspark.sql.window import Window

    name = F.element_at(F.split("path", "/"), -1)
    j = F.row_number().over(Window.partitionBy("sat", "hour").orderBy("path")) - 1
    return files.where(~name.startswith(".")).withColumn("j", j).where(F.col("j") < most)


def align(scene: DataFrame, rows: int, columns: int, height: int, width: int) -> DataFrame | None:
    """A scene (y, x, aod) of height x width, with axes swapped if that fits the
    coordinates' rows x columns, as it is if it fits, or None."""
    if (height, width) == (rows, columns):
        return scene
    if (width, height) == (rows, columns):
        return scene.select(F.col("x").alias("y"), F.col("y").alias("x"), "aod")
    return None
