"""Scenes in the classic NetCDF format, read by Spark's own listing.

A file is one task's. Values are unpacked (scale, offset), fill values and values out of the
valid range become NULL; a file that cannot be read, or lacks the variable, is left out and named
with its error by `bad_scenes`. Files in the later format, which is HDF5, need the h5py library
where the tasks run; without it they count as unreadable."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfuse.session import ship

# fixed values: type codes of the format
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
FILL = {"i1": -127, ">i2": -32767, ">i4": -2147483647, ">f4": 9.969209968386869e36, ">f8": 9.969209968386869e36}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not in the classic format")
        self.wide, self.long = data[3] >= 2, data[3] == 5

    def number(self, wide: bool = False) -> int:
        size = 8 if wide else 4
        value = struct.unpack_from(">q" if wide else ">i", self.data, self.at)[0]
        self.at += size
        return value

    def count(self) -> int:
        return self.number(self.long)

    def text(self) -> str:
        n = self.count()
        value = self.data[self.at : self.at + n].decode()
        self.at += n + -n % 4
        return value

    def each(self, read) -> list:
        """A list of the header: a tag, how many, then the items."""
        self.number()
        return [read() for _ in range(self.count())]

    def attribute(self):
        name, kind, n = self.text(), KINDS[self.number()], self.count()
        size = np.dtype(kind).itemsize * n
        raw = self.data[self.at : self.at + size]
        self.at += size + -size % 4
        return name, raw.decode() if kind == "S1" else np.frombuffer(raw, kind)

    def variable(self):
        name = self.text()
        dims = [self.count() for _ in range(self.count())]
        attributes = dict(self.each(self.attribute))
        kind, size = KINDS[self.number()], self.count()
        return name, dims, attributes, kind, size, self.number(self.wide)


def classic(data: bytes, name: str) -> tuple[np.ndarray, dict]:
    """A variable's packed values and attributes."""
    r = _Reader(data)
    records = r.count()
    dims = r.each(lambda: (r.text(), r.count()))
    r.each(r.attribute)
    for own, ids, attributes, kind, _, begin in r.each(r.variable):
        if own == name:
            shape = [dims[i][1] or records for i in ids]
            if ids and dims[ids[0]][1] == 0:
                raise ValueError("a variable by records")
            n = int(np.prod(shape))
            return np.frombuffer(data, kind, n, begin).reshape(shape), attributes
    raise KeyError(name)


def _later(data: bytes, name: str) -> tuple[np.ndarray, dict]:
    import h5py

    with h5py.File(io.BytesIO(data), "r") as f:
        return f[name][...], dict(f[name].attrs)


def decode(data: bytes, name: str = "AOD") -> np.ndarray:
    """A scene's values, height x width, missing ones NaN."""
    packed, attributes = classic(data, name) if data[:3] == b"CDF" else _later(data, name)
    values = packed.astype(float)
    one = lambda key: float(np.ravel(attributes[key])[0])
    if str(attributes.get("_Unsigned", "")).lower() == "true" and packed.dtype.kind == "i":
        values = packed.astype(packed.dtype.newbyteorder("=")).view(f"u{packed.dtype.itemsize}").astype(float)
    missing = ~np.isfinite(values)
    for key in ("_FillValue", "missing_value"):
        if key in attributes:
            fill = one(key)
            if "u" in str(attributes.get("_Unsigned", "")).lower() and fill < 0:
                fill += 2.0 ** (8 * packed.dtype.itemsize)
            missing |= np.isclose(values, fill, rtol=1e-5, atol=0)
    if "_FillValue" not in attributes and packed.dtype.str in FILL:
        missing |= np.isclose(values, FILL[packed.dtype.str], rtol=1e-5, atol=0)
    if "valid_range" in attributes:
        low, high = (float(x) for x in np.ravel(attributes["valid_range"])[:2])
        missing |= (values < low) | (values > high)
    scale, offset = (one(k) if k in attributes else d for k, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
    out = np.where(missing, np.nan, values * scale + offset)
    return out.reshape(out.shape[-2:]) if out.ndim > 2 else out


def _scan(name: str):
    def run(batches):
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    v = decode(bytes(data), name)
                except Exception as e:  # noqa: BLE001 any way in which a file may be bad
                    yield pd.DataFrame({"path": [path], "y": [None], "x": [None], "value": [None], "error": [f"{type(e).__name__}: {e}"[:200]]}).astype({"y": "Int32", "x": "Int32", "value": float})
                    continue
                y, x = np.meshgrid(np.arange(v.shape[0]), np.arange(v.shape[1]), indexing="ij")
                yield pd.DataFrame({"path": path, "y": pd.array(y.ravel(), "Int32"), "x": pd.array(x.ravel(), "Int32"), "value": v.ravel(), "error": None})

    return run


def _scenes(spark: SparkSession, path: str, name: str) -> DataFrame:
    ship(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.nc").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content").mapInPandas(_scan(name), "path string, y int, x int, value double, error string")


def read_scenes(spark: SparkSession, path: str, name: str = "AOD") -> DataFrame:
    """(path, y, x, aod) of every readable scene below a path."""
    value = F.when(~F.isnan("value"), F.col("value")).alias("aod")
    return _scenes(spark, path, name).where("error IS NULL").select("path", "y", "x", value)


def bad_scenes(spark: SparkSession, path: str, name: str = "AOD") -> DataFrame:
    """(path, error) of those that are not. Files without a byte are in neither: Spark does not hand them on."""
    return _scenes(spark, path, name).where("error IS NOT NULL").select("path", "error")


def points_of(scenes: DataFrame, lat: DataFrame, lon: DataFrame) -> DataFrame:
    """Scenes (path, y, x, aod) with coordinates (y, x, lat) and (y, x, lon): rows that have all three. The
    coordinates of a source are one table for all its scenes, of the scene's size."""
    where = lat.join(lon, ["y", "x"]).where("lat IS NOT NULL AND lon IS NOT NULL")
    return scenes.where("aod IS NOT NULL").join(where, ["y", "x"]).select("path", "lat", "lon", "aod")
