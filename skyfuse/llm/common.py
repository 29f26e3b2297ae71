"""Shared parts of the corpus operators: intermediate tables in the cluster's
shared folder, and iteration over Arrow batches by bounded amounts of text."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from skyfuse.session import shared_dir, ship, table

__all__ = ["ship", "table", "shared_dir", "materialize", "discard", "tidy", "text_slices", "parallelism"]

_written: list[str] = []  # paths of the tables that materialize() has written and nothing has removed


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """Write df into the shared folder, parted by the columns `by`, and read it back:
    later reads neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/skyfuse/{uuid.uuid4().hex}.parquet"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _written.append(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._path = path
    return read


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that materialize() gave, when nothing lazy reads them any more. Others, and None, are left alone."""
    for df in tables:
        path = getattr(df, "_path", None)
        if path:
            _remove(df.sparkSession, path)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Remove in the end all tables written within, but for those that the function it gives is called with."""
    before, keep = set(_written), []
    yield keep.append
    stay = {getattr(df, "_path", None) for df in keep}
    for path in [x for x in _written if x not in before and x not in stay]:
        _remove(spark, path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches that hold about `most` bytes of text each (one row
    at least), with the texts as UTF-8; null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield _slice(batch, at, start, i)
                start, held = i, 0
            held += int(n) + 16
        yield _slice(batch, at, start, batch.num_rows)


def _slice(batch: pa.RecordBatch, at: int, start: int, stop: int) -> tuple[pa.RecordBatch, list[bytes]]:
    part = batch.slice(start, stop - start)
    texts = part.column(at)
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return part, [x or b"" for x in texts.cast(kind).to_pylist()]
