"""Helpers shared by the text operators: reading tables, batches of bounded size, cached chunks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SLICE_BYTES = 3 << 20
BATCH_ROWS = 1_000  # of an Arrow batch; texts are a few kB


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold few rows, as buffers are held on both sides of every
    Python worker and a row of text is large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a string or binary column (0 for null)."""
    filled = pc.binary_length(column)
    return np.asarray(pc.fill_null(filled, 0), dtype=np.int64)


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``limit`` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(sizes(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def append_columns(
    df: DataFrame, text: str, fields: StructType, fn: Callable[[], Callable[[list[str]], list[pa.Array]]], limit: int = SLICE_BYTES
) -> DataFrame:
    """Rows of ``df`` with columns computed from whole texts (null reads as empty).

    ``fn`` is called once per task and returns the function from texts to arrays. A column of
    ``df`` with the name of a new one is replaced.
    """
    names = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in names]
    passed = kept if text in kept else [*kept, text]
    schema = StructType([f for f in df.schema if f.name in kept] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in slices(batches, text, limit):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + work(texts), names=[f.name for f in schema])

    return df.select(*passed).mapInArrow(run, schema)


def fields(**types) -> StructType:
    return StructType([StructField(n, t) for n, t in types.items()])


def held_out(column: str, modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate the runs ``flat[start : start + length]``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - lengths), lengths)
    return flat[shift + np.arange(total)]


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Arrow lists from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
