"""Whitening of embeddings: leading components of the covariance of distinct vectors, by contour integration.

Components become whole numbers in steps of 1/256, so counts, sums and cross products are exact
wherever they are added up. Rows travel as packed integers; Spark removes equal vectors, and each
task puts out one d x d table of products. Only such tables reach the driver, which finds the
components (:mod:`ecoframe.llm.feast`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ecoframe.llm.common import fields
from ecoframe.llm.feast import largest_pairs
from ecoframe.session import materialise, release

STEPS = 256
COMPONENTS = 4
BLOCK_ROWS = 4_096
EXACT = 1 << 53  # whole numbers up to here are exact doubles
LARGEST = float(1 << 62)
WIDTHS = ("<i2", "<i4", "<i8")


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite entry, entries that fit."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * STEPS < LARGEST))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def pack(rows: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes, two, four or eight an entry as the row's largest needs: equal
    rows have equal bytes. The first byte is the width."""
    largest = np.maximum(rows.max(axis=1), -(rows.min(axis=1) + 1)) if len(rows) else np.zeros(0)
    out: list[bytes] = [b""] * len(rows)
    for k, width in enumerate(WIDTHS):
        above = largest > np.iinfo(WIDTHS[k - 1]).max if k else np.ones(len(rows), dtype=bool)
        for i in np.flatnonzero(above & (largest <= np.iinfo(width).max)).tolist():
            out[i] = bytes([k]) + rows[i].astype(width).tobytes()
    return out


def unpack(column: pa.Array) -> np.ndarray:
    rows = [np.frombuffer(v, WIDTHS[v[0]], offset=1) for v in column.to_pylist()]
    return np.array(rows, dtype=np.int64).reshape(len(rows), -1)


def quantised(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``_x``, the packed floor(256 c) of each usable row. All vectors must have one length."""
    schema = StructType([df.schema[c] for c in keep] + [StructField("_x", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(begin, BLOCK_ROWS)
                column = part.column("_v")
                if len(pc.unique(pc.list_value_length(column))) > 1:
                    raise ValueError("vectors differ in length")
                values = np.asarray(column.flatten(), dtype=np.float64).reshape(part.num_rows, -1)
                rows = np.floor(values * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(pack(rows), pa.binary())], names=schema.names)

    return df.where(usable(vector)).select(*keep, F.col(vector).alias("_v")).mapInArrow(run, schema)


class Whitener(NamedTuple):
    """Moments of the distinct vectors and the components found; numbers of dimensions only."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # a column per component

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Whitened coordinates, a column per component."""
        mean = np.array([float(Fraction(s, self.n)) for s in self.sums])
        return (rows - mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S) squared; null beyond the range of a long."""
        bound = self.n * (max(int(rows.max()), -int(rows.min())) + 1) + max(abs(s) for s in self.sums)
        if rows.shape[1] * bound * bound < 1 << 63:
            gaps = self.n * rows - np.array(self.sums)
            return np.einsum("ij,ij->i", gaps, gaps).tolist()
        gaps = self.n * rows.astype(object) - np.array(self.sums, dtype=object)
        return [v if v < 1 << 63 else None for v in (gaps * gaps).sum(axis=1).tolist()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK_ROWS):
            yield unpack(batch.column("_x").slice(begin, BLOCK_ROWS))


def _whole_sums(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """The sums over all rows of what ``of`` makes of blocks of them: whole numbers of any size, exactly.

    Each task puts out one row per sum, in two parts that decimals hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in _blocks(batches):
            held = of(rows) if held is None else held + of(rows)
        if held is not None:
            columns = [list(range(len(held))), [Decimal(int(v) >> 64) for v in held], [Decimal(int(v) & (1 << 64) - 1) for v in held]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["place", "high", "low"])

    types = (pa.int32(), pa.decimal128(38, 0), pa.decimal128(38, 0))
    parts = fit.select("_x").mapInArrow(run, "place int, high decimal(38,0), low decimal(38,0)")
    totals = parts.groupBy("place").agg(F.sum("high"), F.sum("low")).orderBy("place").collect()
    return [(int(high) << 64) + int(low) for _, high, low in totals]


def _products(rows: np.ndarray, centre: list[int]) -> np.ndarray:
    """Sums and upper cross products of centred rows, exact."""
    largest = max(int(rows.max()), -int(rows.min())) + max(abs(c) for c in centre)
    if len(rows) * largest * largest < EXACT:
        gaps = (rows - np.array(centre)).astype(float)
        square = (gaps.T @ gaps).astype(np.int64)
    else:
        gaps = rows.astype(object) - np.array(centre, dtype=object)
        square = gaps.T @ gaps
    return np.concatenate([gaps.sum(axis=0).astype(object), square[np.triu_indices(len(centre))].astype(object)])


def fit_whitener(distinct: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The leading components of packed vectors (``_x``), each row once; null without a row.

    The first pass gives the sums, the second one products of what is left after taking off the whole
    number next to the mean; the covariance follows exactly and is rounded once. Components
    without variance (beyond rounding) are left out.
    """
    n = distinct.count()
    if not n:
        return None
    sums = _whole_sums(distinct, lambda rows: rows.astype(object).sum(axis=0))
    d = len(sums)
    centre = [round(Fraction(s, n)) for s in sums]
    found = _whole_sums(distinct, lambda rows: _products(rows, centre))
    left, upper = found[:d], found[d:]
    covariance = np.zeros((d, d))
    for (i, j), value in zip(zip(*np.triu_indices(d)), upper):
        covariance[i, j] = covariance[j, i] = float(Fraction(n * value - left[i] * left[j], n * n))
    values, vectors = largest_pairs(covariance, components)
    trace = float(np.trace(covariance))
    real = values > 16 * d * np.finfo(float).eps * trace
    return Whitener(n, sums, trace, values[real], vectors[:, real])


def identity_error(distinct: DataFrame, whitener: Whitener) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    k = len(whitener.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(k + k * k)
        for rows in _blocks(batches):
            z = whitener.project(rows)
            held += np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array(held)], names=["place", "part"])

    parts = distinct.select("_x").mapInArrow(run, "place int, part double")
    totals = np.array([r[1] for r in parts.groupBy("place").agg(F.sum("part")).orderBy("place").collect()]) / whitener.n
    # Coordinates are centred already; what rounding left of their means is taken off too.
    covariance = totals[k:].reshape(k, k) - np.outer(totals[:k], totals[:k])
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per usable row and component.

    Vectors x are floor(256 c) of the given ones. The fit uses each distinct x once: n of them with sums S.
    ``deviation`` is the exact sum of (n x - S) squared (null beyond the range of a long), ``whitened``
    the coordinate on the component with variance 1, ``explained`` the component's share of the variance.

    Rows whose vector is null, empty, or holds a null, a non-finite or an entry beyond a long take
    no part. All others must have one length, or the work stops with an error. Repeated rows and null
    keys each get their own result; equal vectors alone have no variance and give no row, as does an empty table.
    Columns other than ``key`` and ``vector`` are not read.
    """
    name, kind = key, df.schema[key].dataType
    rows = materialise(quantised(df.select(F.col(key).alias("_key"), vector), vector, ["_key"]), "whole-vectors")
    distinct = materialise(rows.select("_x").distinct(), "distinct-vectors")
    whitener = fit_whitener(distinct, components)
    schema = StructType([StructField(name, kind)] + list(fields(
        component=IntegerType(), n=LongType(), deviation=LongType(), whitened=DoubleType(), explained=DoubleType(), identity_error=DoubleType()
    )))
    if whitener is None or not len(whitener.values):
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(distinct, whitener), len(whitener.values)
    release(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(begin, BLOCK_ROWS)
                values = unpack(part.column("_x"))
                each = pa.array(np.repeat(np.arange(len(values)), k))
                columns = [
                    part.column("_key").take(each), pa.array(np.tile(np.arange(1, k + 1), len(values)), pa.int32()),
                    pa.array(np.full(len(values) * k, whitener.n)), pa.array(whitener.deviations(values), pa.int64()).take(each),
                    pa.array(whitener.project(values).ravel()), pa.array(np.tile(whitener.values / whitener.trace, len(values))),
                    pa.array(np.full(len(values) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
