"""Best-fit packing of token sequences, planned on the histogram of lengths.

Cutting a document at the capacity leaves pieces of ``capacity`` lengths at most, so best-fit
decreasing needs only how many pieces have each length. Bins with the same room left are one run of
consecutive numbers: a length fills whole runs at a time, and the plan has a few runs per length
however many pieces there are. Pieces then get a rank within their length, and the run that covers
(length, rank) names their sequence and their place in it.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ecoframe.llm.chunks import LETTERS, NUMBERS, PieceEncoder, WordEncoder, library, piece_encoder, string_encoder
from ecoframe.llm.common import fields, slices
from ecoframe.session import materialise

CAPACITY = 2048
CACHED_PIECES = 400_000
# Fixed value: the split pattern of the word vocabulary, for plain texts.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


class Slots(NamedTuple):
    """Runs of planned places, sorted by (length, rank).

    A run holds ``bins`` sequences from ``sequence`` on. Its piece number i within the run lies in
    sequence ``sequence + i % bins`` at ``offset + i // bins * length``.
    """

    length: np.ndarray
    rank: np.ndarray
    bins: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces given by length and rank."""
        run = np.searchsorted(_joined(self.length, self.rank), _joined(lengths, ranks), side="right") - 1
        number = ranks - self.rank[run]
        return self.sequence[run] + number % self.bins[run], self.offset[run] + number // self.bins[run] * lengths


def _joined(lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    return (lengths.astype(np.int64) << 40) | ranks.astype(np.int64)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Slots:
    """Best-fit decreasing over counts: each length goes to the fullest bins that take it."""
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    rooms: list[int] = []  # sorted keys of ``bins``
    bins: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of (first sequence, number)
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def keep(room: int, first: int, number: int) -> None:
        if number:
            if room not in bins:
                bisect.insort(rooms, room)
            bins.setdefault(room, []).append((first, number))

    def fill(length: int, rank: int, left: int, room: int, first: int, number: int) -> int:
        """Put up to ``left`` pieces into one run of bins; how many went in."""
        each = room // length
        full = min(number, left // each)
        if full:
            runs.append((length, rank, full, first, capacity - room))
            keep(room - each * length, first, full)
        used = full * each
        some = min(left - used, each) if full < number else 0
        if some:
            runs.append((length, rank + used, 1, first + full, capacity - room))
            keep(room - some * length, first + full, 1)
        keep(room, first + full + (some > 0), number - full - (some > 0))
        return used + some

    for length in sorted(histogram, reverse=True):
        rank, left = 0, int(histogram[length])
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                number = -(-left // each)
                first, room, opened = opened, capacity, opened + number
            else:
                room = rooms[at]
                first, number = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            done = fill(length, rank, left, room, first, number)
            rank, left = rank + done, left - done
    columns = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5).T
    return Slots(*columns, opened)


@functools.lru_cache(maxsize=1)
def worker_encoder(vocabulary: str) -> PieceEncoder:
    """One per Python worker."""
    tokenizer = library(vocabulary)
    odd = WordEncoder(string_encoder(tokenizer), CACHED_PIECES)
    return PieceEncoder(piece_encoder(tokenizer), SPLIT, CACHED_PIECES, odd, lower=True)


def cut(
    df: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, piece, start, length, ids): every text encoded, ended by ``end_id`` and cut at ``capacity``.

    ``ids`` are little-endian unsigned 32-bit integers; ``start`` counts the document's ids before
    the piece. Null and empty texts are the end id alone. Null and repeated keys stay rows of their
    own; other columns are not read, an empty table gives no piece. The vocabulary must drop white
    space, so that words between blanks are encoded one by one.
    """
    schema = StructType([
        StructField(key, df.schema[key].dataType), *fields(piece=IntegerType(), start=LongType(), length=LongType(), ids=BinaryType())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in slices(batches, text):
            flat, counts = encoder([t or "" for t in batch.column(text).to_pylist()])
            totals = counts + 1
            ids = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
            n_pieces = -(-totals // capacity)
            row = np.repeat(np.arange(len(counts)), n_pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            length = np.minimum(capacity, totals[row] - start)
            data = pa.BinaryArray.from_buffers(
                pa.binary(), len(row),
                [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)), pa.py_buffer(ids)],
            )
            columns = [batch.column(key).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), data]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity``, filled from 0 without gaps.

    Rows are written once with a rank within (task, length); how many rows earlier tasks have of a
    length makes it the rank within the length, so no length is ever sorted in one task, also if a
    third of all pieces have the same. The plan is as large as there are lengths and goes to every
    task. Columns named like results are replaced. Equal rows get places of their own; an empty table
    gives an empty result; lengths outside 1..capacity raise.
    """
    taken = {"sequence_id", "offset", "_task", "_place", "_before"}
    kept = [c for c in pieces.columns if c.lower() not in taken]
    schema = StructType([pieces.schema[c] for c in kept] + list(fields(_task=IntegerType(), _place=LongType())))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            lengths = np.asarray(batch.column(length), dtype=np.int64)
            if len(lengths) and not (0 < lengths.min() and lengths.max() <= capacity):
                raise ValueError(f"lengths must lie in 1..{capacity}")
            order = np.argsort(lengths, kind="stable")
            counts = np.bincount(lengths, minlength=capacity + 1)
            within = np.empty(len(lengths), dtype=np.int64)
            within[order] = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts)
            places = within + seen[lengths]
            seen += counts
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.full(len(lengths), task), pa.int32()), pa.array(places)], names=schema.names
            )

    ranked = materialise(pieces.select(*kept).mapInArrow(rank, schema), "pieces")
    per_task = materialise(ranked.groupBy("_task", F.col(length).cast("long").alias("_length")).agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in per_task.groupBy("_length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    slots = plan(histogram, capacity)
    earlier = Window.partitionBy("_length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select(
        F.col("_task").alias("_t"), "_length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
    )
    met = ranked.join(before, (F.col("_task") == F.col("_t")) & (F.col(length) == F.col("_length")))
    result = StructType([pieces.schema[c] for c in kept] + list(fields(sequence_id=LongType(), offset=LongType())))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = np.asarray(batch.column("_place")) + np.asarray(batch.column("_before"))
            sequence, offset = slots.place(np.asarray(batch.column(length), dtype=np.int64), ranks)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=result.names)

    return met.select(*kept, "_place", "_before").mapInArrow(settle, result)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces): the packed sequences themselves, from placed pieces with ``ids``.

    A sequence is bounded by its capacity, so gathering one is too.
    """
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = placed.groupBy("sequence_id").agg(inside.alias("inside"))
    joined = F.aggregate("inside", F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    spans = F.transform("inside", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length")))
    return grouped.select("sequence_id", (F.octet_length(joined) / 4).cast("long").alias("n_tokens"), joined.alias("ids"), spans.alias("pieces"))
