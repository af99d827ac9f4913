"""Token ids as length-delimited binary records, with a separate offset index.

A data file is a sequence of frames in ascending key order:

    length of payload   8 bytes, little-endian
    masked checksum     4 bytes, of those 8 bytes
    payload             key (8 bytes, signed), flags (1 byte), ids
    masked checksum     4 bytes, of the payload
    terminator          one line feed

Flag 1 marks a null key; flag 2 ids of four bytes, otherwise they take two. A checksum is CRC-32,
rotated right by 15 bits plus a constant, so that a checksum of data that holds checksums stays
sound. Files are written and read by Spark's own sources, so they may lie in any store, and failed
or repeated tasks leave no half-written file. The index is Parquet: key, file, offset, length,
number of ids and their place in the whole sequence.
"""

from __future__ import annotations

import functools
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType

from ecoframe.llm.chunks import LETTERS, NUMBERS, ChunkEncoder, PieceEncoder, library, piece_encoder, string_encoder
from ecoframe.llm.common import fields, slices
from ecoframe.session import materialise

FILE_BYTES = 24 << 20  # text per data file
MAX_BROADCAST = 200_000  # files
CACHED_PIECES = 400_000
# Fixed value: the split pattern of the byte-level vocabulary, for plain texts.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
MASK_DELTA = 0xA282EAD8
NULL_KEY, WIDE = 1, 2
FRAME = struct.Struct("<QI")
HEAD = struct.Struct("<qB")


class DamagedRecord(ValueError):
    """A frame whose lengths or checksums do not fit."""


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray) -> bytes:
    """One record without its terminator, which the writer adds."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    flags = (NULL_KEY if key is None else 0) | (WIDE if wide else 0)
    payload = HEAD.pack(key or 0, flags) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))])


def frames(content: bytes) -> Iterator[tuple[int | None, np.ndarray, int, int]]:
    """(key, ids, offset, length with terminator) of each record; raises on damage."""
    view, at = memoryview(content), 0
    while at < len(view):
        if at + FRAME.size > len(view):
            raise DamagedRecord(f"cut header at {at}")
        length, check = FRAME.unpack_from(view, at)
        if masked(view[at : at + 8]) != check:
            raise DamagedRecord(f"length at {at}")
        begin, end = at + FRAME.size, at + FRAME.size + length
        if end + 5 > len(view) or view[end + 4] != 0x0A:
            raise DamagedRecord(f"cut record at {at}")
        if masked(view[begin:end]) != struct.unpack_from("<I", view, end)[0]:
            raise DamagedRecord(f"payload at {at}")
        key, flags = HEAD.unpack_from(view, begin)
        ids = np.frombuffer(view[begin + HEAD.size : end], dtype="<u4" if flags & WIDE else "<u2")
        yield None if flags & NULL_KEY else key, ids, at, end + 5 - at
        at = end + 5


@functools.lru_cache(maxsize=1)
def worker_encoder(vocabulary: str) -> PieceEncoder:
    """One per Python worker."""
    tokenizer = library(vocabulary)
    odd = ChunkEncoder(string_encoder(tokenizer), CACHED_PIECES)
    return PieceEncoder(piece_encoder(tokenizer), SPLIT, CACHED_PIECES, odd)


def write_records(
    df: DataFrame, path: str, vocabulary: str, end_id: int = 0, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES
) -> None:
    """Encode each text, append ``end_id`` and write the frames in ascending key order.

    Null and empty texts become the end id alone; null keys come first; equal keys keep all their
    rows, in any order. An empty table writes a folder without records. Only ``key`` and ``text``
    are read. Rows are dealt by ranges of the key, so a file holds about ``file_bytes`` of text.
    """
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, math.ceil(total / file_bytes))
    # A random second key lets a repeated key spread over files.
    ordered = (
        df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.rand(7).alias("tie"))
        .repartitionByRange(parts, F.asc_nulls_first("key"), "tie")
        .sortWithinPartitions(F.asc_nulls_first("key"), "tie")
        .select("key", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in slices(batches, "text", 8 << 20):
            flat, counts = encoder([t or "" for t in batch.column("text").to_pylist()])
            ends = np.cumsum(counts)
            full = np.insert(flat, ends, end_id)
            bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).tolist()
            keys = batch.column("key").to_pylist()
            rows = [frame(k, full[a:b]) for k, a, b in zip(keys, bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["frame"])

    # The text writer puts out a string's bytes as they are, and the line feed after them.
    framed = ordered.mapInArrow(run, fields(frame=BinaryType()))
    framed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(file, offset, length, key, before, n_ids[, ids]) of every record; checksums are tested.

    ``ids`` are little-endian unsigned 32-bit integers; ``before`` counts the ids of the same file
    that come before the record.
    """
    schema = fields(
        file=StringType(), offset=LongType(), length=IntegerType(), key=LongType(), before=LongType(), n_ids=LongType(),
        **({"ids": BinaryType()} if with_ids else {}),
    )

    def rows_of(file: str, content: bytes) -> Iterator[pa.RecordBatch]:
        rows, before, held = [], 0, 0
        for key, ids, offset, length in frames(content):
            rows.append((file, offset, length, key, before, len(ids), *([ids.astype("<u4").tobytes()] if with_ids else [])))
            before += len(ids)
            held += len(ids) * 4
            if held > 8 << 20 or len(rows) >= 10_000:
                yield to_batch(rows)
                rows, held = [], 0
        if rows:
            yield to_batch(rows)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from rows_of(batch.column("path")[i].as_py(), batch.column("content")[i].as_buffer())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def write_index(spark: SparkSession, path: str, index_path: str) -> None:
    """The offset index, made from the frames in the files themselves."""
    read_records(spark, path, with_ids=False).write.parquet(index_path)


def file_starts(index: DataFrame) -> DataFrame:
    """(file, file_start): ids before each file. Key order is the order of the numbers in the names, which
    are wider than five digits beyond 100 000 files."""
    per_file = index.groupBy("file").agg(F.sum("n_ids").alias("n"))
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")
    earlier = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    return per_file.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("file_start"))


def with_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """Records with ``start``, the ids of all records before.

    The starts have one row per file, that is per ``FILE_BYTES`` of text. Up to ``MAX_BROADCAST``
    files they are broadcast, so that the ids need no shuffle; beyond, they are joined.
    """
    starts = materialise(file_starts(index), "file-starts")
    few = starts.count() <= MAX_BROADCAST
    return records.join(F.broadcast(starts) if few else starts, "file").withColumn("start", F.col("before") + F.col("file_start"))


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int = 0) -> DataFrame:
    """(key, record): the frames in an order drawn by ``seed``, cut out of the files by the index."""
    wanted = index.groupBy("file").agg(F.collect_list(F.struct("key", "offset", "length")).alias("places"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    records = (
        files.select(F.col("path").alias("file"), "content")
        .join(wanted, "file")
        .select("file", "content", F.explode("places").alias("p"))
        .select("p.key", "p.offset", "file", F.expr("substring(content, cast(p.offset + 1 as int), p.length)").alias("record"))
    )
    return records.orderBy(F.xxhash64(F.lit(seed), "file", "offset")).select("key", "record")
