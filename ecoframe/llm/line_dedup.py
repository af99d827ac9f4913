"""Lines that repeat across documents, by probing sharded perfect-hash arrays.

Every distinct key of a line is a 128-bit hash. The hashes are dealt into shards of bounded size;
a shard is one minimal perfect hash over its keys plus arrays in its order: a 32-bit fingerprint,
a saturating one-byte document count and, for repeated keys only, the document that keeps the line.
The line hashes of the documents are dealt to the shards and probe the arrays; lines are not
joined. Shards under heavy use are probed by several tasks at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType

from ecoframe.llm.common import fields, slices
from ecoframe.llm.perfect_hash import PerfectHash, build
from ecoframe.session import materialise

MIN_LENGTH = 20
MIN_DOCS = 3
SHARD_KEYS = 200_000
SHARD_PROBES = 400_000
SATURATED = 255


def line_keys(text: str) -> list[bytes | None]:
    """The 16-byte hash of each line's key, None for keys under ``MIN_LENGTH`` code points."""
    digest = xxhash.xxh3_128_digest
    found: list[bytes | None] = []
    for line in text.split("\n"):
        if len(line) < MIN_LENGTH:
            found.append(None)
            continue
        key = line.encode("utf-8", "replace").strip().lower()
        short = len(key) < 4 * MIN_LENGTH and len(key.decode("utf-8")) < MIN_LENGTH
        found.append(None if short else digest(key))
    return found


def occurrences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, high, low): distinct line keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = [{k for k in line_keys(t or "") if k} for t in batch.column(text).to_pylist()]
            pairs = np.frombuffer(b"".join(k for s in sets for k in s), dtype=np.int64).reshape(-1, 2)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            docs = batch.column(key).cast(pa.int64()).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))],
                names=["doc", "high", "low"],
            )

    found = df.select(key, text).mapInArrow(run, fields(doc=LongType(), high=LongType(), low=LongType()))
    return found.distinct()


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column, dtype=np.int64).view(np.uint64)


def build_shards(keys: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """(shard, probers, hash, prints, counts, keepers): one row of arrays per shard."""

    def arrays(table: pa.Table) -> pa.Table:
        high, low = _unsigned(table["high"]), _unsigned(table["low"])
        blob = build(high, low)
        order = np.argsort(PerfectHash(blob)(high, low))
        counts = np.asarray(table["docs"], dtype=np.int64)[order]
        keepers = np.asarray(table["keeper"].fill_null(np.iinfo(np.int64).min), dtype=np.int64)[order]
        row = {
            "shard": [table["shard"][0].as_py()],
            "probers": [max(1, -(-int(counts.sum()) // SHARD_PROBES))],
            "hash": [blob],
            "prints": [low[order].astype("<u4").tobytes()],
            "counts": [np.minimum(counts, SATURATED).astype(np.uint8).tobytes()],
            "keepers": [keepers[counts >= min_docs].astype("<i8").tobytes()],
        }
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array(v, t) for v, t in zip(row.values(), types)], names=list(row))

    schema = fields(
        shard=IntegerType(), probers=IntegerType(), hash=BinaryType(), prints=BinaryType(), counts=BinaryType(), keepers=BinaryType()
    )
    sharded = keys.withColumn("shard", F.pmod("high", F.lit(n_shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(arrays, schema)


def probe(found: DataFrame, shards: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """(doc, key): line keys that a document loses, found in the arrays."""
    if min_docs > SATURATED:
        raise ValueError(f"min_docs is at most {SATURATED}")

    def look(group: tuple, arrays: pa.Table, lines: pa.Table) -> pa.Table:
        if not arrays.num_rows or not lines.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["doc", "key"])
        high, low = _unsigned(lines["high"]), _unsigned(lines["low"])
        number = PerfectHash(arrays["hash"][0].as_py())(high, low)
        prints = np.frombuffer(arrays["prints"][0].as_py(), "<u4")
        counts = np.frombuffer(arrays["counts"][0].as_py(), np.uint8)
        keepers = np.frombuffer(arrays["keepers"][0].as_py(), "<i8")
        repeated = counts >= min_docs
        member = (number >= 0) & (prints[number] == low.astype("<u4")) & repeated[number]
        keeper = np.full(len(high), np.iinfo(np.int64).min)
        keeper[member] = keepers[(np.cumsum(repeated) - 1)[number[member]]]
        docs = np.asarray(lines["doc"].fill_null(np.iinfo(np.int64).min), dtype=np.int64)
        lost = np.flatnonzero(member & (docs != keeper))
        raw = np.stack([high[lost], low[lost]], axis=1).astype("<u8").tobytes()
        keys = pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())
        return pa.table([lines["doc"].take(pa.array(lost)), keys], names=["doc", "key"])

    shard = F.pmod("high", F.lit(n_shards)).cast("int")
    lines = (
        found.withColumn("shard", shard)
        .join(shards.select("shard", "probers"), "shard")
        .withColumn("part", F.pmod(F.xxhash64("doc"), F.col("probers")).cast("int"))
        .drop("probers")
    )
    copies = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("probers") - 1))).drop("probers")
    return (
        copies.groupBy("shard", "part")
        .cogroup(lines.groupBy("shard", "part"))
        .applyInArrow(look, fields(doc=LongType(), key=BinaryType()))
    )


def drop_lines(df: DataFrame, lost: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with the remaining text, and columns n_lines (before) and n_dropped."""
    per_doc = lost.groupBy(F.col("doc").alias("_lost_by")).agg(F.collect_list("key").alias("_lost"))
    joined = df.drop("n_lines", "n_dropped").join(per_doc, F.col(key).eqNullSafe(F.col("_lost_by")), "left").drop("_lost_by")
    kept = [f for f in df.schema if f.name not in ("n_lines", "n_dropped")]
    schema = fields(**{f.name: f.dataType for f in kept}, n_lines=LongType(), n_dropped=LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts, totals, dropped = [], [], []
            for value, lost_keys in zip(batch.column(text).to_pylist(), batch.column("_lost").to_pylist()):
                lines = (value or "").split("\n")
                totals.append(len(lines))
                if lost_keys:
                    gone = set(lost_keys)
                    stay = [line for line, k in zip(lines, line_keys(value or "")) if k is None or k not in gone]
                    dropped.append(len(lines) - len(stay))
                    texts.append("\n".join(stay))
                else:
                    dropped.append(0)
                    texts.append(value or "")
            new = {text: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(
                [new.get(f.name, batch.column(f.name)) for f in kept] + [pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())],
                names=schema.names,
            )

    return joined.mapInArrow(run, schema)


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``df`` without lines that at least ``min_docs`` documents hold, save in the one of largest key.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys under 20 code
    points never count. Null and empty texts are one empty line and come back as empty text. Rows
    of one key are one document; a null key is a document of its own below all others. Other
    columns pass through; columns named n_lines and n_dropped are replaced. An empty table
    stays empty.
    """
    found = materialise(occurrences(df, key, text), "lines")
    counted = found.groupBy("high", "low").agg(F.count("*").alias("docs"), F.max("doc").alias("keeper"))
    keys = materialise(counted, "line-keys")
    n_shards = max(1, -(-keys.count() // SHARD_KEYS))
    shards = materialise(build_shards(keys, n_shards, min_docs), "shards")
    lost = materialise(probe(found, shards, n_shards, min_docs), "lost-lines")
    return drop_lines(df, lost, key, text)
