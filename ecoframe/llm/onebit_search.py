"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Vectors are padded with zeros to the code length, turned by one random rotation and reduced to the
signs of their coordinates, packed into bits, with two scalars: the length of the vector and the
cosine between the turned vector and its sign vector. From these, the inner product with a query is
estimated without bias, and its error is bounded with the cosine: beyond ``CONFIDENCE`` standard
deviations it is off in about one of 20 000 cases. Only vectors whose upper bound reaches the
query's threshold are compared exactly.

Vectors lie in blocks of a fixed number, queries in tiles. Each query first gets a threshold from
the exact products with one bounded, evenly drawn set of vectors, and then visits every block
once; in a block the threshold rises as exact products are known. Blocks return their best, which
are merged per query. No vector is left out, so the only loss is that of the error bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType

from ecoframe.llm.common import fields
from ecoframe.session import materialise

CONFIDENCE = 4.0
BLOCK_ROWS = 4_096
TILE_ROWS = 512
SAMPLE_VALUES = 1 << 19  # bound of the set that gives the first thresholds, rows times dimensions
ROTATION_SEED = 11


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector): rows that take part, with finite components and a length over zero."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("id"), values.alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine & F.exists("vector", lambda x: x != 0))


def code_bits(dim: int) -> int:
    """Length of a code: a multiple of 64, at least 128."""
    return max(128, -(-dim // 64) * 64)


def rotation(dim: int) -> np.ndarray:
    """The first ``dim`` rows of a random rotation in the space of the codes."""
    size = code_bits(dim)
    q, r = np.linalg.qr(np.random.default_rng(ROTATION_SEED).normal(size=(size, size)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, lengths, cosines to the sign vector)."""
    turned = vectors @ turn
    lengths = np.linalg.norm(vectors, axis=1)
    cosines = np.abs(turned).sum(axis=1) / (lengths * math.sqrt(turn.shape[1]))
    return np.packbits(turned > 0, axis=1), lengths, cosines


def bounds(bits: np.ndarray, lengths: np.ndarray, cosines: np.ndarray, turned_queries: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products (queries x vectors) from codes."""
    size = turned_queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=size).astype(np.float32) * 2 - 1
    products = turned_queries.astype(np.float32) @ signs.T
    scale = (lengths / (cosines * math.sqrt(size))).astype(np.float32)
    spread = lengths * np.sqrt(np.maximum(0.0, 1 / cosines**2 - 1) / (size - 1))
    query_lengths = np.linalg.norm(turned_queries, axis=1).astype(np.float32)
    return products * scale + np.outer(query_lengths, (CONFIDENCE * spread).astype(np.float32)) + np.float32(1e-5) * np.outer(query_lengths, lengths.astype(np.float32))


def packed_groups(rows: DataFrame, size: int, total: int, salt: int) -> DataFrame:
    """(part, ids, vectors): rows gathered into binary groups of about ``size``, each one row."""
    parts = max(1, -(-total // size))

    def pack(table: pa.Table) -> pa.Table:
        ids = np.asarray(table["id"], dtype="<i8")
        flat = np.asarray(table["vector"].combine_chunks().flatten(), dtype="<f8")
        order = np.argsort(ids, kind="stable")
        flat = flat.reshape(len(ids), -1)[order]
        row = [table["part"][:1], pa.array([ids[order].tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())]
        return pa.table(row, names=["part", "ids", "vectors"])

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInArrow(pack, fields(part=IntegerType(), ids=BinaryType(), vectors=BinaryType()))


def _arrays(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, "<i8")
    return numbers, np.frombuffer(vectors, "<f8").reshape(len(numbers), -1)


def best(products: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest products, ties to smaller ids."""
    if len(products) > 4 * k:
        bar = np.partition(products, len(products) - k)[len(products) - k]
        near = np.flatnonzero(products >= bar)
    else:
        near = np.arange(len(products))
    return near[np.lexsort((ids[near], -products[near]))[:k]]


def thresholds(queries: DataFrame, sample: pa.Table, k: int) -> DataFrame:
    """Queries with a lower bound of their k-th largest product, from the sample."""
    ids = np.asarray(sample["id"], dtype=np.int64)
    vectors = np.asarray(sample["vector"].combine_chunks().flatten(), dtype=np.float64).reshape(max(1, len(ids)), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(begin, TILE_ROWS)
                mine = np.asarray(part.column("id"), dtype=np.int64)
                flat = np.asarray(part.column("vector").flatten(), dtype=np.float64).reshape(len(mine), -1)
                if len(ids) > k:
                    products = flat @ vectors.T
                    products[mine[:, None] == ids] = -np.inf
                    bar = np.partition(products, len(ids) - k, axis=1)[:, len(ids) - k]
                    bar = np.where(np.isfinite(bar), bar, -np.inf)
                else:
                    bar = np.full(len(mine), -np.inf)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), pa.array(bar)], names=["id", "vector", "bar"])

    return queries.mapInArrow(run, fields(id=LongType(), vector=queries.schema["vector"].dataType, bar=DoubleType()))


def search_block(
    tile: tuple[np.ndarray, np.ndarray, np.ndarray], block: tuple[np.ndarray, np.ndarray], codes: tuple, turn: np.ndarray, k: int
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, products) of at most ``k`` neighbours per query in one block."""
    query_ids, queries, bars = tile
    ids, vectors = block
    upper = bounds(*codes, queries @ turn)
    found = []
    for row, query in enumerate(query_ids.tolist()):
        near = np.flatnonzero(upper[row] >= bars[row])
        near = near[ids[near] != query]
        if len(near) > 4 * k:
            # The likeliest first: their exact products raise the threshold for the rest.
            first = near[np.argpartition(-upper[row][near], 2 * k)[: 2 * k]]
            exact = np.sort(vectors[first] @ queries[row])[-k]
            near = near[upper[row][near] >= max(exact, bars[row])]
        if len(near):
            products = vectors[near] @ queries[row]
            top = best(products, ids[near], k)
            found.append((query, ids[near][top], products[top]))
    return found


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the largest inner products
    for each row of ``queries``, itself (the same key) left out; ties go to the smaller key.

    Vectors that are null, empty, all zero or hold null or non-finite components, and rows with a
    null key, take no part on either side. All vectors must have one length. Repeated keys are
    candidates each. With fewer than ``k`` candidates all are returned; empty tables give an empty
    result. Scores are products in double precision of the original vectors.
    """
    spark = vectors.sparkSession
    schema = fields(query_id=LongType(), vec_id=LongType(), score=DoubleType())
    rows = materialise(usable(vectors, key, vector), "vectors")
    asked = materialise(usable(queries, key, vector), "queries")
    total, n_queries = rows.count(), asked.count()
    lengths = [r[0] for r in rows.select(F.size("vector")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("vectors differ in length")
    if not total or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = max(2 * k, SAMPLE_VALUES // lengths[0])
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(max(1, total // wanted))) == 0).limit(2 * wanted)
    barred = materialise(thresholds(asked, sample.toArrow(), k), "thresholds")
    blocks = packed_groups(rows, BLOCK_ROWS, total, 1)
    n_blocks = max(1, -(-total // BLOCK_ROWS))
    tiles = materialise(_tiles(barred, n_queries), "tiles")
    pairs = (
        tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        .join(_with_codes(blocks), "part")
        .select("query_ids", "query_vectors", "bars", "ids", "vectors", "bits", "lengths", "cosines")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = None
        for batch in batches:
            for row in range(batch.num_rows):
                value = {name: batch.column(name)[row].as_buffer() for name in batch.schema.names}
                tile = *_arrays(value["query_ids"], value["query_vectors"]), np.frombuffer(value["bars"], "<f8")
                block = _arrays(value["ids"], value["vectors"])
                if turn is None:
                    turn = rotation(block[1].shape[1])
                n = len(block[0])
                codes = np.frombuffer(value["bits"], np.uint8).reshape(n, -1), np.frombuffer(value["lengths"]), np.frombuffer(value["cosines"])
                found = search_block(tile, block, codes, turn, k)
                if found:
                    counts = [len(ids) for _, ids, _ in found]
                    columns = [np.repeat([q for q, _, _ in found], counts), np.concatenate([i for _, i, _ in found]), np.concatenate([s for _, _, s in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

    found = pairs.mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _tiles(barred: DataFrame, n_queries: int) -> DataFrame:
    parts = max(1, -(-n_queries // TILE_ROWS))

    def pack(table: pa.Table) -> pa.Table:
        names = ["id", "vector", "bar"]
        values = [np.asarray(table[n].combine_chunks().flatten() if n == "vector" else table[n]).astype(t).tobytes() for n, t in zip(names, ("<i8", "<f8", "<f8"))]
        return pa.table([pa.array([v], pa.binary()) for v in values], names=["query_ids", "query_vectors", "bars"])

    dealt = barred.withColumn("tile", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)).cast("int"))
    return dealt.groupBy("tile").applyInArrow(pack, fields(query_ids=BinaryType(), query_vectors=BinaryType(), bars=BinaryType()))


def _with_codes(blocks: DataFrame) -> DataFrame:
    """Blocks with the packed codes and scalars of their vectors: the index, one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = None
        for batch in batches:
            columns: list[list[bytes]] = [[], [], []]
            for row in range(batch.num_rows):
                _, vectors = _arrays(batch.column("ids")[row].as_buffer(), batch.column("vectors")[row].as_buffer())
                if turn is None:
                    turn = rotation(vectors.shape[1])
                for column, value in zip(columns, encode(vectors, turn)):
                    column.append(value.tobytes())
            kept = [batch.column(n) for n in ("part", "ids", "vectors")]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, pa.binary()) for c in columns]], names=schema.names)

    schema = fields(part=IntegerType(), ids=BinaryType(), vectors=BinaryType(), bits=BinaryType(), lengths=BinaryType(), cosines=BinaryType())
    return materialise(blocks.mapInArrow(run, schema), "codes")
