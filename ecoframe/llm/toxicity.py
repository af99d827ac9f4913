"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) is a distribution over words by continuation counts: a word counts once
for every different word that it follows in the class, so copies of a text add nothing. Counts are
discounted absolutely, and the mass that the discount frees goes to one backoff distribution that
both classes share: continuation counts over all labelled text. A word that is rare in both classes
therefore says nothing for either. A text's measure is the largest length-normalised difference of
the two log-likelihoods over its windows of a few words, so that a short insult counts as much in a
long text as in a short one; a logistic curve, fitted on labelled rows that the counts do not use,
turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, LongType, StructType

from ecoframe.llm.common import append_columns, fields, slices
from ecoframe.llm.language_id import words_of
from ecoframe.session import materialise

WINDOW = 4
DISCOUNT = 4
MODEL_WORDS = 2_000_000  # a word is 16 bytes of the model that every task holds; more are joined
LABELS_BROADCAST = 2_000_000  # rows of two numbers
BINS = 100  # per unit of the measure, when the curve is fitted
CACHED_WORDS = 100_000
ORDINARY, TOXIC = 1, 2


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def labelled(df: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Rows of ``df`` with a 0/1 label; of several labels of a key the larger counts.

    Labels are broadcast up to ``LABELS_BROADCAST`` rows, so that texts are not shuffled; beyond,
    both sides are joined on the key.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    small = labels.count() <= LABELS_BROADCAST
    return df.join(F.broadcast(known) if small else known, key)


def continuations(rows: DataFrame, text: str) -> DataFrame:
    """(word, ordinary, toxic, both): different words before it, by class and in either.

    ``rows`` has ``_label``. Words are 64-bit hashes; the pairs of a slice are made distinct
    before the shuffle, and the counts are combined before the second one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            codes: dict[str, int] = {"": 0}  # the empty word stands before the first one
            place = codes.setdefault
            before, after, kind = [], [], []
            for value, label in zip(batch.column(text).to_pylist(), batch.column("_label").to_pylist()):
                found = [0] + [place(w, len(codes)) for w in words_of(value or "")]
                before.extend(found[:-1])
                after.extend(found[1:])
                kind.extend([label] * (len(found) - 1))
            size = len(codes)
            packed = (np.array(before, dtype=np.int64) * size + np.array(after, dtype=np.int64)) * 2 + np.array(kind, dtype=np.int64)
            packed = np.unique(packed)
            hashes = np.array([word_hash(w) for w in codes], dtype=np.uint64).view(np.int64)
            pair = packed // 2
            columns = [hashes[pair // size], hashes[pair % size], np.where(packed % 2, TOXIC, ORDINARY).astype(np.int8)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["before", "word", "classes"])

    pairs = rows.select(text, "_label").mapInArrow(run, fields(before=LongType(), word=LongType(), classes=ByteType()))
    pairs = pairs.groupBy("before", "word").agg(F.bit_or("classes").alias("classes"))
    return pairs.groupBy("word").agg(
        F.sum(F.col("classes").bitwiseAND(ORDINARY).cast("long")).alias("ordinary"),
        F.sum(F.shiftright(F.col("classes").cast("int"), 1).cast("long")).alias("toxic"),
        F.count("*").alias("both"),
    )


@dataclass
class ToxicityModel:
    """Log-likelihood ratios of the words that a class knows, by sorted hash or (over ``MODEL_WORDS``) as a
    table of word and ratio; the same for all others; and the curve from measure to probability."""

    hashes: np.ndarray
    ratios: np.ndarray
    unknown: float
    table: DataFrame | None = None
    slope: float = 1.0
    shift: float = 0.0


def _ratios(counts: DataFrame) -> ToxicityModel:
    """Kneser-Ney ratios of all words with more than ``DISCOUNT`` continuations in a class.

    They are the same however many there are; the number only decides whether tasks hold or join them.
    """
    known = counts.where(F.greatest("ordinary", "toxic") > DISCOUNT)
    left = [F.sum(F.greatest(F.col(c) - DISCOUNT, F.lit(0))).alias(f"kept_{c}") for c in ("ordinary", "toxic")]
    total = counts.agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.sum("both").alias("both"), F.count("*").alias("words"), *left).first()
    if not total.ordinary or not total.toxic:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 0.0)
    sums = total.asDict()
    free = {c: 1 - sums[f"kept_{c}"] / sums[c] for c in ("ordinary", "toxic")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = (np.asarray(batch.column("both")) + 1) / (sums["both"] + sums["words"] + 1)
            p = {c: np.maximum(np.asarray(batch.column(c)) - DISCOUNT, 0) / sums[c] + free[c] * shared for c in free}
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(np.log(p["toxic"] / p["ordinary"]))], names=["word", "ratio"])

    ratios = materialise(known.mapInArrow(run, fields(word=LongType(), ratio=DoubleType())), "ratios")
    unknown = float(np.log(free["toxic"] / free["ordinary"]))
    if ratios.count() > MODEL_WORDS:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), unknown, ratios)
    table = ratios.toPandas()
    hashes = table["word"].to_numpy(dtype=np.int64)
    order = np.argsort(hashes)
    return ToxicityModel(hashes[order], table["ratio"].to_numpy()[order], unknown)


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([word_hash(w) for w in words], dtype=np.uint64).view(np.int64)


def _found(hashes: np.ndarray, known: np.ndarray, ratios: np.ndarray, unknown: float) -> np.ndarray:
    """Ratios of words by hash, from the sorted ``known`` ones."""
    if not len(known):
        return np.full(len(hashes), unknown)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, ratios[at], unknown)


def _measure_joined(df: DataFrame, model: ToxicityModel, text: str, out: str) -> DataFrame:
    """:func:`measure` with the model as a table: each row is joined with the known words of its text."""
    kept = [c for c in df.columns if c.lower() != out.lower()]
    rows = materialise(df.select(*kept).withColumn("_row", F.monotonically_increasing_id()), "measured")
    schema, unknown = StructType([rows.schema[c] for c in kept] + list(fields(**{out: DoubleType()}))), model.unknown

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            for row, value in zip(batch.column("_row").to_pylist(), batch.column(text).to_pylist()):
                found = np.unique(_hashes(words_of(value or "")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row, np.int64)), pa.array(found)], names=["_row", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            values = []
            for value, entries in zip(batch.column(text).to_pylist(), batch.column("_known")):
                known, ratios = (np.asarray(v) for v in entries.values.flatten()) if entries.is_valid else (np.zeros(0, np.int64), np.zeros(0))
                hashes = _hashes(words_of(value or ""))
                values.append(_window_mean(_found(hashes, known, ratios, unknown)) if len(hashes) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(values, pa.float64())], names=schema.names)

    held = rows.select("_row", text).mapInArrow(words, fields(_row=LongType(), word=LongType())).join(model.table, "word")
    held = held.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("word", "ratio"))).alias("_known"))
    return rows.join(held, "_row", "left").select(*kept, "_known").mapInArrow(run, schema)


def measure(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "measure") -> DataFrame:
    """``df`` with the largest window mean of word log-likelihood ratios; 0 without words."""
    if model.table is not None:
        return _measure_joined(df, model, text, out)
    # Tasks take the numbers alone.
    model = ToxicityModel(model.hashes, model.ratios, model.unknown)

    def start():
        cache: dict[str, int] = {}
        ratios = np.zeros(0)

        def work(texts: list[str]) -> list[pa.Array]:
            nonlocal ratios
            if len(cache) > CACHED_WORDS:
                cache.clear()
                ratios = np.zeros(0)
            place = cache.setdefault
            coded = [[place(w, len(cache)) for w in words_of(t)] for t in texts]
            new = list(cache)[len(ratios) :]
            if new:
                ratios = np.concatenate([ratios, _found(_hashes(new), model.hashes, model.ratios, model.unknown)])
            return [pa.array([_window_mean(ratios[c]) if c else 0.0 for c in coded], pa.float64())]

        return work

    return append_columns(df, text, fields(**{out: DoubleType()}), start)


def _window_mean(values: np.ndarray) -> float:
    size = min(WINDOW, len(values))
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return float((sums[size:] - sums[:-size]).max() / size)


def _curve(points: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through counted points, with a slight pull to zero."""
    if not positive.sum() or not negative.sum():
        return 1.0, 0.0
    weights = np.zeros(2)
    x = np.stack([points, np.ones(len(points))], axis=1)
    n = positive + negative
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (positive - n * p) - 1e-2 * weights
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0]), float(weights[1])


def fit(counted: DataFrame, curved: DataFrame, text: str = "text") -> ToxicityModel:
    """Counts from all rows of ``counted``, the curve from all rows of ``curved`` (both with
    ``_label``, see :func:`labelled`). Without both classes every score is the same."""
    model = _ratios(materialise(continuations(counted, text), "continuations"))
    bins = (
        measure(curved.select(text, "_label"), model, text)
        .groupBy(F.round(F.col("measure") * BINS).cast("long").alias("bin"))
        .agg(F.sum("_label").alias("positive"), F.count("*").alias("n"))
        .orderBy("bin")  # sums of the fit do not depend on the order in which tasks end
        .toPandas()
    )
    if len(bins):
        positive = bins["positive"].to_numpy(dtype=float)
        model.slope, model.shift = _curve(bins["bin"].to_numpy(dtype=float) / BINS, positive, bins["n"].to_numpy(dtype=float) - positive)
    return model


def score(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``df`` with score, the probability of the toxic label.

    Null and empty texts are scored like texts without evidence. Whole texts are read; repeated
    rows and other columns pass through, columns named score or measure are replaced, and an
    empty table stays empty.
    """
    kept = [c for c in df.columns if c not in ("score", "measure")]
    curve = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("measure") + F.lit(model.shift))))
    return measure(df.select(*kept), model, text).select(*kept, curve.alias("score"))
