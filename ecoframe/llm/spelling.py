"""Spelling variants: words one edit apart, and the frequent form that a rare word leads to.

Two words one edit apart share a half of either exactly: the first, or the second. So every word is
listed under the halves it could share, words of the same halves are dealt to the same shard, and
each shard searches an FM-index of its words (:mod:`ecoframe.llm.fm_index`). Halves that very many
words share are cut into several shards, each of which sees all of their patterns.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from ecoframe.llm.common import fields, slices
from ecoframe.llm.fm_index import near_words
from ecoframe.session import materialise, release

MIN_LENGTH, MIN_COUNT, MIN_RATIO = 7, 2, 10
SHARD_WORDS = 16_384  # listed words of a shard
HOT_WORDS = 8_192  # words of one half in one shard
HELD_WORDS = 300_000  # counted before a task puts out partial counts
DAMAGE = 31


def count_words(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, damage: int | None = None
) -> DataFrame:
    """(word, n): how often each word of at least ``min_length`` code points occurs in all whole texts.

    Words are the maximal runs of Latin letters (with U+00C0 to U+00FF), A-Z lower-cased. With ``damage``,
    a run whose checksum with the document's key is divisible by it loses one letter, which plants
    spelling errors. Null and empty texts have no words, a null key reads as empty text. Words are counted
    within tasks first, so a very frequent one is a row per task.
    """
    runs = regex.compile(rf"[A-Za-zÀ-ÿ]{{{min_length},}}").findall
    schema = fields(word=StringType(), n=LongType())

    def batch_of(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in slices(batches, text):
            for doc, value in zip(batch.column("_key").to_pylist(), batch.column(text).to_pylist()):
                if not value:
                    continue
                start = zlib.crc32(f"{doc or ''}:".encode())
                # Lower-casing bytes leaves all but A-Z alone.
                for word, n in Counter(runs(value.encode().lower().decode())).items():
                    if damage and (h := zlib.crc32(word.encode(), start)) % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    held[word] = held.get(word, 0) + n
            if len(held) > HELD_WORDS:
                yield batch_of(held)
                held = {}
        if held:
            yield batch_of(held)

    partial = df.select(F.col(key).cast("string").alias("_key"), text).mapInArrow(run, schema)
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _halves(word: Column, length: Column) -> Column:
    """The halves under which a word is listed: of patterns one shorter, as long, and one longer.

    ``asked`` marks the two halves of the word's own pattern.
    """
    firsts = [F.floor((length + d) / 2).cast("int") for d in (-1, 0, 1)]
    seconds = [(length + d - F.floor((length + d) / 2)).cast("int") for d in (-1, 0, 1)]
    sides = F.concat(
        F.transform(F.array_distinct(F.array(*firsts)), lambda n: F.struct(F.lit(1).alias("side"), F.left(word, n).alias("half"), (n == firsts[1]).alias("asked"))),
        F.transform(F.array_distinct(F.array(*seconds)), lambda n: F.struct(F.lit(0).alias("side"), F.right(word, n).alias("half"), (n == seconds[1]).alias("asked"))),
    )
    return F.filter(sides, lambda s: F.length(s["half"]) > 0)


def neighbours(words: DataFrame, shard_words: int = SHARD_WORDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """(word, n_near, near, near_n) of every word that has near words.

    ``words`` (word, n) holds each word once. Two words are near if they differ by one inserted,
    deleted or replaced code point. ``near`` is the near word with the largest ``n``, ties to the
    smallest in code-point order. Null and one-letter words have no near words. A half that more than
    ``hot_words`` words share is cut; no word is left out.
    """
    known = words.select("word", F.col("n").cast("long").alias("n")).where(F.length("word") > 1)
    listed = known.withColumn("h", F.explode(_halves(F.col("word"), F.length("word")))).select("word", "n", "h.*")
    total = known.count()
    shards = max(1, -(-4 * total // shard_words))
    crowded = (
        listed.groupBy("side", "half").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot_words)
        .select("side", "half", F.ceil(F.col("c") / hot_words).cast("int").alias("cuts"))
    )
    dealt = listed.join(crowded, ["side", "half"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("cuts").cast("long")).cast("int")
    # A pattern visits all cuts of its half; the word itself is indexed in one of them.
    visits = F.when(F.col("asked"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array(own))
    rows = dealt.withColumn("own", own).withColumn("cut", F.explode(visits)).select(
        "word", "n", "side", F.length("half").alias("size"), "asked", (F.col("cut") == F.col("own")).alias("indexed"),
        F.pmod(F.xxhash64("side", "half", "cut"), F.lit(shards)).cast("int").alias("shard"),
    )
    schema = fields(word=StringType(), n_near=LongType(), near=StringType(), near_n=LongType())

    def search(table: pa.Table) -> pa.Table:
        parts = [_search_side(table.filter(pc.equal(table["side"], side)), side) for side in (0, 1)]
        return pa.table([pa.array([v for p in parts for v in p[k]], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], names=schema.names)

    found = rows.groupBy("shard").applyInArrow(search, schema)
    # The smallest of (-n, word) is the nearest; UTF-8 order is code-point order.
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.near", "b.near_n")


def _search_side(table: pa.Table, side: int) -> tuple[list, list, list, list]:
    indexed = table.filter(table["indexed"])
    counts = dict(zip(*[indexed[c].to_pylist() for c in ("word", "n")]))
    # In code-point order, so that the first of the largest counts is the wanted one.
    words = sorted(counts)
    patterns = sorted(set(table.filter(table["asked"])["word"].to_pylist()))
    if not words or not patterns:
        return [], [], [], []
    who, word = near_words(words, patterns, side)
    # A pair counts where the word is indexed under the pattern's half, which is in one shard only. Pairs
    # that agree in both halves count as agreeing in the first.
    listed = set(zip(*[indexed[c].to_pylist() for c in ("word", "size")]))
    keep = np.zeros(len(who), dtype=bool)
    for k, (p, w) in enumerate(zip(who.tolist(), word.tolist())):
        pattern, found = patterns[p], words[w]
        half = len(pattern) // 2
        keep[k] = (found, half if side else len(pattern) - half) in listed and not (side == 0 and found.startswith(pattern[:half]))
    who, word = who[keep], word[keep]
    n = np.array([counts[w] for w in words], dtype=np.int64)
    order = np.lexsort((word, -n[word], who))
    who, word = who[order], word[order]
    first = np.flatnonzero(np.diff(who, prepend=-1))
    near = np.bincount(who, minlength=len(patterns))[who[first]]
    return [patterns[p] for p in who[first].tolist()], near.tolist(), [words[w] for w in word[first].tolist()], n[word[first]].tolist()


def group_variants(words: DataFrame, min_ratio: int = MIN_RATIO) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every row of ``words`` (word, n), each word once.

    ``form`` is the near word of the largest count if that is at least ``min_ratio`` times the word's
    own, else null. ``root`` is where following forms ends. Counts grow by the ratio along forms, so
    chains are short; they are halved until none is left. An empty table gives an empty result.
    """
    if min_ratio < 2:
        raise ValueError("min_ratio must be at least 2, or forms could lead in circles")
    kept = materialise(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = neighbours(kept).withColumnRenamed("word", "_word")
    joined = kept.join(near, F.col("word") == F.col("_word"), "left")
    form = F.when(F.col("near_n") >= min_ratio * F.col("n"), F.col("near"))
    judged = materialise(
        joined.select("word", "n", form.alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                      F.when(form.isNotNull(), F.col("near_n")).alias("form_n")),
        "forms",
    )
    # Only words with a form move: each step replaces the root by the root's root.
    roots = materialise(judged.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        stepped = roots.join(ahead, F.col("root") == F.col("_at"), "left")
        moved = materialise(
            stepped.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots"
        )
        going = not moved.where("_moved").isEmpty()
        release(roots)
        roots = moved
        if not going:
            break
    found = roots.select(F.col("word").alias("_word"), F.col("root"))
    release(kept)
    return judged.join(found, F.col("word") == F.col("_word"), "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n"
    )
