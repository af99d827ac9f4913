"""Benchmark passages in documents, found by the shingles that they must share.

A similarity of 0.8 takes eight ninths of an item's shingles in a window of its length (four fifths
in a shorter document), so every window that could match holds that many places whose shingle is
one of the item's. An index of all shingles of the items gives these places; windows without enough
of them are left out, and none that matches is.
Candidates are then verified on the texts by weighted shingle similarity: the sum of smaller over
the sum of larger shingle counts.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ecoframe.llm.common import append_columns, fields, gather
from ecoframe.llm.toxicity import word_hash

WORDS = 5
SIMILARITY = 0.8
RADIUS = 12
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
ITEMS_PER_PASS = 5_000  # the index holds each shingle of an item in each task
CACHED_WORDS = 100_000
TOKEN = re.compile(r"\w+")

MATCH = StructType([
    StructField("item_id", LongType()), StructField("start", IntegerType()), StructField("n_words", IntegerType()),
    StructField("similarity", DoubleType()),
])


def words_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes; of the whole run if it is shorter."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        mixed = (mixed ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)) ^ (mixed >> np.uint64(32))


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class BlockIndex:
    """Items by window length and the values of their blocks.

    An item is listed under all values within the reach of the block; the reaches and one more per
    block add up to ``RADIUS + 1``. ``group`` is the place of an item's window length.
    """

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        self.prints = prints
        values = prints.view(np.uint16).reshape(-1, BLOCKS).astype(np.int64) + (group << BLOCK_BITS)[:, None]
        size = (int(group.max()) + 1 if len(group) else 0) << BLOCK_BITS
        self.starts, self.items = [], []
        for block in range(BLOCKS):
            reach = (RADIUS - block) // BLOCKS
            changes = (c for k in range(reach + 1) for c in itertools.combinations(range(BLOCK_BITS), k))
            flips = np.array([sum(1 << b for b in c) for c in changes], dtype=np.int64)
            listed = (values[:, block][:, None] ^ flips).ravel()
            item = np.repeat(np.arange(len(prints)), len(flips))
            order = np.argsort(listed, kind="stable")
            self.items.append(item[order])
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(listed, minlength=size))]).astype(np.int32))
        self.listed = [np.diff(s) > 0 for s in self.starts]

    def near(self, prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item): all pairs of one window length within the radius. ``prints`` is flat,
        ``group`` the window length's place for each."""
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS).T
        places, items = [], []
        for value, listed, starts, by_value in zip(blocks, self.listed, self.starts, self.items):
            value = value + (group << BLOCK_BITS)
            at = np.flatnonzero(listed.take(value))
            first = starts.take(value[at])
            n = starts.take(value[at] + 1) - first
            ends = np.cumsum(n)
            place = at.repeat(n)
            item = by_value.take((first - ends + n).repeat(n) + np.arange(len(place)))
            close = np.flatnonzero(np.bitwise_count(prints.take(place) ^ self.prints.take(item)) <= RADIUS)
            places.append(place[close])
            items.append(item[close])
        pair = np.unique(np.concatenate(places) * len(self.prints) + np.concatenate(items))
        return pair // max(1, len(self.prints)), pair % max(1, len(self.prints))


@dataclass
class Items:
    """A benchmark as the tasks need it."""

    ids: list[int]
    lengths: list[int]  # in shingles
    counts: list[Counter]
    keys: np.ndarray  # distinct shingles of all items, sorted
    first: np.ndarray  # where the items of each key start in ``holders``, and where the last end
    holders: np.ndarray
    listed: np.ndarray  # whether a key has these lowest bits

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        ids, shingles = [], []
        for number, text in rows:
            words = np.array([word_hash(w) for w in words_of(text or "")], dtype=np.uint64)
            if number is not None and len(words):
                ids.append(number)
                shingles.append(shingle_hashes(words))
        lengths = [len(s) for s in shingles]
        of = np.repeat(np.arange(len(ids)), lengths)
        flat = np.concatenate(shingles) if shingles else np.zeros(0, dtype=np.uint64)
        order = np.lexsort((of, flat))
        flat, of = flat[order], of[order]
        fresh = np.ones(len(flat), dtype=bool)
        fresh[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
        flat, of = flat[fresh], of[fresh]
        keys, first = np.unique(flat, return_index=True)
        listed = np.zeros(1 << 22, dtype=bool)
        listed[keys & np.uint64(len(listed) - 1)] = True
        return cls(ids, lengths, [Counter(s.tolist()) for s in shingles], keys, np.append(first, len(flat)), of, listed)


def candidates(shingles: np.ndarray, starts: np.ndarray, counts: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(place, length, item) of all windows that hold enough of an item's shingles, over many
    documents; ``length`` is the item's own, or the document's if that is shorter."""
    maybe = np.flatnonzero(items.listed.take(shingles & np.uint64(len(items.listed) - 1)))
    at = np.minimum(np.searchsorted(items.keys, shingles[maybe]), len(items.keys) - 1)
    known = items.keys[at] == shingles[maybe]
    place, at = maybe[known], at[known]
    n = items.first[at + 1] - items.first[at]
    item = gather(items.holders, items.first[at], n)
    place = place.repeat(n)
    doc = np.searchsorted(starts, place, side="right") - 1
    pair, inverse, hits = np.unique(doc * len(items.ids) + item, return_inverse=True, return_counts=True)
    own = np.array(items.lengths)[pair % len(items.ids)]
    length = np.minimum(own, counts[pair // len(items.ids)])
    # A similarity s of n and m shingles takes s (n + m) / (1 + s) common ones.
    needed = np.ceil(SIMILARITY * (own + length) / (1 + SIMILARITY) - 1e-9).astype(np.int64)
    place = place[np.argsort(inverse, kind="stable")]
    ends = np.cumsum(hits)
    found: list[tuple[int, int, int]] = []
    for k in np.flatnonzero(hits >= needed).tolist():
        d, number = divmod(int(pair[k]), len(items.ids))
        size, need, last = int(length[k]), int(needed[k]), int(starts[d] + counts[d] - length[k])
        places = place[ends[k] - hits[k] : ends[k]]
        low = np.maximum(places[need - 1 :] - size + 1, starts[d])
        high = np.minimum(places[: len(places) - need + 1], last)
        windows = {w for a, b in zip(low.tolist(), high.tolist()) for w in range(a, b + 1)}
        found.extend((w, size, number) for w in sorted(windows))
    return found


def verify(shingles: np.ndarray, first: int, end: int, found: list[tuple[int, int, int]], items: Items) -> list[dict]:
    """Matches of one document, each item at its best places that do not overlap."""
    tried: dict[tuple[int, int], float] = {}
    for place, length, item in found:
        tried[item, place] = weighted_similarity(items.counts[item], Counter(shingles[place : place + length].tolist()))
    matches: list[dict] = []
    taken: dict[int, list[int]] = defaultdict(list)
    for (item, at), similarity in sorted(tried.items(), key=lambda x: (-x[1], x[0])):
        own = items.lengths[item]
        if similarity >= SIMILARITY and all(abs(at - other) >= own for other in taken[item]):
            taken[item].append(at)
            words = min(own, end - at) + WORDS - 1 if own > 1 else own
            matches.append({"item_id": items.ids[item], "start": at - first, "n_words": words, "similarity": similarity})
    return sorted(matches, key=lambda m: (m["start"], m["item_id"]))


def find_passages(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "matches") -> DataFrame:
    """``df`` with the benchmark items that each whole text holds, as an array of (item_id, start
    and number of words, similarity).

    Texts and items are compared as lower-cased words; an item under five words is one shingle.
    Items without words or id, null and empty texts match nothing; repeated items all match.
    An empty benchmark or table gives empty arrays or no rows. The benchmark is read by the
    driver in groups of ``ITEMS_PER_PASS`` items, one pass over ``df`` each (one for any usual
    benchmark). Other columns pass through; a column named like ``out`` is replaced.
    """
    rows = [tuple(r) for r in benchmark.select(F.col(item).cast("long"), item_text).sort(item, item_text).toLocalIterator()]
    result = df
    groups = [rows[i : i + ITEMS_PER_PASS] for i in range(0, len(rows), ITEMS_PER_PASS)] or [[]]
    for k, group in enumerate(groups):
        result = _one_pass(result, group, text, out if k == 0 else f"_{out}_{k}")
        if k:
            result = result.withColumn(out, F.concat(out, f"_{out}_{k}")).drop(f"_{out}_{k}")
    return result


def _one_pass(df: DataFrame, rows: list[tuple[int, str]], text: str, out: str) -> DataFrame:
    def start():
        items = Items.of(rows)
        cache: dict[str, int] = {}
        hashes = np.zeros(0, dtype=np.uint64)

        def work(texts: list[str]) -> list[pa.Array]:
            nonlocal hashes
            if len(cache) > CACHED_WORDS:
                cache.clear()
                hashes = np.zeros(0, dtype=np.uint64)
            place = cache.setdefault
            coded = [[place(w, len(cache)) for w in words_of(t)] for t in texts]
            new = list(cache)[len(hashes) :]
            hashes = np.concatenate([hashes, np.array([word_hash(w) for w in new], dtype=np.uint64)])
            per_doc = [shingle_hashes(hashes[c]) for c in coded]
            counts = np.array([len(s) for s in per_doc], dtype=np.int64)
            starts = np.cumsum(counts) - counts
            flat = np.concatenate(per_doc) if per_doc else np.zeros(0, dtype=np.uint64)
            by_doc = defaultdict(list)
            if items.ids and len(flat):
                doc_of = np.repeat(np.arange(len(counts)), counts)
                for hit in candidates(flat, starts, counts, items):
                    by_doc[int(doc_of[hit[0]])].append(hit)
            matches = [
                verify(flat, int(starts[d]), int(starts[d] + counts[d]), by_doc[d], items) if d in by_doc else [] for d in range(len(texts))
            ]
            return [pa.array(matches, pa.list_(MATCH_ARROW))]

        return work

    return append_columns(df, text, fields(**{out: ArrayType(MATCH)}), start)


MATCH_ARROW = pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64())])


def remove_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the documents that hold a benchmark item."""
    return find_passages(df, benchmark, text, out="_matches").where(F.size("_matches") == 0).drop("_matches")
