"""SimHash near-duplicates by pigeonring filtering.

The 64 bits of a fingerprint form a ring of 16 segments of four bits. If two fingerprints differ
in at most two bits, some chain of consecutive segments starts at a place from which the
differences stay within budget: after ``l`` segments at most ``2 * l / 16`` of them. For the first
seven segments that budget is below one, so a candidate pair shares 28 consecutive bits: these are
the keys. The rest of the chain is tested on each pair before the whole distance.

Equal fingerprints are one node, so copies cost nothing. A key held by very many different
fingerprints would make too many pairs; there, every fingerprint is listed under itself and under
each of its one-bit changes outside the key. Two members share such an entry exactly when they
differ in at most two bits, so linking each entry to its least member keeps every component with
a number of rows that is linear in the group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ecoframe.llm.common import append_columns, fields
from ecoframe.llm.graph import components
from ecoframe.session import materialise

WORDS = 3
SEED = 42
RADIUS = 2
SEGMENTS = 16
WIDTH = 64 // SEGMENTS
FREE = (SEGMENTS - 1) // RADIUS  # segments of a chain with no difference at all
LARGE_BUCKET = 32


def fingerprint(text: str) -> int:
    """SimHash of word shingles, as an unsigned number; 0 without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(WORDS, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 65_536):
        rows = hashes[part : part + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each whole text as a signed 64-bit number.

    A-Z are lower-cased; words are parted by ASCII white space. Null, empty and blank texts have
    fingerprint 0. A column named like ``out`` is replaced.
    """

    def start():
        def work(texts: list[str]) -> list[pa.Array]:
            found = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
            return [pa.array(found.view(np.int64))]

        return work

    return append_columns(df, text, fields(**{out: LongType()}), start)


def _rotated(column: str, segment: F.Column) -> F.Column:
    """The fingerprint turned left so that ``segment`` comes first."""
    by = segment * WIDTH
    turned = F.call_function("shiftleft", F.col(column), by).bitwiseOR(
        F.call_function("shiftrightunsigned", F.col(column), F.lit(64) - by)
    )
    return F.when(segment == 0, F.col(column)).otherwise(turned)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): pairs of different fingerprints (column fingerprint, distinct) that join exactly the
    fingerprints within ``RADIUS`` differing bits of each other, directly or through a shared
    neighbour of the same bucket."""
    key_bits = FREE * WIDTH
    ring = prints.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("segment"))
    ring = ring.withColumn("turned", _rotated("fingerprint", F.col("segment")))
    entries = ring.select(
        "segment", "turned", F.shiftrightunsigned("turned", 64 - key_bits).cast("int").alias("key")
    )
    shared = entries.groupBy("segment", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Few keys are shared at all, so what follows is small against the entries.
    kept = materialise(entries.join(shared, ["segment", "key"]), "ring")

    few = kept.where(F.col("n") <= LARGE_BUCKET).drop("n")
    left = few.select("segment", "key", F.col("turned").alias("x"))
    right = few.select("segment", "key", F.col("turned").alias("y"))
    pairs = left.join(right, ["segment", "key"]).where("x < y")
    difference = pairs.withColumn("d", F.col("x").bitwiseXOR(F.col("y")))
    for length in range(FREE + 1, SEGMENTS + 1):
        budget = RADIUS * length // SEGMENTS
        if length < SEGMENTS and RADIUS * (length + 1) // SEGMENTS == budget:
            continue  # a longer chain has the same budget
        head = F.shiftrightunsigned("d", 64 - WIDTH * length) if length < SEGMENTS else F.col("d")
        difference = difference.where(F.bit_count(head) <= budget)
    near = difference.select("segment", F.col("x").alias("a"), F.col("y").alias("b"))

    # Large buckets: an entry per fingerprint and per one-bit change outside the shared key.
    changes = F.array(F.lit(0).cast("long"), *[F.lit(1 << bit).cast("long") for bit in range(64 - key_bits)])
    stars = kept.where(F.col("n") > LARGE_BUCKET).select(
        "segment", "turned", F.explode(changes).alias("change")
    ).select("segment", "turned", F.col("turned").bitwiseXOR(F.col("change")).alias("entry"))
    hubs = stars.groupBy("segment", "entry").agg(F.min("turned").alias("hub"), F.count("*").alias("n")).where("n > 1")
    spokes = stars.join(hubs, ["segment", "entry"]).where("turned <> hub").select(
        "segment", F.col("hub").alias("a"), F.col("turned").alias("b")
    ).distinct()

    back = (F.lit(SEGMENTS) - F.col("segment")) % SEGMENTS
    found = near.unionByName(spokes)
    return found.select(
        *[_rotated(c, back).alias(c) for c in ("a", "b")]
    ).distinct()


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, min_similarity: float | None = None
) -> DataFrame:
    """(key, fingerprint, component_id): the group of each row, named by its least key.

    With ``min_similarity``, a link needs that exact Jaccard similarity of the shingles of ``words`` words.
    The links of fingerprints are compared first; as a radius of bits that holds a similarity of 0.8
    leaves pigeonring keys no bits, MinHash bands add those beyond it (see :func:`near_copies.groups`).

    Rows whose fingerprints differ in at most two bits are linked, and links are transitive. Rows
    without words have fingerprint 0 and are linked like any other. Repeated rows and repeated
    keys are kept, one result row each; a null key gets the least non-null key of its group (null
    if it has none). An empty table gives an empty result. Other columns are not read.
    """
    if min_similarity is not None:
        from ecoframe.llm import near_copies

        return near_copies.groups(df, key, text, words, min_similarity)
    if words != WORDS:
        raise ValueError(f"Fingerprints are of {WORDS} words")
    prints = materialise(fingerprints(df.select(key, text), text).select(key, "fingerprint"), "fingerprints")
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min(key).alias("least")), "nodes")
    edges = links(nodes.select("fingerprint"))
    linked = components(edges, "groups").join(nodes, F.col("node") == nodes.fingerprint).select("node", "root", "least")
    # Only fingerprints with a link can have another's key; the rest name their own least one.
    group = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(group, "root").select(F.col("node").alias("fingerprint"), "component")
    every = nodes.join(named, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "least").alias("component_id")
    )
    # Written, so that the rows of a fingerprint with very many copies can be split in the join.
    every = materialise(every, "named")
    return prints.join(every, "fingerprint").select(key, "fingerprint", "component_id")


def hexadecimal(column: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
