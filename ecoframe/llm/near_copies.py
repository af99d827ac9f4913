"""Groups of texts by the exact Jaccard similarity of their word shingles.

First come the links of the SimHash fingerprints, found by pigeonring filtering (:mod:`simhash`) and
each compared exactly. Their radius of two bits holds copies with slight changes only, a similarity of
0.8 lies some ten bits away. What they leave apart has candidates that share a band of MinHash values:
at a similarity of 0.8 two texts share none of the ``BANDS`` bands with a probability of
(1 - 0.8^5)^28 = 1.5e-5, whatever their length. Each candidate pair is compared exactly as well. Texts
with equal shingle sets are one node, so copies cost nothing.

The nodes of a band are first compared with one of them, the hub: the node whose bands are the
most common, as the text that others were made from keeps the bands which an edit changes. That
joins a group of near copies with a number of comparisons linear in its size. Bands of more than
two nodes that it leaves in several components mostly hold texts with a long passage in common
that are not similar. Their nodes meet a second time by an exact test: of two sets with the
similarity, each has a shingle of the other among its few rarest (all but 80 % of the set, and one
more), and behind the first such shingle both are long enough to reach the overlap. The
parities of their shingles in ``PARITIES`` classes differ in no more classes than there are shingles
in one set alone. Only pairs that pass and lie in different components are compared. No candidate is dropped; what stays square is
the number of pairs of texts that pass these tests without being linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ecoframe.llm.common import append_columns, fields, ragged, slices
from ecoframe.llm.graph import components
from ecoframe.llm.simhash import fingerprint, links as fingerprint_links
from ecoframe.session import materialise

BANDS, ROWS = 28, 5
FACTORS = np.random.default_rng(42).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
BLOCK = 512  # shingles hashed at a time
CACHED_WORDS = 100_000
PARITIES = 512  # a multiple of 64
SETS_BROADCAST = 2_000_000  # nodes with a candidate


class Shingles:
    """Sorted distinct hashes of the word shingles of texts; words parted by ASCII white space, A-Z
    lower-cased. A text with fewer words is one shingle, a text without words has none."""

    def __init__(self, size: int):
        self.size = size
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        known = self.cache
        found = []
        for word in words:
            number = known.get(word)
            if number is None:
                number = known[word] = xxhash.xxh3_64_intdigest(word)
            found.append(number)
        hashes = np.array(found, dtype=np.uint64)
        size = min(self.size, len(hashes))
        n = len(hashes) - size + 1 if size else 0
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            mixed = (mixed ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9) ^ (mixed >> np.uint64(32)))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key per band, equal for two sets if the band's ``ROWS`` MinHash values are."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for begin in range(0, len(short), BLOCK):
        np.minimum(least, np.multiply.outer(short[begin : begin + BLOCK], FACTORS).min(axis=0), out=least)
    values = least.astype(np.uint64).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        keys = (keys ^ values[:, row]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def _parities(shingles: np.ndarray) -> np.ndarray:
    """A bit per class of shingles, set if the class holds an odd number of them."""
    counts = np.bincount((shingles % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def signatures(df: DataFrame, text: str, words: int) -> DataFrame:
    """``df`` with node (a hash of the shingle set), size (of the set), keys (of the bands) and the
    SimHash fingerprint."""

    def start():
        shingles = Shingles(words)

        def work(texts: list[str]) -> list[pa.Array]:
            sets = [shingles(t) for t in texts]
            keys = np.concatenate([band_keys(s) for s in sets])
            nodes = np.array([_node(s) for s in sets], dtype=np.uint64).view(np.int64)
            prints = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            return [pa.array(nodes), sizes, ragged(keys, np.full(len(sets), BANDS)), pa.array(prints)]

        return work

    added = fields(node=LongType(), size=LongType(), keys=ArrayType(LongType()), fingerprint=LongType())
    return append_columns(df, text, added, start)


def _sets(df: DataFrame, text: str, words: int) -> DataFrame:
    """(node, shingles, parities) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in slices(batches, text):
            sets = [shingles(t or "") for t in batch.column(text).to_pylist()]
            nodes = np.array([_node(s) for s in sets], dtype=np.uint64).view(np.int64)
            flat = ragged(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]))
            bits = ragged(np.concatenate([_parities(s) for s in sets]), np.full(len(sets), PARITIES // 64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), flat, bits], names=["node", "shingles", "parities"])

    schema = fields(node=LongType(), shingles=ArrayType(LongType()), parities=ArrayType(LongType()))
    return df.select(text).mapInArrow(run, schema)


def _alike_in_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes (columns node, fingerprint) that join those within SimHash's radius.

    Nodes of one fingerprint are tied to their least, and these least ones where their fingerprints link.
    """
    heads = materialise(nodes.groupBy("fingerprint").agg(F.min("node").alias("head"), F.count("*").alias("n")), "heads")
    equal = nodes.join(heads.where("n > 1"), "fingerprint").where("node <> head")
    left = heads.select(F.col("fingerprint").alias("a"), F.col("head").alias("_a"))
    right = heads.select(F.col("fingerprint").alias("b"), F.col("head").alias("_b"))
    near = fingerprint_links(heads.select("fingerprint")).join(left, "a").join(right, "b")
    return equal.select(F.col("node").alias("a"), F.col("head").alias("b")).unionByName(
        near.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    )


def _verified(pairs: DataFrame, sets: DataFrame, least: float, label: str) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least ``least``."""
    # Written, so that the rows of a node in very many pairs can be split in the joins.
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-pairs")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    near = pairs.join(left, "a").join(right, "b").where(both >= F.lit(least) * (F.size("x") + F.size("y") - both))
    return materialise(near.select("a", "b"), f"{label}-links")


def _alike_in_rare_shingles(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of ``nodes`` (node, size, root) with different roots that can have a
    similarity of ``least``.

    Shingles are put in one order, the rarest among ``nodes`` first. Two sets with that similarity
    share an element of their first ``size - ceil(least * size) + 1``, and from the first shared
    element on neither has fewer elements left than they need in common. A class of different
    parity holds an element of one set alone, of which both sizes leave room for few.
    """
    every = sets.join(nodes, "node").select("node", F.explode("shingles").alias("shingle"))
    common = every.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    # A shingle of one node alone only moves the others back.
    ordered = every.join(common, "shingle").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("ordered")
    )
    alone = F.col("size") - F.size("ordered")
    taken = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1 - alone
    entries = (
        ordered.join(nodes, "node").where(taken > 0).join(sets.select("node", "parities"), "node")
        .select("node", "size", "root", "parities", alone.alias("alone"), F.posexplode(F.slice("ordered", F.lit(1), taken.cast("int"))))
        .select("node", "size", "root", "parities", F.col("col.shingle").alias("shingle"), (F.col("size") - F.col("alone") - F.col("pos")).alias("left"))
    )
    entries = materialise(entries, "rare")
    # Of each shingle, the nodes outside its largest component meet all others.
    shares = entries.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    main = shares.groupBy("shingle").agg(F.max_by("root", "n").alias("main"), F.count("*").alias("roots")).where("roots > 1")
    split = materialise(entries.join(main.select("shingle", "main"), "shingle"), "rare-split")
    words = range(PARITIES // 64)
    outside = split.where("root <> main").select(
        "shingle", F.col("node").alias("a"), F.col("size").alias("m"), F.col("root").alias("p"), F.col("left").alias("i"),
        *[F.col("parities")[k].alias(f"u{k}") for k in words],
    )
    others = split.select(
        "shingle", F.col("node").alias("b"), F.col("size").alias("n"), F.col("root").alias("q"), F.col("left").alias("j"),
        (F.col("root") == F.col("main")).alias("in_main"), *[F.col("parities")[k].alias(f"v{k}") for k in words],
    )
    once = F.col("in_main") | (F.col("a") < F.col("b"))
    total = F.col("m") + F.col("n")
    like_size = F.least("m", "n") >= F.greatest("m", "n") * least - 1e-9
    enough = F.least("i", "j") * (1 + least) >= total * least - 1e-6
    differ = reduce(add, [F.bit_count(F.col(f"u{k}").bitwiseXOR(F.col(f"v{k}"))) for k in words])
    room = differ * (1 + least) <= total * (1 - least) + 1e-6
    return outside.join(others, "shingle").where(F.col("p") != F.col("q")).where(once & like_size & enough & room).select("a", "b")


def groups(df: DataFrame, key: str, text: str, words: int, least: float) -> DataFrame:
    """(key, fingerprint, component_id): the SimHash and the group of each row, named by its least key.

    Rows whose shingle sets have a Jaccard similarity of at least ``least`` are linked, and links
    are transitive. Rows without words are linked with each other only.
    """
    rows = materialise(signatures(df.select(key, text), text, words).select(key, "node", "size", "keys", "fingerprint"), "signatures")
    nodes = materialise(
        rows.groupBy("node").agg(
            F.min(key).alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys"),
            F.min("fingerprint").alias("fingerprint"),
        ),
        "nodes",
    )
    printed = materialise(_alike_in_fingerprint(nodes.select("node", "fingerprint")), "printed")
    entries = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    kept = materialise(entries.join(shared, "key"), "bands")
    weights = materialise(kept.groupBy("node").agg(F.sum("n").alias("weight")), "involved")
    ends = printed.select(F.explode(F.array("a", "b")).alias("node"))
    involved = materialise(weights.select("node").unionByName(ends).distinct(), "compared")
    few = involved.count() <= SETS_BROADCAST
    sets = _sets(df, text, words).join(F.broadcast(involved) if few else involved, "node", "left_semi")
    sets = materialise(sets.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("parities").alias("parities")), "sets")

    links = _verified(printed, sets, least, "print")
    tied = components(links, "tied")
    hubs = kept.join(weights, "node").groupBy("key").agg(F.max_by("node", "weight").alias("hub"))
    starred = kept.join(hubs, "key").where("node <> hub").select("node", "hub").distinct()
    # Nodes that their fingerprints have tied to the hub need no second comparison.
    own = tied.select("node", F.col("root").alias("p"))
    other = tied.select(F.col("node").alias("hub"), F.col("root").alias("q"))
    starred = starred.join(own, "node", "left").join(other, "hub", "left").where(
        F.coalesce("p", "node") != F.coalesce("q", "hub")
    )
    links = links.unionByName(_verified(starred.select(F.col("node").alias("a"), F.col("hub").alias("b")), sets, least, "hub"))
    linked = components(links, "groups").withColumnRenamed("node", "_node")
    # What the hubs leave apart, where a band has more pairs than those with its hub.
    rooted = kept.where("n > 2").join(linked, F.col("node") == F.col("_node"), "left").select(
        "key", "node", "size", F.coalesce("root", "node").alias("root")
    )
    rooted = materialise(rooted, "rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last")
    apart = materialise(rooted.join(several, "key", "left_semi").select("node", "size", "root").distinct(), "apart")
    links = links.unionByName(_verified(_alike_in_rare_shingles(apart, sets, least), sets, least, "rest"))

    linked = components(links, "groups").join(nodes, "node").select("root", "node", "least")
    group = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(group, "root").select("node", "component")
    every = nodes.join(named, "node", "left").select("node", F.coalesce("component", "least").alias("component_id"))
    every = materialise(every, "named")
    return rows.join(every, "node").select(key, "fingerprint", "component_id")
