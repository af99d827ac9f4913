"""BPE encoding and decoding by batched merge rounds.

The symbols of many words lie in one flat array. Each round finds the rank of every neighbouring
pair by binary search over the sorted pair keys, takes each word's lowest rank and merges all its
occurrences from left to right. A word leaves the array when no pair of it is known. A learned
vocabulary makes each symbol by one merge, after the merges of its parts, so merging all places of
the lowest rank at once equals merging them one at a time.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ecoframe.llm.chunks import ChunkEncoder
from ecoframe.llm.common import append_columns, fields, gather, ragged

CACHED_CHUNKS = 120_000
SLICE = 1 << 19  # bytes of text encoded at once: symbols and codes take some fifty times that
NO_RANK = np.iinfo(np.int64).max

# Fixed value: the split pattern of the byte-level vocabulary, white space spelled out.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Merge table and token bytes of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        of_char = {c: b for b, c in enumerate(alphabet)}
        self.byte_id = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        raw = [b""] * self.size
        for token, number in vocab.items():
            raw[number] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        for token, number in self.special.items():
            raw[number] = token.encode()
        self.token_length = np.array([len(r) for r in raw], dtype=np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.made = keys[order], order.astype(np.int64), made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == keys, self.pair_rank[place], NO_RANK)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per word) of non-empty words."""
        counts = np.array([len(w) for w in words], dtype=np.int64)
        if not len(counts):
            return np.zeros(0, dtype=np.int64), counts
        symbol = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(counts)), counts)
        rank = np.full(len(symbol), NO_RANK)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.append(starts, len(symbol)))
            of_symbol = np.repeat(least, spans)
            if (least == NO_RANK).any():
                done = of_symbol == NO_RANK
                finished.append((word[done], symbol[done]))
                keep = ~done
                symbol, word, rank, of_symbol = symbol[keep], word[keep], rank[keep], of_symbol[keep]
                if not len(symbol):
                    break
            place = np.flatnonzero(rank == of_symbol)
            # Of overlapping places (the same symbol repeated) every second one merges.
            run = np.maximum.accumulate(np.where(np.diff(place, prepend=-2) > 1, place, 0))
            place = place[(place - run) % 2 == 0]
            symbol[place] = self.made[rank[place]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[place + 1] = False
            moved = np.cumsum(keep)[place] - 1
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            stale = np.zeros(len(symbol) + 1, dtype=bool)
            stale[moved] = stale[moved - 1] = True  # place -1 is the spare last one
            stale = stale[:-1]
            rank[stale] = NO_RANK
            stale[:-1] &= word[:-1] == word[1:]
            stale[-1] = False
            again = np.flatnonzero(stale)
            rank[again] = self.ranks(symbol[again], symbol[again + 1])
        words_of = np.concatenate([w for w, _ in finished])
        ids = np.concatenate([s for _, s in finished])
        # A word finishes in one round, so a stable order restores its symbols.
        order = np.argsort(words_of, kind="stable")
        return ids[order], np.bincount(words_of, minlength=len(counts))

    def encoder(self):
        """Strings to (flat ids, ids per string); special tokens in a string stay whole."""
        split = regex.compile(PATTERN).findall
        special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
            number: dict[str, int] = {}  # of the distinct pieces
            place = number.setdefault
            pieces: list[int] = []
            ends = []
            for text in strings:
                parts = special.split(text) if special and special.search(text) else (text,)
                for part in parts:
                    if part in self.special:
                        pieces.append(-1 - self.special[part])
                    else:
                        for piece in split(part):
                            pieces.append(place(piece, len(number)))
                ends.append(len(pieces))
            flat, counts = self.merge_words([p.encode("utf-8", "replace") for p in number])
            # Special tokens are appended to the distinct pieces, one id each.
            begins = np.cumsum(counts) - counts
            chosen = np.array(pieces, dtype=np.int64)
            flat = np.append(flat, list(self.special.values())).astype(np.int64)
            slot = {n: len(flat) - len(self.special) + k for k, n in enumerate(self.special.values())}
            lengths = np.ones(len(chosen), dtype=np.int64)
            starts = np.empty(len(chosen), dtype=np.int64)
            plain = chosen >= 0
            lengths[plain], starts[plain] = counts[chosen[plain]], begins[chosen[plain]]
            starts[~plain] = [slot[-1 - c] for c in chosen[~plain].tolist()]
            total = np.concatenate([[0], np.cumsum(lengths)])
            per_string = np.diff(total[np.concatenate([[0], np.array(ends, dtype=np.int64)])])
            return gather(flat, starts, lengths), per_string

        return encode

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids; broken byte sequences become U+FFFD."""
        lengths = self.token_length[ids]
        raw = gather(self.token_bytes, self.token_start[ids], lengths).tobytes()
        byte_ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = byte_ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]


@functools.lru_cache(maxsize=1)
def worker_vocabulary(path: str) -> Vocabulary:
    """One per Python worker, shared by the tasks that run in it, as is its encoder."""
    return Vocabulary(path)


@functools.lru_cache(maxsize=1)
def worker_encoder(vocabulary: str) -> ChunkEncoder:
    """One encoder and cache per Python worker, shared by the tasks that run in it."""
    return ChunkEncoder(worker_vocabulary(vocabulary).encoder(), CACHED_CHUNKS)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of each whole text.

    Null and empty texts give an empty list. Repeated rows, any extra columns and null keys pass
    through; a column named like ``ids`` is replaced. Memory per task is bounded by the slice size,
    the longest single text and the chunk cache.
    """

    def start():
        encoder = worker_encoder(vocabulary)

        def work(texts: list[str]) -> list[pa.Array]:
            flat, counts = encoder(texts)
            return [ragged(flat, counts)]

        return work

    return append_columns(df, text, fields(**{ids: ArrayType(IntegerType())}), start, SLICE)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """:func:`decode` of :func:`encode`, slice by slice in one Python worker per task instead of two."""

    def start():
        encoder, vocab = worker_encoder(vocabulary), worker_vocabulary(vocabulary)

        def work(texts: list[str]) -> list[pa.Array]:
            flat, counts = encoder(texts)
            return [ragged(flat, counts), pa.array(vocab.decode(flat, counts), pa.string())]

        return work

    return append_columns(df, text, fields(**{ids: ArrayType(IntegerType()), decoded: StringType()}), start, SLICE)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of each list of ids; a null or empty list gives the empty text.

    A column named like ``text`` is replaced. Ids outside the vocabulary raise an error.
    """
    kept = [f for f in df.schema if f.name.lower() != text.lower()]
    schema = fields(**{**{f.name: f.dataType for f in kept}, text: StringType()})

    def run(batches):
        vocab = worker_vocabulary(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = part.column(ids)
                counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
                flat = np.asarray(lists.flatten(), dtype=np.int64)
                texts = pa.array(vocab.decode(flat, counts), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [texts], names=schema.names)

    return df.mapInArrow(run, schema)


def token_digest(ids: str = "ids", decoded: str = "decoded") -> list[F.Column]:
    """Number of tokens, and hashes of the ids (decimal, joined by commas) and the decoded text."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    ]
