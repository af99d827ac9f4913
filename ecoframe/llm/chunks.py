"""Byte-level tokenization by cached chunks between single spaces.

The split pattern of a byte-level vocabulary attaches one space to the word after it, and no token
crosses such a space when both its neighbours are visible characters. A text of that form is
therefore encoded chunk by chunk, and each distinct chunk only once per task and cache
generation. Other texts (runs of white space, a space beside a line end) are encoded whole.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np

from ecoframe.llm.common import gather

ODD = -1

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class _Codes(dict):
    """Chunk to code; new chunks are queued for encoding."""

    def __init__(self, queue: list[str], prefix: str):
        super().__init__()
        self.queue, self.prefix = queue, prefix

    def __missing__(self, chunk: str) -> int:
        odd = self.prefix and (not chunk or chunk[0].isspace() or chunk[-1].isspace())
        code = ODD if odd else len(self.queue)
        if not odd:
            self.queue.append(self.prefix + chunk)
        self[chunk] = code
        return code


class ChunkEncoder:
    """Texts to token ids with an encoder of distinct strings and a bounded cache.

    ``encode`` maps strings to (flat ids, ids per string). Once the cache holds more than
    ``limit`` chunks, those seen fewer than three times are dropped (all of them, if that is not
    enough), so memory does not grow with the input.
    """

    def __init__(self, encode: Encoder, limit: int):
        self.encode, self.limit = encode, limit
        self.queue: list[str] = []
        self._reset({}, {})
        self.flat = np.zeros(0, dtype=np.int32)
        self.counts = np.zeros(0, dtype=np.int64)
        self.hits = np.zeros(0, dtype=np.int64)

    def _reset(self, first: dict[str, int], later: dict[str, int]) -> None:
        self.queue.clear()
        self.first, self.later = _Codes(self.queue, ""), _Codes(self.queue, " ")
        self.first.update(first)
        self.later.update(later)
        self.queue.extend([""] * (len(first) + len(later)))
        self.done = len(self.queue)

    def _shrink(self) -> None:
        common = self.hits >= 3
        if common.sum() > self.limit // 2:
            common[:] = False
        begins = np.cumsum(self.counts) - self.counts
        self.flat = gather(self.flat, begins[common], self.counts[common])
        self.counts, self.hits = self.counts[common], np.zeros(int(common.sum()), dtype=np.int64)
        new = (np.cumsum(common) - 1).tolist()
        kept = [{k: new[c] for k, c in codes.items() if c != ODD and common[c]} for codes in (self.first, self.later)]
        self._reset(*kept)

    def _encode_new(self) -> None:
        if self.done == len(self.queue):
            return
        ids, counts = self.encode(self.queue[self.done :])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32, copy=False)])
        self.counts = np.concatenate([self.counts, counts])
        self.hits = np.concatenate([self.hits, np.zeros(len(counts), dtype=np.int64)])
        for place in range(self.done, len(self.queue)):
            self.queue[place] = ""
        self.done = len(self.queue)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text)."""
        if self.done > self.limit:
            self._shrink()
        codes: list[int] = []
        ends: list[int] = []
        later = self.later.__getitem__
        for text in texts:
            begin = len(codes)
            if text:
                head, *tail = text.split(" ")
                if head and head[-1].isspace() and tail:
                    codes.append(self.first[text])
                else:
                    codes.append(self.first[head])
                    codes.extend(map(later, tail))
                    if ODD in codes[begin:]:
                        del codes[begin:]
                        codes.append(self.first[text])
            ends.append(len(codes))
        return self._collect(codes, ends)

    def _collect(self, codes: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of coded chunks; ``ends`` closes the chunks of each text."""
        self._encode_new()
        chosen = np.array(codes, dtype=np.int64)
        self.hits += np.bincount(chosen, minlength=self.done)
        begins = np.cumsum(self.counts) - self.counts
        lengths = self.counts[chosen]
        totals = np.concatenate([[0], np.cumsum(lengths)])
        per_text = np.diff(totals[np.concatenate([[0], np.array(ends, dtype=np.int64)])])
        return gather(self.flat, begins[chosen], lengths), per_text


class WordEncoder(ChunkEncoder):
    """Texts to ids for vocabularies that drop white space: blanks and line feeds only part words."""

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.done > self.limit:
            self._shrink()
        codes: list[int] = []
        ends: list[int] = []
        word = self.first.__getitem__
        for text in texts:
            codes.extend(map(word, text.replace("\n", " ").split(" ")))
            ends.append(len(codes))
        return self._collect(codes, ends)


class PieceEncoder(ChunkEncoder):
    """Texts to ids through the pieces that the split pattern makes, which no token crosses.

    There are far fewer distinct pieces than chunks. ``odd`` encodes texts that are not plain.
    """

    def __init__(self, encode: Encoder, split: re.Pattern, limit: int, odd: Encoder, lower: bool = False):
        super().__init__(encode, limit)
        self.split, self.odd, self.lower = split, odd, lower

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.done > self.limit:
            self._shrink()
        codes: list[int] = []
        ends: list[int] = []
        odd: list[str] = []
        places = []
        piece, cuts = self.first.__getitem__, self.split.findall
        for place, text in enumerate(texts):
            if is_plain(text):
                codes.extend(map(piece, cuts(text.lower() if self.lower else text)))
            else:
                odd.append(text)
                places.append(place)
            ends.append(len(codes))
        flat, counts = self._collect(codes, ends)
        if not odd:
            return flat, counts
        odd_flat, odd_counts = self.odd(odd)
        starts = np.cumsum(counts) - counts
        starts[places], counts[places] = len(flat) + np.cumsum(odd_counts) - odd_counts, odd_counts
        return gather(np.concatenate([flat, odd_flat]), starts, counts), counts


# The alphabet that a byte-level vocabulary is written in.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_ALPHABET = {b: chr(b) if b in _VISIBLE else chr(256 + b - sum(v < b for v in _VISIBLE)) for b in range(256)}

# Characters that normal form, case and the classes of the split patterns treat alike in every Unicode
# version; texts with others, or with what could be a special token, take all steps of the library.
_PLAIN = [*range(0x20, 0x7F), *range(0xA0, 0x130), *range(0x131, 0x250), *range(0x2010, 0x2028)]
LETTERS, NUMBERS = (re.escape("".join(chr(c) for c in _PLAIN if unicodedata.category(chr(c))[0] == kind)) for kind in "LN")
PLAIN = re.compile(f"[\t\n\r{re.escape(''.join(map(chr, _PLAIN)))}]*")


def is_plain(text: str) -> bool:
    return "<|" not in text and PLAIN.fullmatch(text) is not None


def library(vocabulary: str):
    """The tokenizer itself, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def string_encoder(tokenizer) -> Encoder:
    """Any strings to ids by all steps of the library."""

    def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        return _flat(lists)

    return encode


def piece_encoder(tokenizer) -> Encoder:
    """Pieces of plain strings to ids by the library's model alone: the other steps leave them as they are."""
    merge = tokenizer.model.tokenize

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = []
        for piece in pieces:
            if piece.isascii() and piece.isprintable():
                written = piece.replace(" ", BYTE_ALPHABET[32])
            else:
                written = piece.encode().decode("latin-1").translate(BYTE_ALPHABET)
            lists.append([t.id for t in merge(written)])
        return _flat(lists)

    return encode


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int64, count=int(counts.sum())), counts
