"""A bidirectional FM-index over a delimited word list, and its search scheme for one error.

The text is every word between delimiters. Two rank tables, of the text and of the text reversed,
keep the interval of one pattern in both suffix orders, so a pattern can grow at either end. With
one error allowed, one half of the pattern is exact: each half is matched first and extended over the
other one, where a single inserted, deleted or replaced character is tried at every place. All
patterns move together, one character a step, as numpy arrays.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

END, DELIMITER, FIRST = 0, 1, 2  # symbols: of the text's end, between words, the first character
BLOCK = 64


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start places of the sorted suffixes, by doubling of the compared length."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(np.diff(text[order]) != 0)])
    width = 1
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        width *= 2
    return order


class Ranks:
    """How many of the first i symbols are smaller than c, for all c at once.

    Per block of 64 symbols and per c: the count before the block, and the block's symbols below c as bits.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int):
        blocks = len(symbols) // BLOCK + 1
        padded = np.full(blocks * BLOCK, alphabet, dtype=np.int64)
        padded[: len(symbols)] = symbols
        self.alphabet = alphabet
        self.bits = np.zeros((blocks, alphabet + 1), dtype=np.uint64)
        for c in range(alphabet + 1):
            below = np.packbits((padded < c).reshape(blocks, BLOCK), axis=1, bitorder="little")
            self.bits[:, c] = below.view("<u8").ravel()
        full = np.bitwise_count(self.bits).astype(np.int32)
        self.before = np.cumsum(full, axis=0, dtype=np.int32) - full

    def below(self, places: np.ndarray) -> np.ndarray:
        """Row i: counts among the first ``places[i]`` symbols, a column per c."""
        block, rest = places // BLOCK, (places % BLOCK).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.bits[block] & mask[:, None])

    def below_of(self, places: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Counts of symbols smaller than ``c[i]`` among the first ``places[i]``."""
        block, rest = places // BLOCK, (places % BLOCK).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[block, c] + np.bitwise_count(self.bits[block, c] & mask)


class Interval(NamedTuple):
    """Rank intervals of one pattern each: where they start in the order of the text (0) and of the
    reversed text (1), and their common size."""

    start: tuple[np.ndarray, np.ndarray]
    size: np.ndarray

    def pick(self, chosen: np.ndarray) -> Interval:
        return Interval((self.start[0][chosen], self.start[1][chosen]), self.size[chosen])


class WordIndex:
    """The index of distinct non-empty words."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.characters = np.unique(points[points != 0])
        self.alphabet = FIRST + len(self.characters)
        text = np.append(self.code(points), END)
        self.words_before = np.cumsum(text == DELIMITER) - 1
        self.firsts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.alphabet))])
        self.order = suffix_order(text)
        backwards = np.append(text[-2::-1], END)
        self.ranks = tuple(Ranks(t[order - 1], self.alphabet) for t, order in ((text, self.order), (backwards, suffix_order(backwards))))
        self.length = len(text)

    def code(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; 0 is the delimiter, characters of no word get ``alphabet``."""
        place = np.minimum(np.searchsorted(self.characters, points), max(0, len(self.characters) - 1))
        known = self.characters[place] == points if len(self.characters) else np.zeros(len(points), dtype=bool)
        return np.where(points == 0, DELIMITER, np.where(known, FIRST + place, self.alphabet)).astype(np.int64)

    def whole(self, n: int) -> Interval:
        """Intervals of ``n`` empty patterns."""
        zero = np.zeros(n, dtype=np.int64)
        return Interval((zero, zero), np.full(n, self.length, dtype=np.int64))

    def extend(self, at: Interval, c: np.ndarray, side: int) -> Interval:
        """Patterns grown by one symbol, on the left (side 0) or on the right (side 1)."""
        known = c < self.alphabet
        symbol = np.where(known, c, 0)
        ranks, near, far = self.ranks[side], at.start[side], at.start[1 - side]
        low, high = ranks.below_of(near, symbol), ranks.below_of(near + at.size, symbol)
        low_1, high_1 = ranks.below_of(near, symbol + 1), ranks.below_of(near + at.size, symbol + 1)
        return self._interval(side, self.firsts[symbol] + low_1 - low, far + high - low, np.where(known, (high_1 - high) - (low_1 - low), 0))

    @staticmethod
    def _interval(side: int, near: np.ndarray, far: np.ndarray, size: np.ndarray) -> Interval:
        return Interval((near, far) if side == 0 else (far, near), size)

    def branches(self, at: Interval, side: int) -> tuple[np.ndarray, np.ndarray, Interval]:
        """(pattern, symbol, interval) of every non-empty growth by a character."""
        ranks, near, far = self.ranks[side], at.start[side], at.start[1 - side]
        low, high = ranks.below(near), ranks.below(near + at.size)
        sizes = np.diff(high - low, axis=1)
        row, symbol = np.nonzero(sizes[:, FIRST:])
        symbol += FIRST
        smaller, before = (high - low)[row, symbol], (low[row, symbol + 1] - low[row, symbol])
        return row, symbol, self._interval(side, self.firsts[symbol] + before, far[row] + smaller, sizes[row, symbol].astype(np.int64))

    def word_numbers(self, found: Interval) -> np.ndarray:
        """Numbers of the words that delimited patterns stand for."""
        return self.words_before[self.order[found.start[0]]]

    def one_error(self, patterns: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) numbers of words one edit away, with the edit outside the exact half.

        Side 1: the first half is exact, grown to the left from its middle up to the delimiter, then the
        pattern grows to the right with the error. Side 0 is the mirror image. An edit that could be
        read in several places counts at the last of them in the direction of growth only.
        """
        points = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), dtype="<u4") for p in patterns]
        exact_parts, rest_parts = [], []
        for p in points:
            half = len(p) // 2
            # Both parts are read away from the middle and end with the delimiter.
            left, right = np.append(p[:half][::-1], 0), np.append(p[half:], 0)
            exact_parts.append(left if side else right)
            rest_parts.append(right if side else left)
        exact, rest = _Strings(self, exact_parts), _Strings(self, rest_parts)
        who = np.arange(len(patterns))
        at = self.whole(len(patterns))
        for step in range(int(exact.counts.max(initial=0))):
            grown = self.extend(at, exact.symbol(who, step), 1 - side)
            over = step >= exact.counts[who]
            at = Interval(tuple(np.where(over, a, b) for a, b in zip(at.start, grown.start)), np.where(over, at.size, grown.size))
            alive = at.size > 0
            who, at = who[alive], at.pick(alive)
        # Without error so far, all at the same step; those with an error go on from their own place.
        erring: list[tuple[np.ndarray, np.ndarray, Interval]] = []
        for step in range(int(rest.counts.max(initial=0))):
            inside = step < rest.counts[who]
            who, at = who[inside], at.pick(inside)
            if not len(who):
                break
            symbol = rest.symbol(who, step)
            last = step == rest.counts[who] - 1
            row, other, grown = self.branches(at, side)
            differs = other != symbol[row]
            row, grown = row[differs], grown.pick(differs)
            erring.append((who[row], np.full(len(row), step), grown))  # inserted
            replaced = ~last[row]
            erring.append((who[row][replaced], np.full(int(replaced.sum()), step + 1), grown.pick(replaced)))
            left_out = ~last
            left_out[left_out] = rest.symbol(who[left_out], step + 1) != symbol[left_out]
            erring.append((who[left_out], np.full(int(left_out.sum()), step + 1), at.pick(left_out)))
            at = self.extend(at, symbol, side)
            alive = at.size > 0
            who, at = who[alive], at.pick(alive)
        none = np.zeros(0, dtype=np.int64)
        if not erring:
            return none, none
        who, place = np.concatenate([e[0] for e in erring]), np.concatenate([e[1] for e in erring])
        at = Interval(tuple(np.concatenate([e[2].start[k] for e in erring]) for k in (0, 1)), np.concatenate([e[2].size for e in erring]))
        found_who, found_word = [none], [none]
        while len(who):
            at = self.extend(at, rest.symbol(who, place), side)
            place = place + 1
            alive = at.size > 0
            done = alive & (place == rest.counts[who])
            found_who.append(who[done])
            found_word.append(self.word_numbers(at.pick(done)))
            alive &= ~done
            who, place, at = who[alive], place[alive], at.pick(alive)
        return np.concatenate(found_who), np.concatenate(found_word)


class _Strings:
    """Symbols of many strings in one flat array."""

    def __init__(self, index: WordIndex, parts: list[np.ndarray]):
        self.counts = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
        self.flat = np.append(index.code(flat), DELIMITER)

    def symbol(self, who: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        return self.flat[np.minimum(self.starts[who] + place, len(self.flat) - 1)]


def near_words(words: list[str], patterns: list[str], side: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, word) numbers of all pairs one edit apart whose first (side 1) or second (side 0) halves agree."""
    index = WordIndex(words)
    found = [index.one_error(patterns[b : b + block], side) for b in range(0, len(patterns), block)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    who = np.concatenate([w + b * block for b, (w, _) in enumerate(found)])
    return who, np.concatenate([f for _, f in found])
