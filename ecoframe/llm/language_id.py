"""Language identification by segmentation-marginalised unigram models.

Each language is a distribution over the pieces of a fixed public vocabulary. A text's likelihood is
the sum over all its segmentations into pieces. Pieces never cross a word's borders, so the sum
factors into one forward pass per word, and every distinct word is scored once per cache. The
probabilities are fitted by expectation maximisation over word counts of all training rows: each
round is one distributed pass that adds up expected piece counts, whose number is bounded by
vocabulary size times languages.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType

from ecoframe.llm.common import append_columns, fields, slices
from ecoframe.session import materialise

UNKNOWN = "und"
MARK = "▁"  # stands before a word in the vocabulary
MAX_PIECE = 16
ROUNDS = 2
PRIOR_WEIGHT = 2000.0  # expected counts given to the languages' common distribution
FLOOR = 1e-7  # probability of a character that no piece covers
LINEAR_LENGTH = 40  # longer words are summed in logarithms
BLOCK_CHARS = 200_000
CACHED_WORDS = 100_000
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return LETTERS.findall(text.lower())


class Pieces:
    """Piece numbers of substrings, found through rolling hashes."""

    BASE = np.uint64(0x100000001B3)

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        skipped = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(s(i) for s in skipped)]
        names = [n for n in names if len(n) <= MAX_PIECE]
        hashes = np.array([self._hash(n) for n in names], dtype=np.uint64)
        order = np.argsort(hashes)
        self.size = len(names)
        self.keys, self.longest = hashes[order], max(map(len, names))
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self._slot(self.keys)] = True

    def _hash(self, name: str) -> int:
        h = 0
        for c in name:
            h = (h * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of characters of each word with its mark, piece per end place and length).

        -1 where no piece lies; a lone character without a piece is piece ``size``.
        """
        text = "".join(MARK + w for w in words)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        counts = np.array([len(w) + 1 for w in words], dtype=np.int64)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(counts) - counts, counts)
        found = np.full((len(chars), self.longest), -1, dtype=np.int32)
        rolling = chars
        for length in range(1, self.longest + 1):
            rolling = np.append(np.uint64(0), rolling[:-1] * self.BASE) + chars if length > 1 else chars
            may = np.flatnonzero((place >= length - 1) & self.maybe[self._slot(rolling)])
            at = np.minimum(np.searchsorted(self.keys, rolling[may]), self.size - 1)
            hit = self.keys[at] == rolling[may]
            found[may[hit], length - 1] = at[hit]
        alone = found[:, 0]
        alone[alone < 0] = self.size
        return counts, found


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _blocks(words: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
    """Places of words of similar length, at most ``BLOCK_CHARS`` characters (or one word) at once."""
    lengths = np.array([len(w) + 1 for w in words])
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        ends = np.cumsum(lengths[order[start : start + BLOCK_CHARS]])
        stop = start + max(1, int(np.searchsorted(ends, BLOCK_CHARS)))
        cut = order[start:stop]
        linear = lengths[cut] <= LINEAR_LENGTH
        for part, is_linear in ((cut[linear], True), (cut[~linear], False)):
            if len(part):
                yield part, is_linear
        start = stop


def _sweep(table: np.ndarray, counts: np.ndarray, found: np.ndarray, linear: bool, backward: bool) -> np.ndarray:
    """Sums over segmentations up to (or after) each border: an array of borders x columns of
    ``table`` (probabilities if ``linear``, else their logarithms; the last row is for no piece)."""
    n_words, longest = len(counts), found.shape[1]
    first = np.cumsum(counts + 1) - (counts + 1)  # border before a word's first character
    begin = np.cumsum(counts) - counts
    sums = np.full((int((counts + 1).sum()) + longest * 2, table.shape[1]), 0.0 if linear else -np.inf)
    offset = longest  # spare borders on both sides for pieces that reach outside
    sums[offset + (first + counts if backward else first)] = 1.0 if linear else 0.0
    spans = np.arange(1, longest + 1)
    by_length = np.argsort(-counts, kind="stable")
    active = np.searchsorted(-counts[by_length], -np.arange(1, counts.max() + 1), side="right")
    for step in range(int(counts.max())):
        rows = by_length[: active[step]]
        reach = spans[: min(step + 1, longest)]
        if backward:
            border = first[rows] + counts[rows] - step - 1
            ends = begin[rows][:, None] + (counts[rows] - step - 1)[:, None] + reach - 1
            other = border[:, None] + reach
            numbers = found[ends, reach - 1]
        else:
            border = first[rows] + step + 1
            other = border[:, None] - reach
            numbers = found[begin[rows] + step][:, : len(reach)]
        terms = table[numbers], sums[offset + other]
        if linear:
            sums[offset + border] = np.einsum("ijk,ijk->ik", *terms)
        else:
            sums[offset + border] = np.logaddexp.reduce(terms[0] + terms[1], axis=1)
    return sums[offset:]


def log_likelihood(vocabulary: Pieces, probabilities: np.ndarray, words: list[str]) -> np.ndarray:
    """Words x languages: logarithm of the sum over all segmentations."""
    out = np.zeros((len(words), probabilities.shape[1]))
    table = np.vstack([probabilities, np.zeros(probabilities.shape[1])])
    with np.errstate(divide="ignore"):
        logs = np.log(table)
        for part, linear in _blocks(words):
            counts, found = vocabulary.lattice([words[i] for i in part])
            sums = _sweep(table if linear else logs, counts, found, linear, backward=False)
            last = sums[np.cumsum(counts + 1) - 1]
            out[part] = np.log(last) if linear else last
    return out


def expected_counts(vocabulary: Pieces, probabilities: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the weighted words (one language)."""
    total = np.zeros(vocabulary.size + 1)
    table = np.append(probabilities, 0.0)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(table)
        for part, linear in _blocks(words):
            counts, found = vocabulary.lattice([words[i] for i in part])
            used = table if linear else logs
            before = _sweep(used, counts, found, linear, backward=False)[:, 0]
            after = _sweep(used, counts, found, linear, backward=True)[:, 0]
            whole = before[np.cumsum(counts + 1) - 1]
            place, length = np.nonzero(found >= 0)
            word = np.repeat(np.arange(len(counts)), counts)[place]
            border = place + word + 1
            number = found[place, length]
            if linear:
                share = before[border - length - 1] * probabilities[number] * after[border] / whole[word]
            else:
                share = np.exp(before[border - length - 1] + logs[number, 0] + after[border] - whole[word])
            total += np.bincount(number, weights=share * weights[part][word], minlength=len(total))
    return total


@dataclass
class LanguageModel:
    languages: list[str]
    probabilities: np.ndarray  # pieces (and the unknown character) x languages
    log_prior: np.ndarray
    vocabulary: str


def _word_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) over all rows; words of a batch are counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            counts: dict[str, Counter] = {}
            for value, name in zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist()):
                counts.setdefault(name, Counter()).update(words_of(value or ""))
            for name, counter in counts.items():
                columns = [pa.array([name] * len(counter)), pa.array(list(counter)), pa.array(list(counter.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

    counted = df.select(text, lang).mapInArrow(run, fields(lang=StringType(), word=StringType(), n=LongType()))
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", rounds: int = ROUNDS) -> LanguageModel:
    """Learn from every row with a language; rows with a null language are left out."""
    rows = df.where(F.col(lang).isNotNull())
    docs = {r[0]: r[1] for r in rows.groupBy(F.col(lang).alias("lang")).count().collect()}
    languages = sorted(docs)
    size = pieces(vocabulary).size
    model = np.full((size + 1, len(languages)), 1 / size)
    model[size] = FLOOR
    prior = np.log(np.array([docs[x] for x in languages], dtype=float) / max(1, sum(docs.values())))
    if not languages:
        return LanguageModel([], model, prior, vocabulary)
    counts = materialise(_word_counts(rows, text, lang), "word-counts")
    for _ in range(rounds):
        sums = _expectation(counts, vocabulary, languages, model)
        shared = sums.sum(axis=1) + 1.0
        shared /= shared.sum()
        model = (sums + PRIOR_WEIGHT * shared[:, None]) / (sums.sum(axis=0) + PRIOR_WEIGHT)
        model[size] = FLOOR
    return LanguageModel(languages, model, prior, vocabulary)


def _expectation(counts: DataFrame, vocabulary: str, languages: list[str], model: np.ndarray) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pieces(vocabulary)
        total = np.zeros((len(languages), found.size + 1))
        for batch in batches:
            names = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            words = batch.column("word").to_pylist()
            weights = np.asarray(batch.column("n"), dtype=float)
            for k, language in enumerate(languages):
                mine = np.flatnonzero(names == language)
                if len(mine):
                    total[k] += expected_counts(found, model[:, k], [words[i] for i in mine], weights[mine])
        k, piece = np.nonzero(total)
        columns = [pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[k, piece])]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "piece", "n"])

    parts = counts.mapInArrow(run, fields(lang=IntegerType(), piece=IntegerType(), n=DoubleType()))
    summed = parts.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((model.shape[0], len(languages)))
    out[summed["piece"].to_numpy(), summed["lang"].to_numpy()] = summed["n"].to_numpy()
    return out


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score, the posterior probability of that language.

    Texts that are null or have no letter, and all texts under a model without languages, get
    ``und`` and score 0. Ties go to the language that sorts first. Whole texts are read; repeated
    rows and other columns pass through, and columns with the new names are replaced.
    """
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def start():
        vocabulary = pieces(model.vocabulary)
        width = len(model.languages)
        cache: dict[str, int] = {}
        scores = np.zeros((0, width))

        def work(texts: list[str]) -> list[pa.Array]:
            nonlocal scores
            if len(cache) > CACHED_WORDS:
                cache.clear()
                scores = np.zeros((0, width))
            codes: list[int] = []
            ends = [0]
            place = cache.setdefault
            for value in texts:
                codes.extend([place(w, len(cache)) for w in words_of(value)])
                ends.append(len(codes))
            new = list(cache)[len(scores) :]
            if new:
                scores = np.vstack([scores, log_likelihood(vocabulary, model.probabilities, new)])
            running = np.zeros((len(codes) + 1, width))
            np.cumsum(scores[codes], axis=0, out=running[1:])
            ends_at = np.array(ends)
            likelihood = running[ends_at[1:]] - running[ends_at[:-1]] + model.log_prior
            empty = (np.diff(ends_at) == 0) | (width == 0)
            if width:
                best = np.argmax(likelihood, axis=1)
                top = likelihood[np.arange(len(best)), best][:, None]
                score = 1 / np.exp(likelihood - top).sum(axis=1)
            else:
                best, score = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
            best = np.where(empty, width, best)
            return [pa.array(names[best].tolist(), pa.string()), pa.array(np.where(empty, 0.0, score))]

        return work

    return append_columns(df, text, fields(lang_pred=StringType(), score=DoubleType()), start)
