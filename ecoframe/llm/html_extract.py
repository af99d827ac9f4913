"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks. A bidirectional LSTM in numpy reads, for each block, a
hashed vector of its tag path, a hashed vector of its words and a few measures of length and links,
and labels every block with the whole page as context. It is fitted on a bounded sample of pages
that mark their article themselves, and on variations of them: other element names around the
article, and comments, adverts, notices, forms and sidebars put in between.
"""

from __future__ import annotations

import pickle
import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ecoframe.llm.common import append_columns, fields
from ecoframe.llm.html_blocks import Leaf, leaves

SAMPLE_PAGES = 200  # bound of the training sample
SAMPLE_CHARS = 200_000  # longer pages are not used for training
TRAINED_LEAVES = 80  # leaves of a training sequence
PATH_SIZE, WORD_SIZE, MEASURES = 256, 64, 4
HIDDEN = 16
EPOCHS = 5
BATCH = 24
RATE = 0.01
VARIATIONS = 3
BATCH_CELLS = 20_000

# Element names that mark an article, and those that mark what is not part of it.
ARTICLE = ("article", "main")
ARTICLE_NAMES = ("content", "post", "entry", "story", "body", "text", "main", "article")
OTHER_TAGS = ("nav", "aside", "footer", "header", "form", "menu", "dialog", "select", "option", "button", "label", "fieldset", "template", "svg")
OTHER_NAMES = (
    "ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "comment", "comments", "reply", "respond", "disqus",
    "sidebar", "widget", "related", "recommended", "share", "social", "newsletter", "subscribe", "signup", "login", "form",
    "search", "cookie", "consent", "notice", "alert", "popup", "modal", "menu", "nav", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "header", "masthead", "pagination", "copyright",
)
# Other forms that a block of an article may have.
TEXT_FORMS = (
    ("t:ul", "t:li"), ("t:ol", "t:li"), ("t:h2",), ("t:h3",), ("t:blockquote", "t:p"), ("t:pre",), ("t:table", "t:tr", "t:td"),
    ("t:figure", "t:figcaption"), ("t:section", "t:p"), ("t:div",),
)


def slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_SIZE, dtype=np.float32)
    for token in path:
        out[slot(token, PATH_SIZE)] = 1.0
    return out


def block_vectors(blocks: list[Leaf], words: dict[str, int]) -> np.ndarray:
    """Word shares and measures of each block; ``words`` caches the slots."""
    out = np.zeros((len(blocks), WORD_SIZE + MEASURES), dtype=np.float32)
    if len(words) > 200_000:
        words.clear()
    for row, block in zip(out, blocks):
        slots = []
        for word in block.text.lower().split():
            number = words.get(word)
            if number is None:
                number = words[word] = slot(word, WORD_SIZE)
            slots.append(number)
        row[:WORD_SIZE] = np.bincount(slots, minlength=WORD_SIZE) / len(slots)
        n = len(block.text)
        row[WORD_SIZE:] = (np.log1p(n) / 8, np.log1p(len(slots)) / 6, min(1.0, block.linked / n), block.text[-1] in ".!?")
    return out


def marked(block: Leaf) -> bool:
    """Whether a block lies in a marked article and in nothing that is not part of it."""
    tokens = block.path
    inside = [k for k, t in enumerate(tokens) if t in ("t:article", "t:main")]
    if not inside:
        return False
    return not any(t[2:] in OTHER_TAGS if t[0] == "t" else t[2:] in OTHER_NAMES for t in tokens[inside[0] :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Bidirectional LSTM with a logistic output."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + MEASURES
        self.weights: dict[str, np.ndarray] = {}
        for side in "fb":
            self.weights[f"x{side}"] = rng.normal(0, 0.1, (size, 4 * HIDDEN))
            self.weights[f"h{side}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)) * 0.5
            self.weights[f"c{side}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.weights["o"] = rng.normal(0, 0.3, 2 * HIDDEN)
        self.weights["s"] = np.zeros(1)
        self.weights = {k: w.astype(np.float32) for k, w in self.weights.items()}

    def _run(self, gates: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """States of one direction from input gates (pages x time x 4 hidden)."""
        pages, time, _ = gates.shape
        h = np.zeros((pages, HIDDEN), dtype=np.float32)
        c = np.zeros_like(h)
        out = np.zeros((pages, time, HIDDEN), dtype=np.float32)
        steps = []
        for t in range(time) if side == "f" else range(time - 1, -1, -1):
            z = gates[:, t] + h @ self.weights[f"h{side}"]
            ifo = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                steps.append((t, i, f, o, g, c, h, tc, m))
            c = np.where(m, c_new, c)
            h = np.where(m, o * tc, h)
            out[:, t] = h
        return out, steps

    def gates(self, vectors: np.ndarray, side: str) -> np.ndarray:
        return vectors @ self.weights[f"x{side}"] + self.weights[f"c{side}"]

    def logits(self, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, _ = self._run(forward, mask, "f", False)
        b, _ = self._run(backward, mask, "b", False)
        return np.concatenate([f, b], axis=2) @ self.weights["o"] + self.weights["s"]

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        outs, all_steps = {}, {}
        for side in "fb":
            outs[side], all_steps[side] = self._run(self.gates(x, side), mask, side, True)
        both = np.concatenate([outs["f"], outs["b"]], axis=2)
        p = _sigmoid(both @ self.weights["o"] + self.weights["s"])
        error = ((p - y) * mask / mask.sum()).astype(np.float32)
        grads = {"o": np.einsum("ij,ijk->k", error, both), "s": np.array([error.sum()])}
        for k, side in enumerate("fb"):
            d_out = error[:, :, None] * self.weights["o"][k * HIDDEN : (k + 1) * HIDDEN]
            d_gates = np.zeros((*y.shape, 4 * HIDDEN), dtype=np.float32)
            d_recurrent = np.zeros_like(self.weights[f"h{side}"])
            dh = np.zeros((len(x), HIDDEN), dtype=np.float32)
            dc = np.zeros_like(dh)
            for t, i, f, o, g, c, h, tc, m in reversed(all_steps[side]):
                dh = dh + d_out[:, t]
                live = dh * m
                d_c = dc * m + live * o * (1 - tc * tc)
                dz = np.concatenate(
                    [d_c * g * i * (1 - i), d_c * c * f * (1 - f), live * tc * o * (1 - o), d_c * i * (1 - g * g)], axis=1
                )
                d_gates[:, t] = dz
                d_recurrent += h.T @ dz
                dc = np.where(m, d_c * f, dc)
                dh = np.where(m, dz @ self.weights[f"h{side}"].T, dh)
            grads[f"x{side}"] = np.tensordot(x, d_gates, axes=([0, 1], [0, 1]))
            grads[f"h{side}"] = d_recurrent
            grads[f"c{side}"] = d_gates.sum(axis=(0, 1))
        return grads

    def train(self, sequences: list[tuple[np.ndarray, np.ndarray]], seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(w) for k, w in self.weights.items()}
        second = {k: np.zeros_like(w) for k, w in self.weights.items()}
        step = 0
        for _ in range(EPOCHS):
            order = sorted(rng.permutation(len(sequences)).tolist(), key=lambda k: len(sequences[k][1]))
            for batch in rng.permutation(-(-len(order) // BATCH)).tolist():
                x, y, mask = _padded([sequences[k] for k in order[batch * BATCH : (batch + 1) * BATCH]])
                step += 1
                for k, g in self.gradients(x, y, mask).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    scaled = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] = (self.weights[k] - RATE * scaled).astype(np.float32)


def _padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    time = max(len(y) for _, y in sequences)
    x = np.zeros((len(sequences), time, sequences[0][0].shape[1]), dtype=np.float32)
    y = np.zeros((len(sequences), time), dtype=np.float32)
    mask = np.zeros((len(sequences), time), dtype=bool)
    for k, (vectors, labels) in enumerate(sequences):
        x[k, : len(labels)], y[k, : len(labels)], mask[k, : len(labels)] = vectors, labels, True
    return x, y, mask


def _varied(blocks: list[tuple[Leaf, bool]], pool: list[str], rng: np.random.Generator) -> list[tuple[Leaf, bool]]:
    """The page with another wrapper around its article and foreign blocks put in."""

    def one_of(items):
        # By place: an array of all texts would take the longest one's room for each.
        return items[int(rng.integers(len(items)))]

    wrapper = ("t:div", f"c:{one_of(ARTICLE_NAMES)}") if rng.random() < 0.6 else (f"t:{one_of(ARTICLE)}",)
    changed: list[tuple[Leaf, bool]] = []
    inside: list[int] = []
    for block, label in blocks:
        path = tuple(y for t in block.path for y in (wrapper if t in ("t:article", "t:main") else (t,)))
        if label and rng.random() < 0.25:
            path = path[:-1] + TEXT_FORMS[int(rng.integers(len(TEXT_FORMS)))]
        changed.append((Leaf(path, block.text, block.linked), label))
        if label:
            inside.append(len(changed))
    outer = next((b.path[:-1] for b, label in changed if label), ("t:html", "t:body"))
    for _ in range(int(rng.integers(0, 4))):
        # Next to, below or within the article, one to four blocks of one kind.
        within = inside and rng.random() < 0.7
        at = one_of(inside) if within else int(rng.integers(0, len(changed) + 1))
        base = outer if within else ("t:html", "t:body")
        kind = (f"t:{one_of(OTHER_TAGS)}",) if rng.random() < 0.3 else (one_of(["t:div", "t:section", "t:ul", "t:p"]), f"c:{one_of(OTHER_NAMES)}")
        leaf = (one_of(["t:p", "t:div", "t:li", "t:span"]),) if rng.random() < 0.7 else ()
        new = []
        for _ in range(int(rng.integers(1, 5))):
            text = one_of(pool)
            linked = len(text) if rng.random() < 0.2 else 0
            new.append((Leaf(base + kind + leaf, text, linked), False))
        changed[at:at] = new
    return changed


def train_on(pages: list[str]) -> Labeller | None:
    """A labeller from whole pages that mark their article; None without any."""
    rng = np.random.default_rng(3)
    parsed = [[(b, marked(b)) for b in leaves(page)] for page in pages]
    parsed = [p for p in parsed if any(label for _, label in p)]
    if not parsed:
        return None
    pool = [b.text for p in parsed for b, _ in p]
    words: dict[str, int] = {}
    sequences = []
    for page in parsed:
        for blocks in [page] + [_varied(page, pool, rng) for _ in range(VARIATIONS)]:
            # A window anywhere on the page, so that what ends long pages is learned too.
            begin = int(rng.integers(max(0, len(blocks) - TRAINED_LEAVES) + 1))
            cut = blocks[begin : begin + TRAINED_LEAVES]
            vectors = np.hstack([np.array([path_vector(b.path) for b, _ in cut]), block_vectors([b for b, _ in cut], words)])
            sequences.append((vectors.astype(np.float32), np.array([label for _, label in cut], dtype=np.float32)))
    labeller = Labeller()
    labeller.train(sequences)
    return labeller


def fit(pages: DataFrame, html: str = "html") -> Labeller | None:
    """Learn from at most ``SAMPLE_PAGES`` pages (the least by a hash of the page, of those up to
    ``SAMPLE_CHARS`` characters) that mark an article. Without any, or on an empty table, there is
    no labeller. One task trains, on one core."""
    usable = pages.select(F.col(html).alias("html")).where(F.length("html").between(1, SAMPLE_CHARS))
    usable = usable.where(F.lower("html").rlike("<(article|main)[ >]"))
    sample = usable.orderBy(F.xxhash64("html"), "html").limit(SAMPLE_PAGES)

    def run(batches):
        labeller = train_on([h for batch in batches for h in batch.column("html").to_pylist()])
        if labeller:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(labeller.weights)], pa.binary())], names=["weights"])

    found = sample.mapInArrow(run, fields(weights=BinaryType())).collect()
    if not found:
        return None
    labeller = Labeller()
    labeller.weights = pickle.loads(found[0].weights)
    return labeller


def label_pages(pages: list[list[Leaf]], labeller: Labeller, paths: dict, words: dict[str, int]) -> list[np.ndarray]:
    """Whether each block of each page is main text; pages of similar length run together."""
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    weights = {side: (labeller.weights[f"x{side}"][:PATH_SIZE], labeller.weights[f"x{side}"][PATH_SIZE:]) for side in "fb"}
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * len(pages[order[stop]]) <= BATCH_CELLS:
            stop += 1
        group = order[start:stop]
        time = len(pages[group[-1]])
        mask = np.zeros((len(group), time), dtype=bool)
        gates = {side: np.zeros((len(group), time, 4 * HIDDEN), dtype=np.float32) for side in "fb"}
        for row, k in enumerate(group):
            blocks = pages[k]
            mask[row, : len(blocks)] = True
            vectors = block_vectors(blocks, words)
            for side in "fb":
                of_path, of_words = weights[side]
                for b in blocks:
                    if (side, b.path) not in paths:
                        paths[side, b.path] = path_vector(b.path) @ of_path + labeller.weights[f"c{side}"]
                gates[side][row, : len(blocks)] = np.array([paths[side, b.path] for b in blocks]) + vectors @ of_words
        if len(paths) > 50_000:
            paths.clear()
        logits = labeller.logits(gates["f"], gates["b"], mask)
        for row, k in enumerate(group):
            out[k] = logits[row, : len(pages[k])] > 0
        start = stop
    return out


def extract(df: DataFrame, labeller: Labeller | None, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of each whole page: its kept blocks joined by one line feed.

    Null and empty pages and pages without text give the empty text; text without any tag is one
    block. Without a labeller (see :func:`fit`) pages keep the blocks that their own markup marks.
    Repeated rows and other columns pass through; a column named like ``out`` is replaced.
    """

    def start():
        paths: dict = {}
        words: dict[str, int] = {}

        def work(pages: list[str]) -> list[pa.Array]:
            parsed = [leaves(p) for p in pages]
            if labeller is None:
                kept = [np.array([marked(b) for b in p], dtype=bool) for p in parsed]
            else:
                kept = label_pages(parsed, labeller, paths, words)
            texts = ["\n".join(b.text for b, k in zip(p, keep) if k) for p, keep in zip(parsed, kept)]
            return [pa.array(texts, pa.string())]

        return work

    return append_columns(df, html, fields(**{out: StringType()}), start)
