"""Packing, spelling variants and whitening against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ecoframe.llm import feast, fm_index, packing, spelling, whitening
from ecoframe.llm.chunks import is_plain
from ecoframe.llm.queries import QUERIES, WORD_BPE

from ..conftest import SF

ODD = [
    "<|endoftext|> hi<|startoftext|>x", "İstanbul ΣΑΣ é é à", "don't I'LL  x y　z", "12½ ²", "\x1c a\x1cb",
    "<|endof text|>", "", " \n ", "日本語 テスト", "a\u0085b", "x" * 5000, "'S 's", "ﬁ Ⅷ ſ", "A\tB\r\nC",
]


# --- packing --------------------------------------------------------------------------------


def naive_best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, used in enumerate(bins) if used + length <= capacity]
        if fits:
            best = max(fits, key=lambda i: bins[i])
            bins[best] += length
        else:
            bins.append(length)
    return len(bins)


def laid_out(rows, capacity):
    """Checks that each sequence is filled from 0 without gaps; returns how many there are."""
    filled = defaultdict(list)
    for length, sequence, offset in rows:
        filled[sequence].append((offset, length))
    for spans in filled.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(filled)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    histogram = Counter(lengths)
    slots = packing.plan(histogram, capacity)
    rows = []
    for length, n in histogram.items():
        sequence, offset = slots.place(np.full(n, length), np.arange(n))
        rows += zip([length] * n, sequence.tolist(), offset.tolist())
    assert laid_out(rows, capacity) == slots.sequences == naive_best_fit(lengths, capacity)


def test_plan_does_not_grow_with_counts():
    histogram = {length: 1 + length * 37 % 11 for length in range(1, 2049)}
    small = packing.plan(histogram)
    large = packing.plan({length: n * 1_000_003 for length, n in histogram.items()})
    assert len(large.length) < 4 * len(small.length) + 8192
    with pytest.raises(ValueError, match="lengths"):
        packing.plan({2049: 1})


def test_word_encoder_equals_the_library():
    library = Tokenizer.from_file(WORD_BPE)
    texts = [*ODD, *(" ".join(ODD[i] for i in random.Random(n).choices(range(len(ODD)), k=4)) for n in range(30))]
    flat, counts = packing.worker_encoder(WORD_BPE)(texts)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(e) for e in expected]
    assert flat.tolist() == [i for e in expected for i in e]
    assert is_plain("plain é text") and not is_plain("a<|b") and not is_plain("İ")


def test_pack_edges(spark, edges):
    placed = packing.place(packing.cut(edges, WORD_BPE, capacity=64), capacity=64).cache()
    assert placed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    rows = placed.collect()
    laid_out([(r.length, r.sequence_id, r.offset) for r in rows], 64)
    library = Tokenizer.from_file(WORD_BPE)
    expected = Counter()
    for doc_id, text in edges.select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            expected[doc_id, piece, start, np.array(ids[start : start + 64], "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == expected
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    for r in rows:
        assert bytes(whole[r.sequence_id].ids)[r.offset * 4 : (r.offset + r.length) * 4] == bytes(r.ids)
    assert packing.place(packing.cut(edges.limit(0), WORD_BPE)).count() == 0


def test_place_replaces_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 3, "a"), (2, 3, "b"), (3, 2, "c")], "id int, length int, Offset string").withColumn("sequence_id", packing.F.lit(9))
    placed = packing.place(rows, capacity=5)
    assert placed.columns == ["id", "length", "sequence_id", "offset"]
    assert laid_out([(r["length"], r["sequence_id"], r["offset"]) for r in placed.collect()], 5) == 2


def test_op11(spark):
    rows = QUERIES["op11_packing"](spark, SF).collect()
    lengths = [r.length for r in rows]
    assert laid_out([(r.length, r.sequence_id, r.offset) for r in rows], 2048) == naive_best_fit(lengths, 2048)
    library, expected = Tokenizer.from_file(WORD_BPE), Counter()
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            cut = ids[start : start + 2048]
            expected[doc_id, piece, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected


# --- spelling -------------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def near_of(words):
    """Near words of every word, by what is left after deleting one letter."""
    by_rest = defaultdict(set)
    for w in words:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_rest[rest].add(w)
    found = defaultdict(set)
    for group in by_rest.values():
        for a in group:
            found[a] |= {b for b in group if near(a, b)}
    return found


def grouped(counts, ratio=10):
    found, out = near_of(counts), {}
    forms = {}
    for w, n in counts.items():
        best = min(found[w], key=lambda b: (-counts[b], b), default=None)
        forms[w] = best if best and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (n, forms[w], root, len(found[w]), counts[forms[w]] if forms[w] else None)
    return out


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.text("abé😀", min_size=1, max_size=7), min_size=1, max_size=40, unique=True),
    st.lists(st.text("abzé", min_size=1, max_size=7), min_size=1, max_size=20, unique=True),
    st.sampled_from([0, 1]),
)
def test_search_scheme_finds_each_pair_once(words, patterns, side):
    who, word = fm_index.near_words(words, patterns, side)
    got = list(zip(who.tolist(), word.tolist()))
    assert len(set(got)) == len(got)
    half = [(p[: len(p) // 2], p[len(p) // 2 :]) for p in patterns]
    expected = {
        (i, j) for i, p in enumerate(patterns) for j, w in enumerate(words)
        if near(p, w) and (w.startswith(half[i][0]) if side else w.endswith(half[i][1]))
    }
    assert set(got) == expected


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_intervals_of_both_directions_agree(numbers):
    """Growing a pattern on either side counts its occurrences, in any order of the sides."""
    words = sorted({"".join("abcd"[n] for n in numbers[i : i + 5]) for i in range(0, len(numbers), 5)} | {"abc"})
    text = "\0" + "\0".join(words) + "\0"
    index = fm_index.WordIndex(words)
    for pattern in {"a", "ab", "\0a", "bc\0", "abc", text[1:4]}:
        points = index.code(np.frombuffer(pattern.encode("utf-32-le"), "<u4"))
        for middle in range(len(points) + 1):
            at = index.whole(1)
            for c in points[:middle][::-1]:
                at = index.extend(at, np.array([c]), 0)
            for c in points[middle:]:
                at = index.extend(at, np.array([c]), 1)
            assert at.size[0] == sum(text.startswith(pattern, i) for i in range(len(text)))


def test_groups_against_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(7, 10))) for _ in range(1500)}
    counts = {w: int(2 * 10 ** rng.uniform(0, 4)) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    expected = grouped(counts)
    got = {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in spelling.group_variants(frame).collect()}
    assert got == expected
    assert any(v[1] and v[2] != v[1] for v in expected.values())  # chains occur
    # Shards of few words and cut halves give the same.
    cut = spelling.neighbours(frame, shard_words=64, hot_words=3)
    assert {r.word: r.n_near for r in cut.collect()} == {w: v[3] for w, v in expected.items() if v[3]}


def test_words_of_any_length(spark):
    rows = [(None, 3), ("", 5), ("a", 9), ("ab", 2), ("b", 90), ("x" * 3000, 4), ("x" * 3001, 50), ("日本語", 1), ("日本", 20)]
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["x" * 3000] == ("x" * 3001, "x" * 3001, 1) and got["日本語"] == ("日本", "日本", 1)
    assert got[None][2] == got["a"][2] == 0 and len(got) == len(rows)
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def counted(rows, damage=31):
    import re

    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return counts


def test_count_words(spark, edges):
    rows = [tuple(r) for r in edges.select("doc_id", "text").collect()] + [(0, "ÀÉÎÕÜ×÷ÿabcdefg Abcdefg abcdefG"), (12, "seventh")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' AS word", "1 AS n", "2 AS _key")
    for damage in (31, 2):
        got = {r.word: r.n for r in spelling.count_words(frame, damage=damage).collect()}
        assert got == dict(counted(rows, damage))
    assert spelling.count_words(frame.limit(0)).count() == 0


def test_op12(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = grouped({w: n for w, n in counted(rows).items() if n >= 2})
    got = {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in QUERIES["op12_spelling"](spark, SF).collect()}
    assert got == expected


# --- whitening ------------------------------------------------------------------------------


@pytest.mark.parametrize("spectrum", [
    [5, 5, 5, 5, 5, 1, 1, 1], [1] * 6, [100, 50, 49.999999, 20, *[1e-3] * 60], np.linspace(1, 2, 64), [2, 1, 0], [4.0],
    [1e9, 1e-2, 5e-3, 1e-6, *[5e-8] * 60], [0] * 5, [3, 2, 2, *[1] * 30],
])
def test_contours_find_all_pairs(spectrum):
    d = len(spectrum)
    turn = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
    matrix = (turn * np.array(spectrum, float)) @ turn.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = feast.largest_pairs(matrix, 4)
    expected = np.linalg.eigvalsh(matrix)[::-1][:4]
    size = max(1e-300, np.abs(expected).max())
    assert np.abs(values - expected).max() <= 1e-13 * size
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() <= 1e-12 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-12
    shifts = np.random.default_rng(1).uniform(-1, 1, 9) * size
    assert (feast.count_below(feast.tridiagonal(matrix), shifts) == (np.linalg.eigvalsh(matrix)[:, None] < shifts).sum(0)).all()


def test_a_missed_pair_is_noticed(monkeypatch):
    monkeypatch.setattr(feast, "MAX_ROUNDS", 0)
    with pytest.raises(feast.MissedPairs):
        feast.largest_pairs(np.diag([3.0, 2.0, 1.0]), 2)


def check_whitened(rows, got, components=4):
    good = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(k, tuple(math.floor(256 * c) for c in v)) for k, v in good]
    fit = sorted({x for _, x in whole})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    centred = [[Fraction(n * x[i] - sums[i], n) for i in range(d)] for x in fit]
    exact = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(exact)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    k = int((values > 1e-10 * values[0]).sum())
    by_key = defaultdict(list)
    for key, x in whole:
        for c in range(k):
            z = (np.array([float(Fraction(n * x[i] - sums[i], n)) for i in range(d)]) @ vectors[:, c]) / math.sqrt(values[c])
            by_key[key, c + 1].append((n, sum((n * x[i] - sums[i]) ** 2 for i in range(d)), z, values[c] / exact.trace()))
    assert len(got) == sum(map(len, by_key.values()))
    signs = {}
    for r in got:
        options = by_key[r.vec_id, r.component]
        match = [o for o in options if o[:2] == (r.n, r.deviation) and abs(abs(o[2]) - abs(r.whitened)) <= 1e-7 * (1 + abs(o[2]))]
        assert match, r
        if abs(match[0][2]) > 1e-3:
            assert signs.setdefault(r.component, match[0][2] * r.whitened > 0) == (match[0][2] * r.whitened > 0)
        assert abs(r.explained - match[0][3]) <= 1e-9 and r.identity_error <= 1e-9


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitened(rows, QUERIES["op13_whitening"](spark, SF).collect())


def test_whiten_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) * [300, 20, 1] + [5000, -3, 0]).tolist()) for i in range(60)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, math.nan, 2.0]), (104, [math.inf, 0.0, 0.0])]
    rows += [(200 + i, rows[0][1]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS component", "'x' AS n", "1 AS _x", "2 AS _key")
    check_whitened(rows, whitening.whiten(frame).collect())
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.where("vec_id >= 200")).count() == 0  # equal vectors have no variance
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


def test_whiten_large_entries_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-(1 << 50), 1 << 50)), float(rng.randrange(1 << 20)), 0.5]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()
    assert len(got) == 20 and all(r.deviation is None and r.identity_error < 1e-9 for r in got)
    assert whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0])], "vec_id long, embedding array<double>")).count() == 0


def test_packed_rows_are_canonical():
    rows = np.array([[1, -32768], [32767, 0], [32768, 0], [-(1 << 31), 5], [1 << 40, -1]])
    packed = whitening.pack(rows)
    assert [p[0] for p in packed] == [0, 0, 1, 1, 2]
    assert whitening.unpack(whitening.pa.array(packed)).tolist() == rows.tolist()
