"""Line dedup, SimHash groups and benchmark passages against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from ecoframe.llm import decontaminate, line_dedup, near_copies, perfect_hash, simhash
from ecoframe.llm.graph import components
from ecoframe.llm.queries import ORACLES, QUERIES
from tests import oracle
from tests.conftest import SF
from tests.llm.conftest import EDGE_ROWS


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    high, low = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    found = perfect_hash.PerfectHash(perfect_hash.build(high, low))
    assert sorted(found(high, low).tolist()) == list(range(n)) and found.size == n


def test_perfect_hash_refuses_repeated_keys():
    twice = np.zeros(2, dtype=np.uint64)
    with pytest.raises(ValueError):
        perfect_hash.build(twice, twice)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    problem, rows, _ = oracle.compare(spark, oracle.connect(SF), SF, name)
    assert problem is None and rows > 0


def test_lines_of_edge_rows(spark, edges):
    line = "A line that is said by many."
    more = spark.createDataFrame([(k, f"own {k}\n  {line.upper()}\t\nshort") for k in range(20, 26)], "doc_id long, text string")
    docs = edges.unionByName(more, allowMissingColumns=True)
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == len(EDGE_ROWS) + 6
    texts = {r.doc_id: r.text for r in rows}
    assert texts[25] == f"own 25\n  {line.upper()}\t\nshort" and texts[22] == "own 22\nshort"
    assert {r.n_dropped for r in rows if r.doc_id and r.doc_id >= 20} == {0, 1}
    assert texts[1] == texts[2] == "" and texts[6] == EDGE_ROWS[5][1]  # two documents hold it, one twice
    assert line_dedup.dedup_lines(edges.limit(0)).count() == 0


def test_hot_line_is_split(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_PROBES", 50)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('a line in every document\\nunique text number ', id) AS text")
    rows = line_dedup.dedup_lines(docs).collect()
    assert sum(r.n_dropped for r in rows) == 399
    assert [r.doc_id for r in rows if not r.n_dropped] == [399]


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    parent = list(range(len(prints)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(a) for a in range(len(prints))]


def test_simhash_query(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    prints = [plain_fingerprint(r.text) for r in rows]
    groups = plain_groups(prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, SF).collect()}
    assert found == {r.doc_id: (f"{p:016x}", rows[g].doc_id) for r, p, g in zip(rows, prints, groups)}


@pytest.mark.parametrize("large", [1, 3, 32])
def test_links_of_dense_fingerprints(spark, monkeypatch, large):
    """Many fingerprints within few bits: pairs and stars must give the same groups."""
    monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
    rng = np.random.default_rng(large)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        base = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            prints.add(base ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint long"))
    for a, b in edges.collect():
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2
    roots = {r.node: r.root for r in components(edges).collect()}
    groups = plain_groups(prints)
    by_plain, by_found = {}, {}
    for (s,), g in zip(signed, groups):
        by_plain.setdefault(g, set()).add(s)
        by_found.setdefault(roots.get(s, s), set()).add(s)
    assert sorted(map(sorted, by_plain.values())) == sorted(map(sorted, by_found.values()))


def test_simhash_of_edge_rows(spark, edges):
    rows = simhash.near_duplicates(edges.drop("fingerprint", "component_id")).collect()
    assert len(rows) == len(EDGE_ROWS)
    group = {r.doc_id: r.component_id for r in rows}
    assert group[1] == group[2] == group[3] == 1 and group[6] == group[7] == 6
    assert sum(r.fingerprint == 0 for r in rows) == 4
    assert simhash.near_duplicates(edges.limit(0)).count() == 0


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    size = min(5, len(words))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()


def plain_similar(texts, least=0.8):
    sets = [plain_shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(a) for a in range(len(sets))]


def test_similar_texts_against_brute_force(spark):
    """One or two words changed, chains whose ends are unlike, texts at 0.6 to 0.8, short texts."""
    rng = np.random.default_rng(3)
    texts = [None, "", " ", "one two", "One  TWO", "one two three"]
    for n in (25, 40, 60, 100, 240, 850):
        base = [f"w{k}" for k in rng.integers(0, 5000, n)]
        texts.append(" ".join(base))
        for changes in (1, 1, 1, 2, 2, 3, n // 25, n // 20):
            words = list(base)
            for at in rng.integers(5, n - 5, changes):
                words[at] = f"new{rng.integers(1 << 30)}"
            texts.append(" ".join(words))
        chain = list(base)
        for at in range(5, min(n, 100), 12):
            chain[at] = f"step{at}"
            texts.append(" ".join(chain))
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, words=5, min_similarity=0.8).collect()}
    assert found == dict(enumerate(plain_similar(texts)))
    assert simhash.near_duplicates(frame.limit(0), words=5, min_similarity=0.8).count() == 0


def test_recall_of_bands():
    rng = np.random.default_rng(4)
    shared = 0
    for _ in range(2000):
        pool = rng.integers(0, 1 << 63, 100, dtype=np.uint64) * np.uint64(2)
        a, b = near_copies.band_keys(pool[:90]), near_copies.band_keys(pool[10:])
        shared += bool((a == b).any())
    assert shared >= 1999  # similarity 0.8


def test_components_of_a_long_path(spark):
    edges = spark.range(60).selectExpr("(id * 37) % 61 AS a", "((id + 1) * 37) % 61 AS b")
    found = components(edges).collect()
    assert len(found) == 61 and {r.root for r in found} == {0}


def passages(docs, items):
    """Brute force: all windows of the item's length."""
    found = set()
    for doc, text in docs:
        words = decontaminate.words_of(text or "")
        for item, wanted in items:
            own = decontaminate.words_of(wanted or "")
            if not own:
                continue
            size = min(5, len(own))
            a = Counter(tuple(own[k : k + size]) for k in range(len(own) - size + 1))
            n = sum(a.values())
            shingles = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
            for k in range(max(1, len(shingles) - n + 1)):
                b = Counter(shingles[k : k + n])
                both = sum((a & b).values())
                if both and both / (n + sum(b.values()) - both) >= 0.8:
                    found.add((doc, item))
    return found


def test_passages_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(8, 70)))) for k in range(25)]
    docs = []
    for k in range(60):
        words = list(rng.choice(vocabulary, rng.integers(1, 400)))
        if k % 3 == 0:
            planted = items[int(rng.integers(25))][1].split()
            if k % 2:
                planted[int(rng.integers(len(planted)))] = "changed"
            at = int(rng.integers(len(words)))
            words[at:at] = [w.upper() + "," for w in planted]
        docs.append((k, " ".join(words)))
    docs += [(100, items[3][1]), (101, " ".join(items[4][1].split()[:-1])), (102, None), (103, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (None, "no id"), (92, "three short words")], "item_id long, text string")
    found = decontaminate.find_passages(frame, benchmark).collect()
    got = {(r.doc_id, m.item_id) for r in found for m in r.matches}
    assert got == passages(docs, items)
    clean = decontaminate.remove_contaminated(frame, benchmark)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_recall_of_edited_passages():
    """Items with one inner word changed, similarity 0.8 to 0.85, inside a longer text."""
    rng = np.random.default_rng(11)
    items = [(k, " ".join(f"i{k}w{w}" for w in range(n))) for k, n in enumerate(rng.integers(49, 63, 400).tolist())]
    index = decontaminate.Items.of(items)
    missed = 0
    for k, text in items:
        words = text.split()
        words[int(rng.integers(4, len(words) - 4))] = "changed"
        words = [f"a{x}" for x in rng.integers(0, 999, 40)] + words + [f"b{x}" for x in rng.integers(0, 999, 40)]
        hashes = np.array([decontaminate.word_hash(w) for w in words], dtype=np.uint64)
        shingles = decontaminate.shingle_hashes(hashes)
        found = decontaminate.candidates(shingles, np.array([0]), np.array([len(shingles)]), index)
        matches = decontaminate.verify(shingles, 0, len(shingles), found, index)
        want = {i for _, i in passages([(0, " ".join(words))], [items[k]])}
        missed += {m["item_id"] for m in matches} != want or not want
    assert missed == 0


def test_passages_of_edge_rows(spark, edges):
    item = spark.createDataFrame([(1, "the cat sat on the mat again"), (2, "a b")], "item_id long, text string")
    rows = decontaminate.find_passages(edges, item).collect()
    assert len(rows) == len(EDGE_ROWS)
    assert sorted(r.doc_id for r in rows if r.matches) == [6, 6, 7]
    (match,) = next(r.matches for r in rows if r.doc_id == 7)
    assert (match.item_id, match.start, match.n_words, match.similarity) == (1, 0, 7, 1.0)
    assert all(r.matches == [] for r in decontaminate.find_passages(edges, item.limit(0)).collect())
    assert decontaminate.find_passages(edges.limit(0), item).count() == 0


def test_passages_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = QUERIES["op8_decontamination"](spark, SF).collect()
    assert {(r.doc_id, i) for r in found for i in r.item_ids} == passages(docs, items)


def test_block_index_misses_nothing():
    rng = np.random.default_rng(9)
    prints = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    index = decontaminate.BlockIndex(prints, np.zeros(40, dtype=np.int64))
    near = []
    for p in prints.tolist():
        for distance in range(0, 16):
            near.append(p ^ sum(1 << int(b) for b in rng.choice(63, distance, replace=False)))
    near = np.array(near, dtype=np.uint64)
    want = {(a, b) for a, b in zip(*np.nonzero(np.bitwise_count(near[:, None] ^ prints) <= decontaminate.RADIUS))}
    assert set(zip(*(x.tolist() for x in index.near(near, np.zeros(len(near), dtype=np.int64))))) == want


def _met(spark, monkeypatch, texts):
    """Groups of the texts, and the number of pairs that were compared."""
    compared = []
    verified = near_copies._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.groups(frame, "doc_id", "text", 5, 0.8).collect()}
    return found, sum(compared)


def test_group_of_near_copies_is_linear(spark, monkeypatch):
    """2 000 copies with up to five words changed: most are unlike each other, and like the text they come from."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)]
    for d in range(2000):
        words = list(base)
        for at in rng.choice(np.arange(5, 145, 7), rng.integers(1, 6), replace=False):
            words[at] = f"new{d}x{at}"
        texts.append(" ".join(words))
    found, compared = _met(spark, monkeypatch, texts)
    near = {d for d, t in enumerate(texts) if len(plain_shingles(t) & plain_shingles(texts[0])) >= 131}
    assert all(found[d] == 0 for d in near) and len(near) > 1000
    assert compared < 28 * len(texts)


def test_texts_with_a_common_passage_stay_apart(spark, monkeypatch):
    """600 texts of which two thirds are one passage share bands; a few of them are near copies."""
    rng = np.random.default_rng(12)
    passage = " ".join(f"p{k}" for k in range(120))
    texts = [passage + " " + " ".join(f"o{d}x{k}" for k in range(60)) for d in range(600)]
    for d in range(5):
        texts.append(texts[100 * d].replace(f"o{100 * d}x{int(rng.integers(10, 50))} ", "changed "))
    found, compared = _met(spark, monkeypatch, texts)
    assert found == {d: d for d in range(600)} | {600 + d: 100 * d for d in range(5)}
    assert compared < 28 * len(texts)


def test_similar_texts_are_linked_by_fingerprint_first(spark, monkeypatch):
    """Pairs within two bits come from fingerprints: with no MinHash band they are still found, and only if similar."""
    base = [f"w{k}" for k in range(3000)]
    texts = [" ".join(base), " ".join(base[:-1] + ["changed"]), " ".join(base + base), "one two", "", "three four"]
    prints = [simhash.fingerprint(t) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 2
    monkeypatch.setattr(near_copies, "band_keys", lambda s: np.full(near_copies.BANDS, near_copies._node(s), dtype=np.uint64).view(np.int64))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "_alike_in_rare_shingles", lambda nodes, sets, least: nodes.selectExpr("node AS a", "node AS b").limit(0))
    rows = simhash.near_duplicates(frame, words=5, min_similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate([0, 0, 0, 3, 4, 5]))
    assert {r.doc_id: r.fingerprint for r in rows} == {d: p - (p >> 63 << 64) for d, p in enumerate(prints)}
