"""Language, toxicity, page, url and vector operators against brute force or held-out rows."""


import math
import time

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ecoframe.llm import html_blocks, html_extract, language_id, onebit_search, toxicity, url_reputation
from ecoframe.llm.queries import PIECES, QUERIES, URL_RULES
from tests.conftest import SF
from tests.llm.conftest import EDGE_ROWS, crc

BIGGER = "/root/testdata/sf0.01"


# Language identification


def plain_likelihood(word, probability, vocabulary):
    text = language_id.MARK + word
    sums = [1.0] + [0.0] * len(text)
    for end in range(1, len(sums)):
        for begin in range(max(0, end - language_id.MAX_PIECE), end):
            number = vocabulary.get(text[begin:end])
            if number is None and end - begin == 1:
                number = len(probability) - 1
            if number is not None:
                sums[end] += sums[begin] * probability[number]
    return math.log(sums[-1])


@pytest.fixture(scope="module")
def pieces():
    found = language_id.pieces(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    place = {int(h): i for i, h in enumerate(found.keys)}
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return found, {n: place[found._hash(n)] for n in names if len(n) <= language_id.MAX_PIECE}


def test_all_segmentations_are_summed(pieces, monkeypatch):
    found, vocabulary = pieces
    model = np.random.default_rng(0).random((found.size + 1, 2)) / found.size
    words = ["the", "tion", "éreaux", "a", "中x", "strasse" * 9, "ß"]
    got = language_id.log_likelihood(found, model, words)
    want = [[plain_likelihood(w, model[:, k], vocabulary) for k in (0, 1)] for w in words]
    assert np.allclose(got, want)
    linear = language_id.expected_counts(found, model[:, 0], words, np.arange(7.0))
    monkeypatch.setattr(language_id, "LINEAR_LENGTH", 0)
    assert np.allclose(language_id.log_likelihood(found, model, words), want)
    assert np.allclose(language_id.expected_counts(found, model[:, 0], words, np.arange(7.0)), linear)


def test_expected_counts_are_the_gradient(pieces):
    """Expected uses of a piece are p times the derivative of the log-likelihood by p."""
    found, _ = pieces
    model = np.random.default_rng(1).random((found.size + 1, 1)) / found.size
    counts = language_id.expected_counts(found, model[:, 0], ["therefore"], np.ones(1))
    number = int(np.argmax(counts))
    assert counts[number] > 0.1
    moved = model.copy()
    moved[number] *= 1 + 1e-6
    change = language_id.log_likelihood(found, moved, ["therefore"]) - language_id.log_likelihood(found, model, ["therefore"])
    assert counts[number] == pytest.approx(change[0, 0] / 1e-6, rel=1e-3)


def test_language_held_out(spark):
    rows = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, BIGGER).collect()}
    truth = spark.read.parquet(f"{BIGGER}/documents.parquet").collect()
    assert len(rows) == len(truth)
    held = [r for r in truth if rows[r.doc_id].held_out]
    assert all(rows[r.doc_id].held_out == (crc(r.doc_id) % 5 == 0) for r in truth)
    assert sum(rows[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.98


def test_language_of_edge_rows(spark, edges):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("und", None), (None, "fr")], "text string, lang string")
    model = language_id.fit(train, PIECES)
    rows = language_id.identify(edges, model).collect()
    assert len(rows) == len(EDGE_ROWS) and all(r.other == 7 for r in rows)
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 9) or (r.doc_id is None and r.text is None))
        assert 0 <= r.score <= 1
    assert language_id.identify(edges.limit(0), model).count() == 0
    empty = language_id.fit(train.limit(0), PIECES)
    assert {r.lang_pred for r in language_id.identify(edges, empty).collect()} == {"und"}


# Toxicity


def test_toxicity_against_plain_counts(spark):
    docs = [(k, f"some plain words number{k % 7} here you {'idiot' if k % 4 == 0 else 'friend'} and word{k}", int(k % 4 == 0)) for k in range(60)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, _label int")
    counts = {r.word: r for r in toxicity.continuations(rows, "text").collect()}
    before = {}
    for _, text, label in docs:
        previous = ""
        for word in language_id.words_of(text):
            before.setdefault(word, (set(), set()))[label].add(previous)
            previous = word
    assert len(counts) == len(before)
    for word, (ordinary, toxic) in before.items():
        signed = np.array([toxicity.word_hash(word)], dtype=np.uint64).view(np.int64)[0]
        found = counts[int(signed)]
        assert (found.ordinary, found.toxic, found.both) == (len(ordinary), len(toxic), len(ordinary | toxic))


def test_toxicity_held_out(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, BIGGER).collect()}
    labels = [r for r in spark.read.parquet(f"{BIGGER}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert all(r.held_out == (crc(d) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for d, r in rows.items())
    positive = [rows[r.doc_id].predicted for r in labels if r.toxic == 1]
    negative = [rows[r.doc_id].predicted for r in labels if r.toxic == 0]
    assert np.mean(positive) > 0.5 and np.mean(negative) < 0.05


def test_toxicity_does_not_depend_on_the_size_of_the_model(spark, edges, monkeypatch):
    names = ["".join(chr(97 + (i * p) % 26) for p in (1, 3, 7)) for i in range(26)]
    docs = [(i, f"{names[i % 26]} {'awful' if i % 3 == 0 else 'fine'} {names[i % 11]} {'fool' if i % 3 == 0 else 'day'} {names[i % 13]} the") for i in range(300)]
    known = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_label", (F.col("doc_id") % 3 == 0).cast("int"))
    texts = edges.select("doc_id", "text").union(known.select("doc_id", "text"))

    def scores():
        return sorted((str(r.doc_id), r.text or "", r.score) for r in toxicity.score(texts, toxicity.fit(known, known)).collect())

    held = scores()
    monkeypatch.setattr(toxicity, "MODEL_WORDS", 3)
    assert scores() == held and len({x[2] for x in held}) > 2


def test_toxicity_of_edge_rows(spark, edges):
    labels = spark.createDataFrame([(6, 1), (6, 0), (4, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    known = toxicity.labelled(edges.select("doc_id", "text"), labels, "doc_id", "toxic")
    assert sorted((r.doc_id, r._label) for r in known.collect()) == [(4, 0), (6, 1), (6, 1)]
    model = toxicity.fit(known, known)
    rows = toxicity.score(edges, model).collect()
    assert len(rows) == len(EDGE_ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(edges.limit(0), model).count() == 0
    blank = toxicity.fit(known.limit(0), known.limit(0))
    assert len({r.score for r in toxicity.score(edges, blank).collect()}) == 1


# Main text of pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p><b>First  part<br>goes&nbsp;on<p>Second &lt;one&gt; &eacute;</p><!-- no <p>text</p> -->
<div class="comments"><p>I agree!</p></div></article><form><p>Mail</p></form><footer>&copy; me</footer>"""


def test_blocks_of_a_page():
    found = [(b.path[-1], b.text) for b in html_blocks.leaves(PAGE)]
    assert found == [
        ("t:title", "T"), ("t:h1", "Site"), ("t:li", "One"), ("t:li", "Two"), ("c:ad", "Buy"), ("t:h1", "Title & more"),
        ("t:p", "First part goes on"), ("t:p", "Second <one> é"), ("t:p", "I agree!"), ("t:p", "Mail"), ("t:footer", "© me"),
    ]
    assert [b.text for b in html_blocks.leaves("just text")] == ["just text"]
    assert html_blocks.leaves("") == html_blocks.leaves("<p></p><script>x") == []
    assert [b.text for b in html_blocks.leaves("a < b <p>c</q>d <div")] == ["a < b", "cd"]


def test_blocks_around_islands():
    def texts(page):
        return [b.text for b in html_blocks.leaves(page)]

    assert texts("<p>a <svg class=icon/> b</p><p>c</p>") == ["a b", "c"]
    assert texts('<p>a</p><svg class=icon/><p>b</p><svg><path d="M"/><text>t</text></svg><p>c</p>') == ["a", "b", "t", "c"]
    assert texts("<p>a <svg><g><path d=M></svg> b</p>") == ["a b"]
    assert texts("<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>") == ["where x=1 holds"]
    assert texts("<article><object data=x><p>fallback</p></object><p>more</p></article>") == ["fallback", "more"]
    assert texts("<p>a <select><option>1<option>2</select> b") == ["1", "2", "a b"]
    for tag in ("svg", "math", "object", "template", "noscript", "select"):
        assert texts(f"<div><p>a <{tag}>b</p></div><p>c</p>")[-1] == "c"
        assert " ".join(sorted(" ".join(texts(f"<p>a <{tag}>b")).split())) == "a b"
    assert [b.path[-1] for b in html_blocks.leaves("<p>a <noscript>b</noscript> c</p>")] == ["t:noscript", "t:p"]
    assert texts("<p>a<textarea><p>no</p></textarea>b<iframe>no</iframe>c<style>no</style>") == ["abc"]


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(2)
    size = html_extract.PATH_SIZE + html_extract.WORD_SIZE + html_extract.MEASURES
    x, y = rng.random((2, 5, size)), rng.integers(0, 2, (2, 5)).astype(float)
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], dtype=bool)
    net = html_extract.Labeller()
    net.weights = {k: w.astype(float) for k, w in net.weights.items()}

    def loss():
        z = net.logits(net.gates(x, "f"), net.gates(x, "b"), mask)
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    for name, gradient in net.gradients(x, y, mask).items():
        at = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
        weight = net.weights[name]
        weight[at] += 1e-3
        high = loss()
        weight[at] -= 2e-3
        low = loss()
        weight[at] += 1e-3
        assert gradient[at] == pytest.approx((high - low) / 2e-3, rel=1e-2)


def test_extraction_held_out(spark):
    """The labeller, trained on some pages, on the others and on a page of another kind."""
    pages = [r.html for r in spark.read.parquet(f"{BIGGER}/pages.parquet").orderBy("page_id").collect()]
    net = html_extract.train_on(pages[:120])
    parsed = [html_blocks.leaves(p) for p in pages[120:]]
    labels = html_extract.label_pages(parsed, net, {}, {})
    for blocks, found in zip(parsed, labels):
        assert found.tolist() == [html_extract.marked(b) for b in blocks]
    other = html_blocks.leaves(PAGE.replace("<article>", '<div class="post-content">').replace("</article>", "</div>"))
    (found,) = html_extract.label_pages([other], net, {}, {})
    assert [b.text for b, keep in zip(other, found) if keep] == ["Title & more", "First part goes on", "Second <one> é"]


def test_extraction_of_edge_pages(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, ""), (3, "<p>"), (4, PAGE), (4, PAGE), (None, "<article><p>" + "long " * 50_000)], "page_id long, html string"
    ).selectExpr("*", "'old' AS text", "7 AS n_chars")
    net = html_extract.fit(pages)
    rows = html_extract.extract(pages, net).collect()
    assert len(rows) == 6 and [r.text for r in rows][:3] == ["", "", ""] and rows[3].text == rows[4].text
    plain = html_extract.extract(pages, None).collect()
    assert plain[3].text == "Title & more\nFirst part goes on\nSecond <one> é" and len(plain[5].text) == 249_999
    assert html_extract.fit(pages.limit(0)) is None
    assert html_extract.extract(pages.limit(0), net).count() == 0


# Urls


def test_url_rules(spark):
    urls = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
        ("https://www.example.com/de/1#t", "www.example.com", "/de/1", "example.com/de/", "block"),
        ("x://some.org/fr/?a=/", "some.org", "/fr/", "org/fr/", "allow"),
        ("http://shop.net", "shop.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u[0]) for k, u in enumerate(urls)] * 2, "page_id long, url string").selectExpr("*", "'old' AS host", "'old' AS verdict")
    outcomes = spark.createDataFrame([("some.org", None)], "host string, bad int")
    rows = url_reputation.judge_urls(pages, outcomes, URL_RULES).collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        assert (r.url, r.host, r.path, r.rule, r.verdict) == urls[r.page_id]
    assert url_reputation.judge_urls(pages.limit(0), outcomes.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in url_reputation.judge_urls(pages, outcomes.limit(0), {}).collect()} == {"allow"}


def test_reputation_shrinks(spark):
    rows = [("big.bad.com", 1)] * 80 + [("big.bad.com", 0)] * 5 + [("new.bad.com", 1)] + [("fine.org", 0)] * 200 + [("one.org", 1)] + [("none.org", None)]
    found = {r.host: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert found["big.bad.com"].mean > 0.85 and found["big.bad.com"].lower > 0.8
    assert found["one.org"].mean < found["new.bad.com"].mean <= 1  # the domain or suffix tells
    assert found["fine.org"].mean < 0.05 and found["none.org"].n == 0
    assert all(0 <= r.lower <= r.mean <= r.upper <= 1 for r in found.values())


# Vectors


def plain_nearest(rows, queries, k):
    usable = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    found = []
    for q, a in ((q, a) for q, a in usable if q in queries):
        near = sorted((-float(a @ b), i) for i, b in usable if i != q)[:k]
        found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return found


@pytest.mark.parametrize("n", [3, 15, 300])
def test_search_equals_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(onebit_search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(onebit_search, "TILE_ROWS", 4)
    rng = np.random.default_rng(n)
    rows = [(k, rng.integers(-8, 9, 16).astype(float).tolist()) for k in range(n)]
    rows[2] = (2, rows[0][1])
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [math.nan] + [1.0] * 15), (1003, [math.inf] + [1.0] * 15), (1004, [None] + [1.0] * 15), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'old' AS rank", "'old' AS part")
    got = [tuple(r) for r in onebit_search.nearest(frame.where("vec_id % 5 = 0"), frame, 7).collect()]
    assert sorted(got) == sorted(plain_nearest(rows, set(range(0, 1005, 5)), 7))


def test_search_of_many_equal_vectors(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = onebit_search.nearest(frame.where("vec_id = 5"), frame, 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [k for k in range(21) if k != 5]


def test_search_of_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert onebit_search.nearest(frame.limit(0), frame).count() == 0
    assert onebit_search.nearest(frame, frame.limit(0)).count() == 0
    assert onebit_search.nearest(frame, frame).count() == 0


def test_search_query_recall(spark):
    got = [tuple(r) for r in QUERIES["op4_onebit_search"](spark, SF).collect()]
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = plain_nearest(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert {(q, i) for q, _, i, _ in got} == {(q, i) for q, _, i, _ in want}
    assert np.allclose([s for *_, s in sorted(got)], [s for *_, s in sorted(want)])


def test_error_bound_holds():
    rng = np.random.default_rng(8)
    vectors, queries = rng.normal(size=(3000, 64)), rng.normal(size=(40, 64))
    turn = onebit_search.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    upper = onebit_search.bounds(*onebit_search.encode(vectors, turn), queries @ turn)
    assert (queries @ vectors.T > upper).mean() < 2e-4


def test_raw_elements_without_end_tags():
    def texts(page):
        return [b.text for b in html_blocks.leaves(page)]

    assert texts("<article><p>a</p><iframe src=x /><p>b</p></article>") == ["a", "b"]
    assert texts("<p>a<script>var x = 1;<p>b") == ["a", "b"]


def test_training_time_does_not_follow_the_longest_block():
    page = "<html><body><nav>menu here</nav><article>{}</article><footer>end of page</footer></body></html>"
    pages = [page.format("".join(f"<p>words of paragraph {i} {j}</p>" for j in range(20))) for i in range(60)]
    pages.append(page.format(f"<p>{'long text ' * 10_000}</p>"))
    begin = time.process_time()
    assert html_extract.train_on(pages) is not None
    assert time.process_time() - begin < 30
