"""BPE rounds and token records against the tokenizer library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from ecoframe.llm import binary_records, bpe, common
from ecoframe.llm.chunks import ChunkEncoder
from ecoframe.llm.queries import BYTE_BPE, QUERIES
from ecoframe.session import scratch_path
from tests.conftest import SF
from tests.llm.conftest import EDGE_ROWS

LIBRARY = Tokenizer.from_file(BYTE_BPE)
VOCABULARY = bpe.Vocabulary(BYTE_BPE)
PIECES = ["a", "th", "e", " ", "  ", "\n", "\t", "é", "中文", "😀", "'s", "'ll", "23", ".", "!!", "<|endoftext|>", "\x85", "\xa0", " ", "\x1c", "²", "\r\n", "aaaaaaa", "\x00"]


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def split(flat, counts):
    ends = np.cumsum(counts)
    return [flat[e - c : e].tolist() for e, c in zip(ends, counts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), max_size=6))
def test_encoding_equals_library(texts):
    flat, counts = ChunkEncoder(VOCABULARY.encoder(), 1000)(texts)
    assert split(flat, counts) == [expected(t) for t in texts]
    assert VOCABULARY.decode(flat, counts) == texts


def test_small_cache_changes_nothing():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", f"w{rng.randint(0, 400)}"]) for _ in range(50)) for _ in range(40)]
    encoder = ChunkEncoder(VOCABULARY.encoder(), limit=20)
    for text in texts:
        flat, _ = encoder([text])
        assert flat.tolist() == expected(text)


def test_edge_rows(spark, edges):
    rows = bpe.decode(bpe.encode(edges, BYTE_BPE), BYTE_BPE).collect()
    assert len(rows) == len(EDGE_ROWS) and all(r.other == 7 for r in rows)
    assert sorted((r.ids, r.decoded) for r in rows) == sorted((expected(t), t or "") for _, t in EDGE_ROWS)
    assert bpe.encode(edges.limit(0), BYTE_BPE).count() == 0


def test_round_trip_equals_encode_and_decode(spark, edges):
    want = bpe.decode(bpe.encode(edges, BYTE_BPE), BYTE_BPE)
    got = bpe.round_trip(edges, BYTE_BPE)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert bpe.round_trip(edges.limit(0), BYTE_BPE).count() == 0


def test_one_python_worker_encodes_and_decodes(spark):
    """Two nodes in one stage keep two workers per core, each with imports and vocabulary."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (QUERIES["op10_bpe"](spark, SF), corpus_pipeline.encode_tokens(spark, docs, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_texts_are_encoded_in_small_slices(spark, monkeypatch):
    limits = []
    plain = bpe.append_columns
    monkeypatch.setattr(bpe, "append_columns", lambda df, text, added, fn, limit=common.SLICE_BYTES: limits.append(limit) or plain(df, text, added, fn, limit))
    QUERIES["op10_bpe"](spark, SF)
    assert limits and max(limits) <= 1 << 19


def test_decode_broken_bytes():
    ids = np.array([VOCABULARY.byte_id[0xE4]])
    assert VOCABULARY.decode(ids, np.array([1])) == ["�"]


def test_bpe_query(spark):
    found = {r.doc_id: r for r in QUERIES["op10_bpe"](spark, SF).collect()}
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = expected(row.text)
        assert found[row.doc_id].n_tokens == len(ids)
        assert found[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[row.doc_id].decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_records_query(spark):
    found = {r.doc_id: r for r in QUERIES["op5_binary_records"](spark, SF).collect()}
    start = 0
    for row in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*expected(row.text), 0]
        want = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (found[row.doc_id].start, found[row.doc_id].n_tokens, found[row.doc_id].ids_crc32) == want
        start += len(ids)


def test_records_of_edge_rows(spark, edges):
    path, index_path = scratch_path(spark, "r"), scratch_path(spark, "i")
    binary_records.write_records(edges.drop("key"), path, BYTE_BPE, file_bytes=50_000)
    binary_records.write_index(spark, path, index_path)
    index = spark.read.parquet(index_path)
    assert index.select("file").distinct().count() > 1
    rows = binary_records.with_starts(binary_records.read_records(spark, path), index).orderBy("start").collect()
    assert [r.key for r in rows] == sorted([k for k, _ in EDGE_ROWS], key=lambda k: -1 if k is None else k)
    assert sorted((r.key or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == sorted((k or -1, [*expected(t), 0]) for k, t in EDGE_ROWS)
    starts = np.cumsum([0, *[r.n_ids for r in rows]])
    assert [r.start for r in rows] == starts[:-1].tolist()
    shuffled = binary_records.read_shuffled(spark, path, index, seed=3).collect()
    got = [(key, ids.tolist()) for r in shuffled for key, ids, _, _ in binary_records.frames(bytes(r.record))]
    assert sorted(map(repr, got)) == sorted(repr((r.key, np.frombuffer(r.ids, "<u4").tolist())) for r in rows)


def test_records_of_empty_table(spark, edges):
    path = scratch_path(spark, "r")
    binary_records.write_records(edges.limit(0), path, BYTE_BPE)
    assert binary_records.read_records(spark, path).count() == 0


@pytest.mark.parametrize("place", [0, 9, 14, 20, -3, -1])
def test_damage_is_seen(place):
    record = bytearray(binary_records.frame(5, np.array([1, 70_000])) + b"\n")
    record[place] ^= 1
    with pytest.raises(binary_records.DamagedRecord):
        list(binary_records.frames(bytes(record)))


def test_wide_and_narrow_ids():
    for ids in ([1, 2], [1, 70_000], []):
        ((key, found, _, _),) = binary_records.frames(binary_records.frame(None, np.array(ids, dtype=np.int64)) + b"\n")
        assert key is None and found.tolist() == ids


def test_files_beyond_five_digits_stay_in_order(spark):
    names = [f"file:/x/part-{n:05d}-ab-c000.txt" for n in (99_999, 100_000, 100_001, 10_001, 2)]
    index = spark.createDataFrame([(name, n) for name, n in zip(names, (1, 10, 100, 1000, 10_000))], "file string, n_ids long")
    starts = {r.file: r.file_start for r in binary_records.file_starts(index).collect()}
    assert [starts[n] for n in names] == [11_000, 11_001, 11_011, 10_000, 0]
