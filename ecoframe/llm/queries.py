"""Named queries of the operators over whole tables, with SQL where it can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecoframe.llm import binary_records, bpe, decontaminate, html_extract, language_id, line_dedup, onebit_search, packing, simhash, spelling, toxicity, url_reputation, whitening
from ecoframe.llm.common import held_out, small_batches, table
from ecoframe.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def language_model(docs: DataFrame) -> language_id.LanguageModel:
    """Learned from rows outside the held-out fifth."""
    return language_id.fit(docs.where(~held_out("doc_id", 5, 0)), PIECES)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    texts = html_extract.extract(pages.select("page_id", "url", "html"), html_extract.fit(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url; outcomes are taken from the pages' own symbols."""
    pages = table(spark, sf_dir, "pages")
    host, _ = url_reputation.url_parts(F.col("url"))
    outcomes = pages.select(host.alias("host"), url_reputation.symbol_outcome(F.col("html")).alias("bad"))
    judged = url_reputation.judge_urls(pages.select("page_id", "url"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _level_sql(groups: str, parent: str) -> str:
    """The strength of one level's prior."""
    return f"""(SELECT 1 / least(greatest(coalesce(
        sum(n * pow(bad / n - {parent}, 2) - {parent} * (1 - {parent})) / nullif(sum((n - 1) * {parent} * (1 - {parent})), 0), 0.95),
        0.001), 0.95) - 1 FROM {groups} WHERE n > 0)"""


ORACLES["op3_url_filter"] = f"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), parts AS (
  SELECT page_id, html, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM named
), outcome AS (
  SELECT host, CASE WHEN length(html) > 0
    THEN (length(html) - length(translate(html, '#$%*', '')) > 0.03 * length(html))::INT END AS bad FROM parts
), plain AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
    regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM outcome GROUP BY host
), split AS (
  SELECT *, string_split(name, '.') AS labels FROM plain
), hosts AS (
  SELECT host, n, bad, array_to_string(labels[-2:], '.') AS domain, labels[-1] AS suffix FROM split
), s1 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM hosts) AS m0 FROM hosts GROUP BY suffix
), s2 AS (SELECT *, {_level_sql("s1", "m0")} AS k FROM s1), s3 AS (SELECT suffix, (bad + k * m0) / (n + k) AS m1 FROM s2),
d1 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix, domain),
d2 AS (SELECT * FROM d1 JOIN s3 USING (suffix)),
d3 AS (SELECT *, {_level_sql("d2", "m1")} AS k FROM d2), d4 AS (SELECT suffix, domain, (bad + k * m1) / (n + k) AS m2 FROM d3),
h2 AS (SELECT * FROM hosts JOIN d4 USING (suffix, domain)),
h3 AS (SELECT *, {_level_sql("h2", "m2")} AS k FROM h2),
h4 AS (SELECT host, (bad + k * m2) / (n + k) AS mean, n + k AS weight FROM h3),
h5 AS (SELECT host, greatest(0, mean - {url_reputation.Z} * sqrt(mean * (1 - mean) / (weight + 1))) AS lower FROM h4),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN lower > {url_reputation.MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN h5 USING (host)
"""


@query
def op4_onebit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return onebit_search.nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors)


@query
def op5_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from the record files."""
    path, index_path = scratch_path(spark, "records"), scratch_path(spark, "index")
    binary_records.write_records(table(spark, sf_dir, "documents"), path, BYTE_BPE)
    binary_records.write_index(spark, path, index_path)
    records = binary_records.with_starts(binary_records.read_records(spark, path), spark.read.parquet(index_path))
    return records.select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and dropped, and a hash of what stays, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLES["op6_line_dedup"] = """
WITH numbered AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM numbered
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT keyed.*, coalesce(doc_id <> keeper, false) AS lost FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(lost::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; counts and curve come from different labelled rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = toxicity.labelled(docs, table(spark, sf_dir, "labels"), "doc_id", "toxic")
    curved = held_out("doc_id", 4, 3)
    model = toxicity.fit(known.where(~held_out("doc_id", 4, 2) & ~curved), known.where(curved))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by every document (mostly none)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct("matches.item_id")).alias("item_ids"),
        F.coalesce(F.array_max("matches.similarity"), F.lit(0.0)).alias("similarity"),
    )


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id")


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, BYTE_BPE).select("doc_id", *bpe.token_digest())


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    pieces = packing.cut(table(spark, sf_dir, "documents"), WORD_BPE)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(digest)


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, frequent form and root of every repeated word."""
    counts = spelling.count_words(table(spark, sf_dir, "documents"), damage=spelling.DAMAGE)
    return spelling.group_variants(counts.where(F.col("n") >= spelling.MIN_COUNT))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened coordinates of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
