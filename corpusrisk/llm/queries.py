"""The ``opN_`` queries: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.llm.byte_bpe import byte_bpe
from corpusrisk.llm.common import load
from corpusrisk.llm.exact_dedup import exact_dedup
from corpusrisk.llm.hard_negatives import hard_negatives
from corpusrisk.llm.html_text import main_text
from corpusrisk.llm.importance import importance_resample
from corpusrisk.llm.language_id import language_id
from corpusrisk.llm.packing import best_fit_packing
from corpusrisk.llm.quality_classifier import quality_scores
from corpusrisk.llm.quality_rules import quality_rules
from corpusrisk.llm.sharding import balanced_shards
from corpusrisk.llm.simhash import simhash_near_dedup
from corpusrisk.llm.suffix_dedup import suffix_dedup
from corpusrisk.llm.warc import audited_archive

SQL_SPACE = r"[\x20\x09-\x0D]"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file (never copied)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "component_size")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(load(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = byte_bpe(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_docs", "host_failed"
    )


SQL_OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, host, text, list_filter(string_split_regex(text, '{SQL_SPACE}+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, [words[i], words[i + 1], words[i + 2]] AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT w.rid, doc_id, host, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '{SQL_SPACE}+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.rid = cov.rid),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines) AS failed FROM m),
h AS (SELECT host, count(*) AS host_docs, sum(failed::BIGINT)::BIGINT AS host_failed FROM f GROUP BY host),
p AS (SELECT sum(host_failed) / sum(host_docs) AS m, coalesce(var_samp(host_failed / host_docs), 0) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 1000.0 END AS strength FROM p),
ok AS (SELECT host, host_docs, host_failed, (host_failed + m * strength) / (host_docs + strength) <= 0.5 AS host_ok FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND host_ok) AS kept, f.host, host_docs, host_failed
FROM f JOIN ok ON f.host IS NOT DISTINCT FROM ok.host
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL_OP9 = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SQL_SPACE}+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(load(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(load(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


DRILL = 997  # the audit drill damages the stored copy of pages whose id is 5 modulo this


def op10_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages, written, read back and audited; a drill overwrites the first
    character of some stored pages, which the audit has to locate among all records."""
    pages = load(spark, sf_dir, "pages")
    hurt = (F.col("page_id") % DRILL == 5) & (F.length("html") > 0)
    stored = pages.withColumn("html", F.when(hurt, F.expr("overlay(html PLACING '~' FROM 1 FOR 1)")).otherwise(F.col("html")))
    return audited_archive(pages, stored).select(
        F.col("record_id").alias("page_id"), "url", F.col("idx").alias("record_no"), "offset", "length", "sha256", "status", "replica_sha256"
    )


SQL_OP10 = rf"""
WITH s AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
                  CASE WHEN page_id % {DRILL} = 5 AND length(html) > 0 THEN '~' || substr(html, 2) ELSE coalesce(html, '') END AS rot FROM pages),
c AS (SELECT chr(13) || chr(10) AS nl),
h AS (SELECT page_id, url, html, rot, nl,
             'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'null') || '>' || nl
             || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || regexp_replace(url, '[
]', ' ', 'g') || nl
             || 'Content-Type: text/html' || nl || 'Content-Length: ' AS head FROM s, c),
r AS (SELECT page_id, url, head || strlen(html) || nl || nl || html || nl || nl AS rec, head || strlen(rot) || nl || nl || rot || nl || nl AS rep FROM h),
d AS (SELECT page_id, url, strlen(rec)::BIGINT AS length, sha256(rec) AS sha256, sha256(rep) AS replica_sha256 FROM r)
SELECT page_id, url, row_number() OVER w - 1 AS record_no, (sum(length) OVER (w ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS "offset", length, sha256,
       CASE WHEN sha256 = replica_sha256 THEN 'intact' ELSE 'changed' END AS status, replica_sha256
FROM d WINDOW w AS (ORDER BY page_id NULLS FIRST, url, sha256)
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


SQL_OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.c, b.c)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(load(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {
    "op1_simhash_near_dedup": (op1_simhash_near_dedup, None),
    "op2_quality_classifier": (op2_quality_classifier, None),
    "op3_best_fit_packing": (op3_best_fit_packing, None),
    "op4_suffix_array_dedup": (op4_suffix_array_dedup, None),
    "op5_byte_bpe": (op5_byte_bpe, None),
    "op6_quality_rules": (op6_quality_rules, SQL_OP6),
    "op7_language_id": (op7_language_id, None),
    "op8_sharding": (op8_sharding, None),
    "op9_exact_dedup": (op9_exact_dedup, SQL_OP9),
    "op10_warc_fixity_audit": (op10_warc_fixity_audit, SQL_OP10),
    "op11_hard_negatives": (op11_hard_negatives, SQL_OP11),
    "op12_importance_resampling": (op12_importance_resampling, None),
    "op13_html_extraction": (op13_html_extraction, None),
}


def llm_catalog() -> dict:
    return dict(QUERIES)
