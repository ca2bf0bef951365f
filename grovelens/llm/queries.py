"""The registered queries opN_<name> with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelens.llm import decontam, jaccard, langid, licenses, lmscore, packing, pii, quality, tokencount, urlfilter
from grovelens.llm.common import shared_dir, table

TOKENIZER = "byte_bpe_50k.json"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.judge(pages, urlfilter.rule_table(spark, urlfilter.CONTRACT_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(of(*pii.BASE)), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(licenses.scan(table(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("mark")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_found", "n_shingles")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_shingles").alias("n_shingles"), F.col("best.n_found").alias("n_found"), F.col("best.containment").alias("containment"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own: with the kept one, a second run in a session would encode nothing, and its figures would say little
    cache = f"{shared_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), cache=cache)


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_packing, op3_pii, op4_lm_scoring, op5_licenses, op6_language_id, op7_jaccard_join, op8_decontamination, op9_quality_rules, op10_token_counts)}

ORACLE_SQL = {
    "op1_url_filters": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        fit AS (
            SELECT *, (SELECT max(length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS size FROM parts)
        SELECT page_id, host, path, h || p AS rule, coalesce(verdict, 'allow') AS verdict
        FROM fit LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) AND length(h || p) = size
    """,
    "op8_decontamination": r"""
        WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
        ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d WHERE len(w) >= 5),
        b AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
        bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b WHERE len(w) >= 5),
        short AS (SELECT DISTINCT item_id, array_to_string(w, ' ') AS s FROM b WHERE len(w) < 5 AND w[1] <> ''),
        n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
        f AS (SELECT doc_id, item_id, count(*) AS found FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n AS n_shingles, found AS n_found, found / n AS containment
        FROM f JOIN n USING (item_id) WHERE found >= ceil(n * 0.8 - 1e-9)
        UNION ALL SELECT DISTINCT doc_id, item_id, 1, 1, 1.0 FROM short JOIN d ON contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || s || ' ')
    """,
}
