"""The text operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import bpe, crf, decontaminate, langid, maskedlm, ogg, simhash, subdedup, tokencount, urlfilter
from orbweave.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op3_decontamination"] = f"""
WITH items AS (SELECT row_number() OVER () AS k, item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT k, item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM docs, (SELECT DISTINCT n FROM windows) AS l, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT DISTINCT r, i, n, k, item_id FROM places JOIN windows USING (n, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, k, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


@query("op4_ogg_media")
def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ogg.read(ogg.store(read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subdedup.deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", (F.size("cut_spans") / 2).cast("int").alias("n_cut"), "cut_spans")


@query("op7_line_quality")
def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = crf.score(docs, crf.fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op8_masked_lm")
def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return maskedlm.score(docs, maskedlm.fit(docs))


#: Rules by verdict, and blocked domains for URLs that no rule fits.
BLOCK_RULES = ("net/", "example.com/de/")
ALLOW_RULES = ("example.net/en/", "org/fr/")
BLOCKED_DOMAINS = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


@query("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), BLOCK_RULES, ALLOW_RULES, BLOCKED_DOMAINS)


_RULES = [(r.partition("/")[0], r[r.index("/") :], r, v) for v, rules in (("block", BLOCK_RULES), ("allow", ALLOW_RULES)) for r in rules]
ORACLES["op9_url_filter"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), halves AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM halves
), rules(h, p, rule, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{r}', '{v}')" for h, p, r, v in _RULES)}
), fitting AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), best AS (SELECT * FROM fitting WHERE k = 1)
SELECT u.page_id, host, path, b.rule, coalesce(b.verdict, CASE WHEN EXISTS (
    SELECT 1 FROM (VALUES {", ".join(f"('{d}')" for d in BLOCKED_DOMAINS)}) AS t(d) WHERE u.host = d OR ends_with(u.host, '.' || d)) THEN 'block' ELSE 'allow' END) AS verdict
FROM urls u LEFT JOIN best b ON u.page_id = b.page_id
"""


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))
