"""A corpus pipeline: five stages over the documents table, each written as Parquet and read again by the next.

1. language: documents without a letter, or in none of the labelled languages, go.
2. near_dedup: of each component of linked SimHash fingerprints, the document with the least id stays.
3. substring_dedup: passages kept elsewhere are cut out; documents of which nothing is left go.
4. decontaminate: documents that the benchmark's windows contaminate go.
5. encode: byte-level BPE ids of every document that is left, with the digests of ids and decoded bytes.

``n_chars`` follows the text where a stage changes it. Each stage works on all its predecessor kept. Every stage but the last
returns its input's columns, whatever else the table has; an empty table goes through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import bpe, decontaminate, langid, simhash, subdedup
from orbweave.llm.common import Cuts

#: SQL can't express the stages: automata, fingerprints, components and merges.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no letter and go. Without any labelled text all documents go."""
    return langid.keep_known(docs, langid.fit(docs, everything=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of repeated rows one stays. Null, empty and blank texts are equal to each other. Rows without an id stay."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and rows without an id are left as they are; a text goes if cutting leaves nothing but white space of it."""
    cut = subdedup.deduplicate(docs)
    left = cut.where((F.size("cut_spans") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    changed = F.when(F.size("cut_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return left.select(*(changed.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are clean. An empty benchmark contaminates nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row; null texts are encoded as empty ones."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminated), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = Cuts(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, cuts.cut(stage(spark, docs, sf_dir))
        cuts.drop(before)
    return docs
