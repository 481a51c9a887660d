"""A corpus pipeline of five stages; each calls one operator of quillgraph.llm and returns documents for the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's result
to the shared folder and gives it to the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, decontaminate, near_dup, quality, secret_scan
from quillgraph.llm.common import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, by their text alone: null and empty texts are judged like any other (as
    statistics of nothing), rows without doc_id too, and repeated rows all stay or go. An empty table stays empty."""
    return quality.good(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Where that doc_id has several texts in the group, the one with the smallest hash stays; of rows that repeat doc_id and text one
    stays. Documents without words or doc_id are in no group and stay. An empty table stays empty."""
    return near_dup.one_of_each(docs).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark. Null, empty and very short texts share none; repeated rows and rows
    without doc_id are judged by their texts. With an empty benchmark all stay; an empty table stays empty."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced, and n_chars follows the text. Null texts stay null, with n_chars null; other
    rows without a secret, repeated ones and those without doc_id among them, keep their texts. An empty table stays empty."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of the bytes they decode to, for every row; null texts have no tokens."""
    return bpe.digests(docs, *bpe.default_vocabulary())


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the forest: tests/llm/test_pipeline.py compares each stage with a plain version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
