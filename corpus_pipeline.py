"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing sources to their weights, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, lines, mixing, neardup, quality
from tarn.llm.common import scratch, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go.

    Null and blank texts fail the base rules; rows that share a doc_id stay if one of them does; a null language, source or id is a value of
    its own. Here and in all stages columns beyond those of documents go, whatever their names, and an empty table stays empty.
    """
    return quality.kept_documents(docs.select(COLUMNS)).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents or more hold stay in the last of them only; n_chars follows the text.

    Rows that share a doc_id count as one document, null ids as one that is smaller than all others; a null text becomes an empty one.
    """
    docs = docs.select(COLUMNS)
    cleaned = lines.LineIndex.build(docs, keep_postings=False).cleaned(docs)
    return cleaned.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more of their five-word shingles the one with the smallest id stays.

    The SimHash operator's self-join goes first, its pairs are checked exactly, prefix filters complete them (see ``tarn.llm.neardup``). Null
    ids come last; rows alike in id and text are one; other rows that share an id are judged by their texts.
    """
    return neardup.deduplicated(docs.select(COLUMNS)).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; blank texts are never taken, rows alike in every column are taken together."""
    return mixing.mixed_documents(docs.select(COLUMNS)).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded text, and the ids as little-endian unsigned 32-bit integers; one row a row."""
    return bpe.encode_documents(docs.select(COLUMNS), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("tokens", tokens),
]

#: SQL can't express the near-duplicate stage's chains of links or the mixing stage's draws; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's own intermediate tables go when it is written; the stages' tables stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/tarn/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
