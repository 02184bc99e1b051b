"""Session state in streams, and incremental indexing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarn.functions import text as T
from tarn.operators import embed, lexical

STATE = "items array<string>"
OUTPUT = "thread_id string, items array<string>, size int"


def accumulated(rows: DataFrame) -> DataFrame:
    """Streaming append-or-reset over rows (thread_id, item, reset): after each micro-batch a thread's list.

    A batch with any true reset empties the thread's list and drops its own items too. State is kept by thread.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else ([],)
        held = list(held)
        fresh: list[str] = []
        reset = False
        for pdf in batches:
            reset |= bool(pdf["reset"].fillna(False).astype(bool).any())
            fresh += pdf["item"].tolist()
        held = [] if reset else held + fresh
        state.update((held,))
        yield pd.DataFrame({"thread_id": [key[0]], "items": [held], "size": [len(held)]})

    return rows.groupBy("thread_id").applyInPandasWithState(fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def newest(batch: DataFrame) -> DataFrame:
    """Of rows (seq, text, _time, _file) that bring one document several times the one whose file is the latest, by time and then by name; further ties by text."""
    latest = W.partitionBy("seq").orderBy(F.col("_time").desc(), F.col("_file").desc(), F.col("text").desc_nulls_last())
    named = batch.withColumn("_n", F.row_number().over(latest)).select("seq", "text", "_n")
    return named.filter("_n = 1 and seq is not null").drop("_n")


def ingest(spark: SparkSession, source: str, base: str, checkpoint: str, vectors: str | None = None, embedder: Callable[[Column], Column] | None = None, max_files: int | None = None, columns: dict[str, str] | None = None):
    """Watches a folder of (seq, text) Parquet files (or ``columns`` of other names) and indexes what is new; a document that comes again replaces its earlier text, one
    that comes without text is removed.

    Below ``base`` each batch adds ``texts(seq, len, text)``, ``docs(seq, len)``, ``postings(seq, term, tf, len)`` and ``changes(term, df, cf)``: what its documents add to
    the terms' figures, less what the versions they replace had added. Nothing older is rewritten, and of older batches only those are
    read that hold a replaced version. A batch's folders are named by its number, so a batch that is tried again replaces itself; ``index_of`` merges
    when it reads. The started query runs until the files that are there are done.
    """

    def write(batch: DataFrame, number: int) -> None:
        at = f"batch={number}"
        rows = newest(batch)
        n = F.size(T.tokens(F.col("text")))
        rows.select("seq", n.alias("len"), "text").write.mode("overwrite").parquet(f"{base}/texts/{at}")
        rows = spark.read.parquet(f"{base}/texts/{at}")
        rows.select("seq", "len").write.mode("overwrite").parquet(f"{base}/docs/{at}")
        lexical.build(rows).postings.write.mode("overwrite").parquet(f"{base}/postings/{at}")
        added = spark.read.parquet(f"{base}/postings/{at}").select("term", F.lit(1).alias("df"), F.col("tf").alias("cf"))
        gone = replaced(spark, base, number)
        changes = added if gone is None else added.unionByName(gone.select("term", F.lit(-1).alias("df"), (-F.col("tf")).alias("cf")))
        changes.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df <> 0 or cf <> 0").write.mode("overwrite").parquet(f"{base}/changes/{at}")
        if vectors is not None:
            rows.filter("len > 0").select("seq", (embedder or embed.hashed)(F.col("text")).alias("embedding")).write.mode("overwrite").parquet(f"{vectors}/{at}")

    names = {"seq": "seq", "text": "text"} | (columns or {})
    reader = spark.readStream.schema(f"`{names['seq']}` long, `{names['text']}` string")
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    folder, _, name = source.rstrip("/").rpartition("/")
    # as a pattern, which may also name a single file
    rows = reader.parquet(f"{folder}/{{{name}}}" if folder and not set("*?[]{}") & set(source) else source).select(F.col(names["seq"]).alias("seq"), F.col(names["text"]).alias("text"), F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_file"))
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replaced(spark: SparkSession, base: str, number: int) -> DataFrame | None:
    """The postings that the documents of a batch had before it; None if there are none."""
    incoming = spark.read.parquet(f"{base}/docs/batch={number}").select("seq")
    earlier = spark.read.option("basePath", f"{base}/docs").parquet(f"{base}/docs").filter(F.col("batch") < number)
    held = current(earlier.join(incoming, "seq", "left_semi")).filter("len > 0").select("seq", "batch")
    touched = [r[0] for r in held.select("batch").distinct().collect()]  # numbers of batches
    if not touched:
        return None
    return spark.read.parquet(f"{base}/postings").filter(F.col("batch").isin(touched)).join(held, ["seq", "batch"], "left_semi")


def current(docs: DataFrame) -> DataFrame:
    """(seq, len, batch): each document's newest version."""
    return docs.groupBy("seq").agg(F.max_by("len", "batch").alias("len"), F.max("batch").alias("batch"))


def index_of(spark: SparkSession, base: str) -> lexical.LexicalIndex:
    """The lexical index of all documents as they stand after the batches so far. Term figures are sums of changes; no posting is counted again."""
    docs = current(spark.read.parquet(f"{base}/docs")).filter("len > 0")
    postings = spark.read.parquet(f"{base}/postings").join(docs.select("seq", "batch"), ["seq", "batch"], "left_semi").select("term", "seq", "tf", "len")
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    return lexical.LexicalIndex(docs.select("seq", "len"), postings, lexical.idf_of(term_figures(spark, base).select("term", "df"), stats), stats)


def term_figures(spark: SparkSession, base: str) -> DataFrame:
    """(term, df, cf) of all terms that a document has."""
    return spark.read.parquet(f"{base}/changes").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")


def vectors_of(spark: SparkSession, base: str, vectors: str) -> DataFrame:
    """(seq, embedding) of the newest version of each document that has text."""
    docs = current(spark.read.parquet(f"{base}/docs")).filter("len > 0").select("seq", "batch")
    return spark.read.parquet(vectors).join(docs, ["seq", "batch"], "left_semi").drop("batch")
