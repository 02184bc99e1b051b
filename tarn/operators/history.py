"""Conversation state as tables: history windows and folds with reset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window(messages: DataFrame, keep: int = 6, least: int = 4, roles: tuple[str, ...] = ("user", "assistant"), by: str = "conv_id") -> DataFrame:
    """The last ``keep`` eligible messages before each conversation's latest one; none where it has fewer than ``least``. Adds ``recency`` from 1."""
    whole = W.partitionBy(by)
    m = messages.withColumns({"_n": F.count(F.lit(1)).over(whole), "_last": F.max("turn").over(whole)})
    kept = m.filter((F.col("_n") >= least) & (F.col("turn") < F.col("_last")) & F.col("role").isin(*roles))
    if "tool_calls" in messages.columns:
        kept = kept.filter(F.coalesce(F.col("tool_calls"), F.lit(0)) == 0)
    kept = kept.withColumn("recency", F.row_number().over(W.partitionBy(by).orderBy(F.col("turn").desc())))
    return kept.filter(F.col("recency") <= keep).drop("_n", "_last")


def transcript(windowed: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, transcript): the window's lines, oldest first."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("text", F.lit("")))
    rows = windowed.withColumn("_line", line).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("turn", "_line"))).alias("_l"))
    return rows.select(by, F.concat(F.lit("Conversation history:\n"), F.array_join(F.transform("_l", lambda x: x["_line"]), "\n")).alias("transcript"))


def accumulated(rows: DataFrame, by: str = "thread_id", batch: str = "batch_id", reset: str = "reset") -> DataFrame:
    """The rows that an append-or-reset fold leaves: a batch with any true reset empties the list and is discarded whole."""
    last = F.max(F.when(F.col(reset), F.col(batch))).over(W.partitionBy(by))
    kept = rows.withColumn("_r", last).filter(F.col("_r").isNull() | (F.col(batch) > F.col("_r")))
    return kept.drop("_r")


def reduced(rows: DataFrame, by: str, keys: str, counts: list[str]) -> DataFrame:
    """Union of a key set and sums of counters."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(keys)).alias(keys), *[F.sum(c).alias(c) for c in counts])
