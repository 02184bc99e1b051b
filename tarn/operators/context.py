"""From ranked candidates to a context: neighbours or sections in place of hits, then packing under a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.sources.lineage import among, written

LEAST_BUDGET = 200


def windows(nodes: DataFrame, counter: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """For each paragraph with a parent: the non-blank siblings at most one ``order`` away, merged.

    (node_id, merged_text, merged_ids, merged_tokens, merged_count). A range frame, so gaps in the order break adjacency.
    """
    nodes = nodes.withColumn("_tokens", F.coalesce(F.nullif("token_count", F.lit(0)), counter(F.col("text"))))
    near = W.partitionBy("parent_id").orderBy("order").rangeBetween(-1, 1)
    kept = F.when(~T.is_blank(F.col("text")), F.struct("order", "node_id", "text", F.col("_tokens").alias("tokens")))
    own = nodes.filter(F.col("parent_id").isNotNull()).withColumn("_near", F.collect_list(kept).over(near)).withColumn("_near", F.array_sort("_near"))
    own = own.filter((F.col("node_type") == "paragraph") & (F.size("_near") > 1))
    return own.select(
        "node_id",
        F.array_join(F.transform("_near", lambda x: T.strip(x["text"])), "\n\n").alias("merged_text"),
        F.transform("_near", lambda x: x["node_id"]).alias("merged_ids"),
        F.aggregate("_near", F.lit(0), lambda a, x: a + x["tokens"].cast("int")).alias("merged_tokens"),
        F.size("_near").alias("merged_count"),
    )


def expanded(candidates: DataFrame, nodes: DataFrame | None, counter: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """Adds ``packed_text``, ``packed_id``, ``packed_tokens``, ``merged_ids``, ``expansion`` and ``is_parent_context`` to each candidate.

    A summary plan that asks for sections turns a paragraph into its section if that has at most three times its tokens
    (300 at least are allowed); otherwise a paragraph grows by its neighbours. Without nodes a candidate stays itself.
    """
    own = F.coalesce(F.nullif(F.col("token_count"), F.lit(0)), counter(F.col("text"))) if "token_count" in candidates.columns else counter(F.col("text"))
    c = candidates.withColumn("_tokens", own)
    if nodes is None:
        return c.withColumns({"packed_text": F.col("text"), "packed_id": F.col("node_id") if "node_id" in c.columns else F.lit(None).cast("string"), "packed_tokens": F.col("_tokens"), "merged_ids": F.array().cast("array<string>"), "expansion": F.lit("none"), "is_parent_context": F.lit(False)}).drop("_tokens")
    # only families that a candidate belongs to are merged, and only their parents are counted
    wanted = written(candidates.select("parent_id").filter(F.col("parent_id").isNotNull()).distinct(), "families")
    merged = windows(among(nodes, wanted, "parent_id"), counter)
    parents = among(nodes, wanted.withColumnRenamed("parent_id", "node_id"), "node_id").select(F.col("node_id").alias("_pid"), F.col("node_type").alias("_ptype"), F.col("text").alias("_ptext"), F.coalesce(F.nullif("token_count", F.lit(0)), counter(F.col("text"))).alias("_ptokens"))
    c = c.join(parents, c["parent_id"] == parents["_pid"], "left").join(merged, "node_id", "left")
    section = (F.col("intent") == "summary") & F.array_contains("node_types", "section") & (F.col("node_type") == "paragraph") & (F.col("_ptype") == "section") & ~T.is_blank(F.col("_ptext")) & (F.col("_ptokens") <= F.greatest(F.lit(300), 3 * F.col("_tokens")))
    section, grown = F.coalesce(section, F.lit(False)), F.col("merged_text").isNotNull()
    pick = lambda a, b, d: F.when(section, a).when(grown, b).otherwise(d)
    return c.withColumns(
        {
            "expansion": pick(F.lit("section"), F.lit("window"), F.lit("none")),
            "packed_text": pick(F.col("_ptext"), F.col("merged_text"), F.col("text")),
            "packed_id": pick(F.col("_pid"), F.element_at("merged_ids", 1), F.col("node_id")),
            "packed_tokens": pick(F.col("_ptokens"), F.col("merged_tokens"), F.col("_tokens")).cast("int"),
            "merged_ids": pick(F.array().cast("array<string>"), F.col("merged_ids"), F.array().cast("array<string>")),
            "is_parent_context": section,
        }
    ).drop("_pid", "_ptype", "_ptext", "_ptokens", "merged_text", "merged_tokens", "merged_count", "_tokens")


def packed(candidates: DataFrame, k: int = 10, budget: int = 1800, key: str = "packed_key", tokens: str = "packed_tokens", position: str = "position") -> DataFrame:
    """The passages of each query: candidates in order, a repeated key skipped, one over the budget skipped and the scan continued; the first is
    always taken, ``k`` at most.

    (query_id, slot, position, total_tokens, dropped). A fold over a list that the candidate pools bound (a few hundred structs).
    """
    budget = max(budget, LEAST_BUDGET)
    rows = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("position"), F.col(key).alias("key"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens")))).alias("rows"))
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<string>").alias("keys"), F.lit(0).cast("long").alias("total"))

    def step(a, x):
        fits = (F.size(a["taken"]) == 0) | (a["total"] + x["tokens"] <= budget)
        take = fits & (F.size(a["taken"]) < k) & ~F.coalesce(F.array_contains(a["keys"], x["key"]), F.lit(False))
        return F.when(take, F.struct(F.concat(a["taken"], F.array(x["position"])).alias("taken"), F.concat(a["keys"], F.array(x["key"])).alias("keys"), (a["total"] + x["tokens"]).alias("total"))).otherwise(a)

    done = rows.withColumn("out", F.aggregate("rows", start, step))
    return done.select("query_id", F.col("out.total").alias("total_tokens"), F.greatest(F.lit(0), F.size("rows") - F.size("out.taken")).alias("dropped"), F.posexplode("out.taken").alias("slot", "position"))
