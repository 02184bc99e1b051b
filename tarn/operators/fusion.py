"""Hybrid candidates: vector and lexical pools fused per subquery, structured nodes added, duplicates merged.

A candidate carries ``query_id``, ``sub`` (place of its subquery), ``seq`` (place in the whole candidate list) and the
columns of its passage; lists keep the order in which a sequential engine would meet them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.sources.lineage import written

from . import vector


def plans(queries: DataFrame, text: str = "query") -> DataFrame:
    """Adds defaults to missing ``intent``, ``subqueries`` and ``node_types``: fact, the query itself, paragraph; three subqueries at most."""
    for name, kind in (("intent", "string"), ("subqueries", "array<string>"), ("node_types", "array<string>")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.strip), lambda x: x != "")
    subs, kinds = clean(F.col("subqueries")), clean(F.col("node_types"))
    own = T.strip(F.coalesce(F.col(text), F.lit("")))
    return queries.withColumns(
        {
            "subqueries": F.slice(F.when(F.size(subs) > 0, subs).otherwise(F.array(F.when(own != "", own).otherwise(F.col(text)))), 1, 3),
            "node_types": F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("paragraph"))),
            "intent": F.when(T.is_blank(F.col("intent")), "fact").otherwise(T.strip(F.col("intent"))),
        }
    )


def subqueries(planned: DataFrame) -> DataFrame:
    """One row for each subquery: query_id, sub, query."""
    return planned.select("query_id", F.posexplode("subqueries").alias("sub", "query"))


def fused(near: DataFrame, lexical: DataFrame, alpha: float = 0.5, by: tuple[str, ...] = ("query_id", "sub"), key: str = "seq") -> DataFrame:
    """``near(by, key, dist, rank)`` and ``lexical(by, key, score, rank)`` joined fully; each side is min-max scaled over its own pool, a missing side is 0.

    The list is the vector hits in their order, then what only the lexical pool has.
    """
    keys = list(by)
    v = near.withColumn("vector", vector.scaled(vector.similarity(F.col("dist")), keys)).select(*keys, key, "vector", F.col("rank").alias("_v"))
    b = lexical.withColumn("bm25", vector.scaled(F.col("score"), keys)).select(*keys, key, "bm25", F.col("rank").alias("_b"))
    both = v.join(b, [*keys, key], "full_outer")
    both = both.withColumns({"vector": F.coalesce("vector", F.lit(0.0)), "bm25": F.coalesce("bm25", F.lit(0.0))})
    both = both.withColumn("score", F.lit(alpha) * F.col("vector") + F.lit(1 - alpha) * F.col("bm25"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_last(), "_b"))
    return both.withColumn("place", place).drop("_v", "_b")


def listed(candidates: DataFrame) -> DataFrame:
    """Adds ``at``: the place in a query's whole list, by subquery, then fused before structured, then place."""
    return candidates.withColumn("at", F.row_number().over(W.partitionBy("query_id").orderBy("sub", "stage", "place")))


def claimed(keys: DataFrame) -> DataFrame:
    """(query_id, at, first): for ``keys(query_id, at, key, text_key)`` the place of the candidate that each one is merged into, its own if none.

    In order of ``at``: a candidate goes to the kept one whose text it has, if that has another key; else to the kept one with its key; else it
    is kept, and its text is its own from then on. So a text that came under a key already kept claims nothing. A query's list is folded at once: its
    length is bounded by the limits of the pools.
    """
    kinds = {f.name: f.dataType.simpleString() for f in keys.schema}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        by_key: dict = {}
        by_text: dict = {}
        first = []
        for at, key, text in zip(pdf["at"], pdf["key"], pdf["text_key"], strict=True):
            owner = by_text.get(text)
            if owner is not None and owner != key:
                first.append(by_key[owner])
            elif key in by_key:
                first.append(by_key[key])
            else:
                by_key[key] = at
                by_text[text] = key
                first.append(at)
        return pd.DataFrame({"query_id": pdf["query_id"].to_numpy(), "at": pdf["at"].to_numpy(), "first": first})

    return keys.groupBy("query_id").applyInPandas(fold, f"query_id {kinds['query_id']}, at {kinds['at']}, first {kinds['at']}")


def keyed(passages: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_key`` and ``_text_key``, by which ``deduplicated`` tells candidates apart: a passage's are computed once, however many queries it is a candidate of."""
    has = lambda c: F.col(c) if c in passages.columns else None
    digest = T.document_key(F.col(text), source=has("source"), page=has("page"))
    key = F.coalesce(F.nullif(T.strip(F.coalesce("node_id", F.lit(""))), F.lit("")), digest) if "node_id" in passages.columns else digest
    return passages.withColumns({"_key": key, "_text_key": F.sha2(T.dedupe_key(F.coalesce(text, F.lit(""))), 256)})


def deduplicated(candidates: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
    """Candidates with one id, or one folded text, are merged as ``claimed`` says: the first one's passage stays, with the largest score and, for each
    source, the last score given. The id is ``node_id``; where that is blank or missing, a digest of source, page and text.
    """
    sources = [c for c in ("vector", "bm25", "structured") if c in candidates.columns]
    names = [c for c in candidates.columns if c not in ("query_id", score, "at", "_key", "_text_key", *sources)]
    own = candidates if "_key" in candidates.columns else keyed(candidates, text)
    # merged without the passages, of which the first ones alone are looked up again
    slim = written(own.select("query_id", "at", score, *sources, "_key", "_text_key"), "candidates")
    first = claimed(slim.select("query_id", "at", F.col("_key").alias("key"), F.col("_text_key").alias("text_key")))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    sums = [F.max(score).alias(score), F.count(F.lit(1)).alias("merged"), *[last(c) for c in sources]]
    merged = slim.join(first.withColumnRenamed("first", "_to"), ["query_id", "at"]).groupBy("query_id", "_to").agg(*sums).withColumnRenamed("_to", "at")
    return candidates.select("query_id", "at", *names).join(merged, ["query_id", "at"]).select("query_id", *names, score, "at", "merged", *sources)
