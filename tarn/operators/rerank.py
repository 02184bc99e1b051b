"""Rule-based boosts, the final order, and an optional pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import text as T

from .profile import Profile

# The weights of the boosts.
TITLE, NODE_TYPE, CORPUS, KEYWORD, ENTITY, PENALTY = 0.15, 0.08, 0.12, 0.08, 0.10, 0.12


def _column(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def boosted(candidates: DataFrame, profile: Profile | None = None, query: str = "query") -> DataFrame:
    """Adds the boosts as columns (0 where one doesn't apply) and ``final_score``.

    ``candidates`` carry the call's query, the plan's ``node_types`` and passage columns; missing titles count as empty.
    """
    profile = profile or Profile()
    c = candidates.withColumn("_q", T.terms(F.col(query)))
    title = F.concat_ws(" ", _column(c, "title"), _column(c, "parent_title"))
    c = c.withColumn("_title", T.terms(title)).withColumn("_all", T.terms(F.concat_ws(" ", title, _column(c, "source"), F.coalesce("text", F.lit("")))))

    def share(words: list[str], cap: float) -> Column:
        if not words:
            return F.lit(0.0)
        return T.rounded(F.least(F.lit(cap), F.size(F.array_intersect("_all", F.array(*map(F.lit, words)))) / len(words)), 4)

    strange = F.size(F.array_intersect("_q", "_all")) == 0
    kinds = F.array_contains(F.col("node_types"), F.col("node_type")) if "node_type" in c.columns and "node_types" in c.columns else F.lit(False)
    c = c.withColumns(
        {
            "title_boost": T.rounded(TITLE * T.overlap(F.col("_q"), F.col("_title")), 4),
            "type_boost": F.when(F.coalesce(kinds, F.lit(False)), NODE_TYPE).otherwise(0.0),
            "corpus_boost": share(profile.covered(), CORPUS),
            "keyword_boost": share(profile.terms("domain_keywords"), KEYWORD),
            "entity_boost": share(profile.terms("primary_entities"), ENTITY),
            "penalty": F.when(strange, 0.0 - share(profile.terms("non_coverage", "forbidden_questions"), PENALTY)).otherwise(0.0),
        }
    ).drop("_q", "_title", "_all")
    boosts = ("title_boost", "type_boost", "corpus_boost", "keyword_boost", "entity_boost", "penalty")
    return c.withColumn("final_score", sum((F.col(b) for b in boosts), F.col("score")))


def ordered(candidates: DataFrame) -> DataFrame:
    """Adds ``position``: by final score, ties in list order. Scores are compared at nine digits."""
    return candidates.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(T.rounded(F.col("final_score"), 9).desc(), "at")))


def debug_rows(candidates: DataFrame, k: int = 10) -> DataFrame:
    """The first 2k of each query with their scores and boosts at four digits, to see why they stand where they do."""
    names = ("title_boost", "type_boost", "corpus_boost", "keyword_boost", "entity_boost", "penalty")
    kept = [c for c in ("node_id", "seq", "node_type") if c in candidates.columns]
    return candidates.filter(F.col("position") <= 2 * k).select("query_id", "position", *kept, *[T.rounded(F.col(c), 4).alias(c) for c in ("score", "final_score", *names)])


Scorer = Callable[[str, list[str]], list[float]]


def cross_encoded(candidates: DataFrame, scorer: Scorer | None, top_n: int = 10, query: str = "query") -> DataFrame:
    """The first ``top_n`` of each query in the order of ``scorer``, the others behind by final score.

    Adds ``scorer_boost`` = 1 / rank after sorting; without a scorer the order stays. A scorer that raises leaves its query's
    order as it was. Only top_n rows a query reach Python.
    """
    if scorer is None:
        return candidates.withColumn("scorer_boost", F.lit(0.0))
    head = candidates.filter(F.col("position") <= top_n).select("query_id", F.col(query).alias("q"), "position", F.col("text").alias("t"))

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        try:
            scores = scorer(pdf["q"].iloc[0], list(pdf["t"]))
        except Exception:  # noqa: BLE001  the hook is foreign code
            return pd.DataFrame({"query_id": [], "position": [], "scored": []})
        order = sorted(range(len(pdf)), key=lambda i: -scores[i])
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[order].to_numpy(), "position": pdf["position"].iloc[order].to_numpy(), "scored": range(len(order))})

    ranks = head.groupBy("query_id").applyInPandas(rank, "query_id long, position int, scored int")
    both = candidates.join(ranks, ["query_id", "position"], "left")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("scored").asc_nulls_last(), F.col("position")))
    both = both.withColumn("_new", place).withColumn("scorer_boost", F.when(F.col("scored").isNotNull(), T.rounded(1.0 / (F.col("scored") + 1), 4)).otherwise(0.0))
    return both.withColumn("position", F.col("_new")).drop("_new", "scored")
