"""The research loop as rounds over a table of open branches.

A branch is one question of a query. Every round is one retrieval for all branches that are still open; what it finds is evidence, and a policy
reads it and says for each branch whether it ends or what it asks next. A policy is a function from a round's table to the same table with
``ask`` (the next question, null to end) added; one that calls a model is such a function, too. The bounds close branches that used up their
rounds or their searches. The frontier and the evidence of each round are tables in the shared folder, so a round reads them and not the rounds before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.sources.lineage import written

from .agent import LIMIT_REACHED, Bounds

#: (branch_key, query_id, branch, round, question, found, new) -> the same with ``ask``.
Policy = Callable[[DataFrame], DataFrame]
#: (branch_key, question) -> (branch_key, slot, seq, text, ...): the passages of each question in order.
Search = Callable[[DataFrame], DataFrame]

def narrowing(least_new: int = 1, least_words: int = 8) -> Policy:
    """A policy without a model: as long as a round brings ``least_new`` passages that the branch didn't have, and the question has ``least_words``
    words, its first half is asked."""

    def run(state: DataFrame) -> DataFrame:
        words = T.tokens(F.col("question"))
        half = F.slice(words, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int")))
        more = (F.col("new") >= least_new) & (F.size(words) >= least_words)
        return state.withColumn("ask", F.when(more, F.array_join(half, " ")))

    return run


def started(questions: DataFrame) -> DataFrame:
    """``questions(query_id, question_index, question)`` as the first frontier; blank ones are not asked."""
    key = F.concat_ws(":", F.col("query_id").cast("string"), F.col("question_index").cast("string"))
    return questions.filter(~T.is_blank(F.col("question"))).select(key.alias("branch_key"), "query_id", F.col("question_index").alias("branch"), F.lit(1).alias("round"), "question")


def researched(questions: DataFrame, search: Search, policy: Policy | None = None, bounds: Bounds | None = None) -> tuple[DataFrame, DataFrame]:
    """(steps, evidence) of ``questions(query_id, question_index, question)``.

    ``steps(query_id, branch, round, question, found, new, ask, stopped)`` has one row a branch and round: the passages found, those that the branch
    didn't have, what is asked next, and whether the bounds closed the branch. ``evidence(query_id, branch, round, slot, seq, ...)`` has
    each passage of a branch once, with the round that found it first. Rounds end when no branch is open, at the latest with the bounds' rounds.
    """
    b = bounds or Bounds()
    policy = policy or narrowing()
    frontier = written(started(questions), "frontier")
    steps, evidence = [], None
    most = min(b.max_iterations, b.max_tool_calls)
    for at in range(1, most + 1):
        hits = written(search(frontier.select("branch_key", F.col("question").alias("query"))).join(frontier.select("branch_key", "query_id", "branch", "round"), "branch_key"), "found")
        fresh = hits if evidence is None else hits.join(evidence.select("branch_key", "seq"), ["branch_key", "seq"], "left_anti")
        fresh = written(fresh.select(*hits.columns), "evidence")
        evidence = fresh if evidence is None else evidence.unionByName(fresh)
        n = lambda rows, name: rows.groupBy("branch_key").agg(F.count(F.lit(1)).alias(name))
        state = frontier.join(n(hits, "found"), "branch_key", "left").join(n(fresh, "new"), "branch_key", "left").na.fill(0, ["found", "new"])
        asked = policy(state)
        stopped = F.col("ask").isNotNull() & F.lit(at == most)
        done = written(asked.withColumn("stopped", stopped), "steps")
        steps.append(done)
        frontier = done.filter("ask is not null and not stopped").select("branch_key", "query_id", "branch", (F.col("round") + 1).alias("round"), F.col("ask").alias("question"))
        frontier = written(frontier, "frontier")
        if frontier.isEmpty():
            break
    whole = steps[0]
    for s in steps[1:]:
        whole = whole.unionByName(s)
    return whole.drop("branch_key"), evidence.drop("branch_key")


def outcomes(steps: DataFrame) -> DataFrame:
    """(query_id, branch, iterations, stopped): the rounds of each branch, and whether the bounds ended it; such a branch answers with ``LIMIT_REACHED``."""
    last = F.max_by("stopped", "round")
    return steps.groupBy("query_id", "branch").agg(F.count(F.lit(1)).alias("iterations"), last.alias("stopped")).withColumn("fallback", F.when(F.col("stopped"), F.lit(LIMIT_REACHED)))


def lexical_search(index, passages: DataFrame, k: int, least: Column | None = None) -> Search:
    """BM25 over ``passages(seq, ...)``: the best ``k`` of each question that have a term of it, and pass ``least`` (on ``score``) if given."""
    from . import lexical

    def run(asked: DataFrame) -> DataFrame:
        hits = lexical.top_k(index, asked, k, "branch_key").filter("score > 0")
        hits = hits if least is None else hits.filter(least)
        return hits.select("branch_key", F.col("rank").alias("slot"), "seq", "score").join(passages, "seq")

    return run
