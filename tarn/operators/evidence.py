"""Questions to answers without a model: routing, fan-out, evidence items, fan-in and the deterministic answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import text as T

QUOTE = 400
ROUTES = ("retrieve", "direct_answer", "out_of_scope")
# The texts of the deterministic answers.
NOTHING_FOUND = "I couldn't find any relevant information in the available sources to answer your question."
NO_ANSWERS = "No answers were generated."
LIMITED = "Available evidence is limited to the retrieved passages."
NO_EVIDENCE = "No structured evidence was captured from retrieval."


def routed(scoped: DataFrame, decision: str | None = None) -> DataFrame:
    """Adds ``route``: the profile's veto first, then a model's decision if its column is named, else retrieval."""
    asked = F.col(decision) if decision else F.lit(None).cast("string")
    return scoped.withColumn("route", F.when(F.col("out_of_scope"), "out_of_scope").when(asked.isin(*ROUTES), asked).otherwise("retrieve"))


def branches(routes: DataFrame) -> dict[str, DataFrame]:
    return {r: routes.filter(F.col("route") == r) for r in ROUTES}


def fan_out(questions: DataFrame, column: str = "queries") -> DataFrame:
    """One row a distinct question, three at most, with its index; all other columns (the plan) travel along."""
    others = [c for c in questions.columns if c != column]
    return questions.select(*others, F.posexplode(F.slice(F.array_distinct(column), 1, 3)).alias("question_index", "question"))


def items(passages: DataFrame, subquery: str = "subquery") -> DataFrame:
    """Passages to evidence items; ids fall back to the source and to a hash of the quote, the section path to the title path."""
    has = lambda c: F.col(c) if c in passages.columns else F.lit(None)
    clean = lambda c: F.nullif(T.strip(F.coalesce(has(c).cast("string"), F.lit(""))), F.lit(""))
    quote = T.shortened(F.col("text"), QUOTE)
    own = lambda c: has(c) if c in passages.columns else F.array().cast("array<string>")
    path = F.when(F.size(F.coalesce(own("section_path"), F.array().cast("array<string>"))) > 0, own("section_path")).otherwise(F.coalesce(own("title_path"), F.array().cast("array<string>")))
    return passages.select(
        *[c for c in ("query_id", "slot") if c in passages.columns],
        F.col(subquery).alias("subquery"),
        F.coalesce(clean("doc_id"), clean("source"), F.lit("")).alias("doc_id"),
        F.coalesce(clean("node_id"), F.concat_ws(":", F.col(subquery), F.xxhash64(quote).cast("string"))).alias("node_id"),
        F.coalesce(clean("source"), F.lit(T.UNKNOWN)).alias("source"),
        F.filter(path, lambda x: T.strip(x) != "").alias("section_path"),
        has("page").cast("int").alias("page"),
        quote.alias("quote"),
        has("score").cast("double").alias("score"),
    )


def confidence(n: Column) -> Column:
    return F.least(F.lit(0.95), F.lit(0.25) + F.lit(0.12) * n)


def fan_in(evidence: DataFrame, by: str = "query_id") -> DataFrame:
    """Groups in order of their subquery, items once each (doc, node and quote alike are one), and the answer that needs no model.

    (by, n_groups, n_evidence, answer, confidence, limitations, evidence): first three quotes, first five items. Duplicates
    go before items are gathered, and only the first five of a group are.
    """
    place = ["subquery", "slot"] if "slot" in evidence.columns else ["subquery", "node_id"]
    once = evidence.withColumn("_k", F.concat_ws(":", "doc_id", "node_id", "quote"))
    once = once.withColumn("_n", F.row_number().over(W.partitionBy(by, "_k").orderBy(*place))).filter("_n = 1")
    once = once.withColumn("_at", F.row_number().over(W.partitionBy(by).orderBy(*place)))
    groups = evidence.groupBy(by).agg(F.countDistinct("subquery").alias("n_groups"))
    fields = ["_at", "doc_id", "node_id", "source", "section_path", "page", "quote", "score"]
    out = once.groupBy(by).agg(F.count(F.lit(1)).alias("n_evidence"), F.array_sort(F.collect_list(F.when(F.col("_at") <= 5, F.struct(*[f for f in fields if f in once.columns])))).alias("evidence"))
    quotes = F.filter(F.transform(F.slice("evidence", 1, 3), lambda x: T.strip(x["quote"])), lambda q: q != "")
    answer = T.strip(F.array_join(quotes, " "))
    return groups.join(out, by).select(
        by, "n_groups", "n_evidence",
        F.when(answer == "", NOTHING_FOUND).otherwise(answer).alias("answer"),
        F.concat(F.lit("Synthesized from "), F.col("n_groups").cast("string"), F.lit(" evidence group(s) and "), F.col("n_evidence").cast("string"), F.lit(" unique evidence item(s).")).alias("reasoning_summary"),
        confidence(F.col("n_evidence")).alias("confidence"),
        F.when(F.col("n_evidence") > 0, LIMITED).otherwise(NO_EVIDENCE).alias("limitations"),
        "evidence",
    )


def last_answer(messages: DataFrame, by: str = "conv_id", fallback: str = NO_ANSWERS) -> DataFrame:
    """(by, answer): the last assistant message with text, else the fallback."""
    good = F.when((F.col("role") == "assistant") & ~T.is_blank(F.col("text")), F.col("turn"))
    return messages.groupBy(by).agg(F.coalesce(F.max_by("text", good), F.lit(fallback)).alias("answer"))


def guarded(calls: DataFrame, by: list[str], max_iterations: int = 10, max_calls: int = 8) -> DataFrame:
    """Counts a branch's iterations and tool calls and says whether it must fall back; ``agent.limited`` acts on it."""
    n = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("iterations"), F.coalesce(F.sum("tool_calls"), F.lit(0)).alias("tool_calls"))
    return n.withColumn("fallback", (F.col("iterations") >= max_iterations) | (F.col("tool_calls") > max_calls))
