"""The research agent as a batch: settings that bound it, the search tool's output, guardrails that act, prompts and the answer by route.

Language models plug in through ``tarn.functions.hooks``; each step has an answer that needs none. A turn's state is rows, so
a conversation's counters are counts and the order of the steps is the order of the calls in ``answered``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as T

from . import evidence, history, render
from .profile import Profile

DIRECT = "This question doesn't need the corpus, and no language model is set up to answer it."
LIMIT_REACHED = "The search stopped at its limit before an answer was complete."


@dataclass(frozen=True)
class Bounds:
    """What a branch may do: model calls, tool calls, tokens of messages before a summary, messages that a summary keeps."""

    max_iterations: int = 10
    max_tool_calls: int = 8
    max_context_tokens: int = 5000
    keep_messages: int = 20


def search_tool(packed: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, content, n_passages, total_tokens): what the search tool tells a model, from packed passages in slots.

    A line of figures first, then each passage behind its source. The passages themselves are the tool's artifact.
    """
    source = F.coalesce(F.nullif(T.strip(F.coalesce("source", F.lit(""))), F.lit("")), F.lit(T.UNKNOWN))
    line = F.concat(F.lit("Source: "), source, F.lit("\nContent: "), F.coalesce("packed_text", F.lit("")))
    rows = packed.withColumn("_line", line).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("slot", "_line"))).alias("_l"), F.max("total_tokens").alias("total_tokens"))
    n = F.size("_l")
    head = F.concat(F.lit("Passages: "), n.cast("string"), F.lit(", tokens: "), F.coalesce(F.col("total_tokens").cast("string"), F.lit("0")))
    return rows.select(by, F.concat_ws("\n\n", head, F.array_join(F.transform("_l", lambda x: x["_line"]), "\n\n")).alias("content"), n.cast("long").alias("n_passages"), F.col("total_tokens").cast("long").alias("total_tokens"))


def limited(answers: DataFrame, calls: DataFrame, by: list[str], bounds: Bounds | None = None, fallback: str = LIMIT_REACHED) -> DataFrame:
    """``answers`` with the fallback in place of the answer of every branch that used up its calls; a branch without calls keeps its own.

    Adds ``iterations``, ``tool_calls`` and ``stopped``.
    """
    b = bounds or Bounds()
    used = evidence.guarded(calls, by, b.max_iterations, b.max_tool_calls).withColumnRenamed("fallback", "stopped")
    out = answers.join(used, by, "left").withColumns({"iterations": F.coalesce("iterations", F.lit(0)), "tool_calls": F.coalesce("tool_calls", F.lit(0)), "stopped": F.coalesce("stopped", F.lit(False))})
    return out.withColumn("answer", F.when(F.col("stopped"), fallback).otherwise(F.col("answer")))


def summarised(messages: DataFrame, bounds: Bounds | None = None, model: Callable[[Column], Column] | None = None, counter: Callable[[Column], Column] = T.token_count, by: str = "conv_id") -> DataFrame:
    """(by, tokens, summary, reset): threads that are over the token limit are summed up by ``model``, or by their transcript where there is none.

    A thread with too few messages for a window has an empty summary and is not reset.
    """
    b = bounds or Bounds()
    sizes = messages.groupBy(by).agg(F.sum(counter(F.coalesce("text", F.lit("")))).cast("long").alias("tokens"))
    told = history.transcript(history.window(messages, keep=b.keep_messages), by).withColumnRenamed("transcript", "_told")
    over = (F.col("tokens") > b.max_context_tokens) & F.col("_told").isNotNull()
    text = model(F.col("_told")) if model is not None else F.col("_told")
    return sizes.join(told, by, "left").select(by, "tokens", F.when(over, text).otherwise("").alias("summary"), over.alias("reset"))


def prompts(questions: DataFrame, profile: Profile, query: str = "query", by: str = "query_id") -> DataFrame:
    """(by, decide, plan, rewrite): the texts that a model is asked with, a column a task."""
    about = profile.described()
    ask = lambda task: F.concat(F.lit(f"{task}\n\n{about}\n\nQuestion: "), T.strip(F.coalesce(F.col(query), F.lit(""))))
    return questions.select(
        by,
        ask("Say with one word whether this question needs a search, a direct answer, or lies outside the corpus.").alias("decide"),
        ask("Name the intent, up to three subqueries and the kinds of passages that would answer this question, as JSON.").alias("plan"),
        ask("Write this question anew so that a search finds its answer, in up to three versions.").alias("rewrite"),
    )


def style_instruction(profile: Profile) -> str:
    """A line on how to answer, if the profile asks for one."""
    style = profile.preferred_answer_style.strip()
    return f"Answer in this style: {style}" if style else ""


def answered(routes: DataFrame, found: DataFrame, direct: Callable[[Column], Column] | None = None, query: str = "query", by: str = "query_id") -> DataFrame:
    """(by, route, markdown): every question's answer by its route: fan-in of the evidence, the profile's boundary, or a direct answer.

    ``routes`` come from ``evidence.routed``, ``found`` from ``evidence.fan_in``. A question sent to retrieval that found nothing says so.
    """
    own = render.grounded(found, by).withColumnRenamed("markdown", "_grounded")
    beyond = render.out_of_scope(routes, by).withColumnRenamed("markdown", "_beyond")
    reply = direct(F.col(query)) if direct is not None else F.lit(DIRECT)
    both = routes.join(own, by, "left").join(beyond, by, "left")
    said = F.when(F.col("route") == "out_of_scope", F.col("_beyond")).when(F.col("route") == "direct_answer", F.coalesce(reply, F.lit(DIRECT))).otherwise(F.coalesce("_grounded", F.lit(evidence.NOTHING_FOUND)))
    return both.select(by, "route", said.alias("markdown"))
