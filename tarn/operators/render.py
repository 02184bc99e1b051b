"""Answers as Markdown, a row a query. Each line is an expression; missing parts drop out of ``concat_ws``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import text as T

SNIPPETS, SNIPPET = 6, 600
# Headings and set phrases of the rendered answers.
NO_DOCS = "I couldn't find any information to answer your question in the available sources."
NOTHING_FOUND = "I couldn't find any relevant information in the available sources to answer your question."
OFFLINE = "Offline mode is enabled (or API credentials are missing), so this response is a retrieval-only view of the most relevant excerpts."
NO_CITATIONS = "当前回答没有可展示的结构化引用。"
OUTSIDE = "This question is outside the current knowledge base."


def snippets(passages: DataFrame, by: str = "query_id", place: str = "slot", text: str = "text") -> DataFrame:
    """(by, at, source, label, snippet): passages by source name, the unknown source last, six at most."""
    src = F.coalesce(T.basename(F.col("source").cast("string")), F.lit(T.UNKNOWN))
    page = F.when(~T.is_blank(F.col("page").cast("string")), F.concat(F.lit(" p."), F.col("page").cast("string"))).otherwise("") if "page" in passages.columns else F.lit("")
    rows = passages.withColumn("_src", src).withColumn("at", F.row_number().over(W.partitionBy(by).orderBy(F.col("_src") == T.UNKNOWN, "_src", place)))
    label = F.concat(F.when(F.col("_src") == T.UNKNOWN, "(unknown source)").otherwise(F.col("_src")), page)
    return rows.filter(F.col("at") <= SNIPPETS).select(by, "at", F.col("_src").alias("source"), label.alias("label"), T.shortened(F.col(text), SNIPPET, one_line=True).alias("snippet"))


def retrieval_only(queries: DataFrame, passages: DataFrame, by: str = "query_id", query: str = "query", place: str = "slot", text: str = "text") -> DataFrame:
    """(by, answer): the question, up to six excerpts by source, and the sources that look like files; a set phrase without passages."""
    shown = snippets(passages, by, place, text).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit("- **"), "label", F.lit("**: "), "snippet").alias("line")))).alias("_l"))
    src = T.basename(F.col("source").cast("string"))
    files = passages.select(by, src.alias("_s")).filter("instr(_s, '.') > 0").groupBy(by).agg(F.array_sort(F.collect_set("_s")).alias("_f"))
    both = queries.select(by, query).join(shown, by, "left").join(files, by, "left")
    foot = F.when(F.size(F.coalesce("_f", F.array().cast("array<string>"))) > 0, F.concat(F.lit("\n---\n**Sources:**\n"), F.array_join(F.transform("_f", lambda s: F.concat(F.lit("- "), s)), "\n")))
    body = F.concat_ws("\n", F.concat(F.lit("Question: "), F.col(query)), F.lit(""), F.lit(OFFLINE), F.lit(""), F.lit("## Top excerpts"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), foot)
    return both.select(by, F.when(F.col("_l").isNull(), NO_DOCS).otherwise(body).alias("answer"))


def _details(item: Column, with_path: bool) -> Column:
    some = lambda label, c: F.when(~T.is_blank(c), F.concat(F.lit(label), T.strip(c)))
    path = F.nullif(F.array_join(F.filter(item["section_path"], lambda p: T.strip(p) != ""), " > "), F.lit("")) if with_path else F.lit(None).cast("string")
    inner = F.concat_ws("; ", some("doc_id=", item["doc_id"]), some("node_id=", item["node_id"]), F.when(item["page"].isNotNull(), F.concat(F.lit("p."), item["page"].cast("string"))), path)
    return F.when(inner != "", F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise("")


def _item(item: Column, head: Column, with_path: bool) -> Column:
    return F.concat_ws("\n", F.concat(head, _details(item, with_path)), F.when(~T.is_blank(item["quote"]), F.concat(F.lit("  > "), T.strip(item["quote"]))))


def grounded(answers: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, markdown) from answer, reasoning_summary, confidence, limitations and evidence."""
    section = lambda title, c: F.when(~T.is_blank(F.col(c)), F.concat(F.lit(f"\n## {title}\n"), T.strip(F.col(c))))
    percent = F.when(F.col("confidence").isNotNull(), F.concat(F.lit("\n**Confidence:** "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")))
    listed = F.array_join(F.transform("evidence", lambda x: _item(x, F.concat(F.lit("- **"), F.when(T.is_blank(x["source"]), T.UNKNOWN).otherwise(T.strip(x["source"])), F.lit("**")), True)), "\n")
    proof = F.when(F.size(F.coalesce("evidence", F.array())) > 0, F.concat(F.lit("\n## Evidence\n"), listed)) if "evidence" in answers.columns else F.lit(None).cast("string")
    body = F.concat_ws("\n", T.strip(F.col("answer")), section("Reasoning summary", "reasoning_summary"), percent, section("Limitations", "limitations"), proof)
    return answers.select(by, F.when(T.is_blank(F.col("answer")), NOTHING_FOUND).otherwise(body).alias("markdown"))


def citations(evidence: DataFrame, by: str = "query_id", place: str = "slot") -> DataFrame:
    """(by, markdown): evidence grouped by source and section label, both sorted."""
    path = F.array_join(F.filter(F.transform(F.coalesce("section_path", F.array().cast("array<string>")), T.strip), lambda p: p != ""), " > ")
    e = evidence.withColumns({"_s": F.when(T.is_blank(F.col("source")), T.UNKNOWN).otherwise(T.strip(F.col("source"))), "_p": F.when(path == "", "Unscoped section").otherwise(path)})
    row = F.struct(*[F.col(c) for c in ("doc_id", "node_id", "page", "quote", "section_path")])
    e = e.withColumn("_row", row).withColumn("_line", _item(F.col("_row"), F.lit("- Citation"), False))
    groups = e.groupBy(by, "_s", "_p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), "_line"))), lambda x: x["_line"]), "\n").alias("_lines"))
    blocks = groups.select(by, F.struct("_s", "_p", F.concat(F.lit("\n### "), "_s", F.lit("\n**Section:** "), "_p", F.lit("\n"), "_lines").alias("b")).alias("_b"))
    out = blocks.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_b")), lambda x: x["b"]), "\n").alias("_all"))
    return out.select(by, F.concat(F.lit("## Citations\n"), "_all").alias("markdown"))


def with_citations(queries: DataFrame, evidence: DataFrame, by: str = "query_id", place: str = "slot") -> DataFrame:
    """As ``citations``, and a set phrase for queries without evidence."""
    return queries.select(by).distinct().join(citations(evidence, by, place), by, "left").select(by, F.coalesce("markdown", F.lit(NO_CITATIONS)).alias("markdown"))


def out_of_scope(rows: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, markdown) from reason, boundary, suggestion and next_action."""
    part = lambda head, c: F.when(~T.is_blank(F.col(c)), F.concat(F.lit(head), T.strip(F.col(c)))) if c in rows.columns else F.lit(None).cast("string")
    body = T.strip(F.concat_ws("\n", part("", "reason"), part("\n## Current coverage\n", "boundary"), part("\n## Better question\n", "suggestion"), part("\n## Next step\n", "next_action")))
    return rows.select(by, F.when(body == "", OUTSIDE).otherwise(body).alias("markdown"))
