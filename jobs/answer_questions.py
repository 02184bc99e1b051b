"""Answers a table of questions from a table of documents, without a model: scope, retrieval, evidence, fan-in.

    python -m jobs.answer_questions --documents DIR --questions DIR --out DIR [--config jobs/answer_questions.json]

Reads ``documents(doc_id, text, source)`` and ``questions(item_id, text)``. Writes ``evidence`` (a folder for each source) and ``answers`` (a folder for each
route). A rerun replaces both by the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import agent, blockmax, evidence, lexical, profile
from tarn.sources.lineage import written

from .common import arguments, configured, log, session, write


@dataclass(frozen=True)
class Config:
    #: Passages that each question gets.
    passages: int = 8
    #: The profile of the corpus: what it covers, what it doesn't, what is never answered.
    profile: dict = field(default_factory=dict)


def found(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, slot, subquery, doc_id, node_id, source, text, score): the best passages of each question by BM25."""
    index = blockmax.build(docs.select(F.col("doc_id").alias("seq"), "text"))
    hits = blockmax.top_k(index, questions, k)
    hits = lexical.best(hits.withColumn("score", T.rounded(F.col("score"), 6)).drop("rank"), k, ["query_id"]).withColumn("slot", F.col("rank").cast("long"))
    passages = docs.select(F.col("doc_id").alias("seq"), "text", "source")
    named = hits.join(passages, "seq").join(questions.select("query_id", F.col("query").alias("subquery")), "query_id")
    return named.withColumns({"doc_id": F.col("seq").cast("string"), "node_id": F.concat(F.lit("document:"), F.col("seq").cast("string"))})


def run(spark: SparkSession, documents: str, questions: str, out: str, config: Config | None = None) -> None:
    config = config or Config()
    about = profile.Profile.of(config.profile)
    docs = spark.read.parquet(documents).select("doc_id", "text", "source")
    asked = spark.read.parquet(questions).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    log.info("reading %d documents from %s and %d questions from %s", docs.count(), documents, asked.count(), questions)
    routes = written(evidence.routed(profile.scoped(asked, about)).withColumn("boundary", F.lit(about.coverage)), "routes")
    items = evidence.items(found(docs, routes.filter("route = 'retrieve'").select("query_id", "query"), config.passages))
    write(items, f"{out}/evidence", ["source"])
    kept = spark.read.schema(items.schema).parquet(f"{out}/evidence")
    write(agent.answered(routes, evidence.fan_in(kept)), f"{out}/answers", ["route"])


def main() -> None:
    args = arguments(__doc__.split("\n")[0], ("documents", "Parquet table of documents"), ("questions", "Parquet table of questions"), ("out", "folder of the results"))
    spark = session("answer questions")
    run(spark, args.documents, args.questions, args.out, configured(spark, args.config, Config))
    spark.stop()


if __name__ == "__main__":
    main()
