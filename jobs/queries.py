"""The jobs as registered queries: each runs twice into one new folder, and returns what stands there after the second run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.plans import oracles as O
from tarn.plans.samples import PROFILE
from tarn.sources.lineage import shared_path

from . import answer_questions, index_documents


def job1_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "job1")
    for _ in range(2):
        answer_questions.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out, answer_questions.Config(profile=PROFILE.to_dict()))
    return spark.read.parquet(f"{out}/answers").select("query_id", "route", "markdown")


def job2_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "job2")
    for _ in range(2):
        index_documents.run(spark, f"{sf_dir}/documents.parquet", out)
    return spark.read.parquet(f"{out}/terms").select("term", "df", "cf", T.rounded(F.col("idf"), 6).alias("idf"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_answer_questions": job1_answer_questions, "job2_index_documents": job2_index_documents}

_HITS = O.bm25("SELECT query_id, query FROM routed WHERE route = 'retrieve'", 8)
_PROOF = f"""proof AS (SELECT query_id, rank AS slot, query AS subquery, CAST(seq AS VARCHAR) AS doc_id, 'document:' || seq AS node_id, {O.source_or('source')} AS source, {O.shortened("coalesce(text, '')", 400)} AS quote, score
  FROM hits JOIN queries USING (query_id) JOIN documents ON doc_id = seq)"""

ORACLES = {
    "job1_answer_questions": f"WITH g AS ({O.ORACLES['grounded_answer'].replace(O.PROOF, 'routed AS (SELECT r.*, b.text AS query FROM (' + O.ORACLES['scope_routing'] + ') r JOIN benchmark b ON b.item_id = r.query_id), ' + _HITS + ', ' + _PROOF)}), "
    f"o AS ({O.ORACLES['out_of_scope_answer']}), r AS ({O.ORACLES['scope_routing']}) "
    f"SELECT r.query_id, route, CASE WHEN out_of_scope THEN o.markdown ELSE coalesce(g.markdown, '{O.NOTHING}') END AS markdown FROM r LEFT JOIN g USING (query_id) LEFT JOIN o USING (query_id)",
    "job2_index_documents": f"WITH {O.BM25}, c AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term) SELECT term, df, cf, {O.rnd('idf', 6)} AS idf FROM idfs JOIN c USING (term)",
}
