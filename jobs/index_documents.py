"""Keeps a lexical index of a growing table of documents: each run takes the files that are new and the index follows.

    python -m jobs.index_documents --documents DIR --out DIR [--config jobs/index_documents.json]

Reads the Parquet files of ``documents(doc_id, text)`` as a stream until those that are there are done; its checkpoint, ``out/checkpoint``, knows what was
taken. A document that is delivered again replaces its earlier version, one without text is removed. Each batch adds its own folders below ``out/index``
(see ``tarn.streaming.session.ingest``); ``out/terms`` has the terms' figures after the run, a folder for each part of the terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarn.streaming import session as stream

from .common import arguments, configured, log, session, write


@dataclass(frozen=True)
class Config:
    #: Files that one batch takes; 0 takes all that are new.
    files_per_batch: int = 0
    #: Folders that the terms are dealt to.
    parts: int = 16


def run(spark: SparkSession, documents: str, out: str, config: Config | None = None) -> None:
    config = config or Config()
    query = stream.ingest(spark, documents, f"{out}/index", f"{out}/checkpoint", max_files=config.files_per_batch or None, columns={"seq": "doc_id", "text": "text"})
    query.awaitTermination()
    if (error := query.exception()) is not None:
        raise error
    taken = [p for p in query.recentProgress if p["numInputRows"]]
    log.info("took %d rows in %d batches from %s", sum(p["numInputRows"] for p in taken), len(taken), documents)
    index = stream.index_of(spark, f"{out}/index")
    terms = index.terms.join(stream.term_figures(spark, f"{out}/index").select("term", "cf"), "term")
    write(terms.select("term", "df", "cf", "idf", F.pmod(F.xxhash64("term"), F.lit(config.parts)).cast("int").alias("part")), f"{out}/terms", ["part"])


def main() -> None:
    args = arguments(__doc__.split("\n")[0], ("documents", "folder of Parquet files"), ("out", "folder of index, checkpoint and terms"))
    spark = session("index documents")
    run(spark, args.documents, args.out, configured(spark, args.config, Config))
    spark.stop()


if __name__ == "__main__":
    main()
