"""What the jobs share: configuration, counted reads and writes, and the session of the command line."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def configured(spark: SparkSession, path: str | None, kind: type[dataclass]):
    """A dataclass from a JSON object, read through Spark so that it may lie anywhere; names that the class doesn't have are an error."""
    if path is None:
        return kind()
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if unknown := set(given) - set(kind.__dataclass_fields__):
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return kind(**given)


def write(rows: DataFrame, path: str, by: list[str]) -> int:
    """Replaces the table at ``path``, a folder for each value of ``by``, and logs and returns the number of rows; counted while they are written."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(*by).parquet(path)
    n = seen.get["n"]
    log.info("wrote %d rows to %s", n, path)
    return n


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def arguments(about: str, *names: tuple[str, str]) -> argparse.Namespace:
    """Required paths by name, and an optional configuration file."""
    parser = argparse.ArgumentParser(description=about)
    for name, text in names:
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="a JSON file of settings")
    return parser.parse_args()
