"""Cutting the lineage of iterative plans by tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import uuid
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that travel to a table; more meet it in a join.
KEYS = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only in local mode, where it is unset, a temporary folder stands in, and goes at exit."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            made = mkdtemp(prefix="tarn-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            path = f"file://{made}"
        context.setCheckpointDir(path)
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_dir(spark)}/tarn/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def among(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``table`` whose ``on`` is among ``keys``, a table cheap to read. Few keys travel to the table, which then isn't shuffled."""
    wanted = keys.select(on).filter(F.col(on).isNotNull()).distinct()
    few = wanted.limit(KEYS + 1).count() <= KEYS
    return table.join(F.broadcast(wanted) if few else wanted, on, "left_semi")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage, keeps columns apart and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
