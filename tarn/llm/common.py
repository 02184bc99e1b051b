"""Shared helpers of the llm operators: input tables, cut points in the lineage, and the word rule."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space. ``bytes.split()`` uses the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir of the session; a temporary one only where it is unset (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = mkdtemp(prefix="tarn-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        path = f"file://{made}"
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_written: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``saved`` writes inside are deleted at the end; what is made from them must be written by then."""
    mark = len(_written)
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _written[mark:]:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        del _written[mark:]


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tarn/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(*pairs: tuple[Column, Column]) -> Column:
    """Null-safe equality of all pairs, still a hash-join key for the planner."""
    out = None
    for a, b in pairs:
        out = a.eqNullSafe(b) if out is None else out & a.eqNullSafe(b)
    return out


def free(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words, without keeping them: every word with the white space after it shrinks to one mark."""
    marks = F.regexp_replace(text, rf"[\x20\x09-\x0D]*{WORD}[\x20\x09-\x0D]*", "w")
    return F.when(text.rlike(WORD), F.length(marks)).otherwise(0).cast("long")


def ascii_table(kept: bytes) -> bytes:
    """For bytes.translate: A-Z folded, ASCII characters that are not in ``kept`` made spaces, all other bytes as they are."""
    folded = [b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256)]
    return bytes(b if b >= 0x80 or b in kept else 0x20 for b in folded)


def module_bytes(name: str) -> bytes:
    """A file beside this module, also from a zip that was sent to the executors."""
    return __loader__.get_data(str(Path(__file__).parent / name))  # type: ignore[name-defined]
