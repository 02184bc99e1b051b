"""File scans: whole text files and pages as rows, on any file system Spark reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import parse

SUFFIXES = {"md": "text", "txt": "text", "pdf": "pages"}
PARSERS = {"md": parse.markdown, "txt": parse.plain_text, "pdf": parse.paged}


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, size) of the supported files below ``path``, sorted; suffixes in any case, hidden files left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", T.suffix(F.col("path")).alias("suffix"), F.col("length").alias("size")).filter(F.col("suffix").isin(*SUFFIXES)).orderBy("path")


def texts(spark: SparkSession, path: str, clean: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """(path, text, error) of text and Markdown files, whole; ``clean`` as the flat loaders do.

    A file whose bytes are not text in ``encoding`` has no text and an error, and the others are read all the same; ``loaded``
    decides what becomes of it.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(T.suffix(F.col("path")).isin("md", "txt"))
    if encoding.upper().replace("-", "") == "UTF8":
        raw = F.try_validate_utf8(F.col("content").cast("string"))
    else:
        raw = decoded(encoding)(F.col("content"))
    rows = found.select("path", raw.alias("text")).withColumn("error", F.when(F.col("text").isNull(), F.lit(f"text reader failed: not {encoding}")))
    return rows.withColumn("text", T.clean_text(F.col("text"))) if clean else rows


def decoded(encoding: str):
    """Bytes in an encoding to text, null where they aren't."""

    @F.pandas_udf("string")
    def run(contents):
        def one(raw):
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                return None

        return contents.map(one)

    return run


def loaded(rows: DataFrame, single: bool = False) -> DataFrame:
    """Rows without an error. For a ``single`` file an error is raised instead of left out; use ``rows`` itself to report errors."""
    if single and (bad := rows.filter("error is not null").first()) is not None:
        raise ValueError(f"{bad['path']}: {bad['error']}")
    return rows.filter("error is null").drop("error")


def kind(path: Column) -> Column:
    """The kind of scan for a path's suffix, in any case; null where there is none."""
    return F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[T.suffix(path)]


def pages(spark: SparkSession, path: str, reader: Callable[[bytes], list[str]] | None) -> DataFrame:
    """(path, page, text, error) of PDF files by ``reader`` (bytes to the pages' texts), pages from 1; there is no reader built in."""
    if reader is None:
        raise NotImplementedError("give a reader that turns the bytes of a PDF into its pages' texts")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(p, i, t, None) for i, t in enumerate(reader(content), 1)]
                except Exception as e:  # noqa: BLE001  foreign code
                    rows.append((p, None, None, f"page reader failed: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(T.suffix(F.col("path")) == "pdf")
    return found.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def loader(suffix: str) -> str:
    """The kind of scan for a suffix; unknown suffixes have none."""
    return SUFFIXES.get(suffix.lower().lstrip("."), "")


def tree_parser(suffix: str):
    try:
        return PARSERS[suffix.lower().lstrip(".")]
    except KeyError:
        raise ValueError(f"unsupported file type: {suffix}") from None


def trees(spark: SparkSession, path: str, reader: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """The node table of all supported files below ``path``; files of other kinds are left out, PDF files unless there is a reader."""
    raw = loaded(texts(spark, path, clean=False))
    out = parse.markdown(raw.filter(T.suffix(F.col("path")) == "md")).unionByName(parse.plain_text(raw.filter(T.suffix(F.col("path")) == "txt")))
    return out.unionByName(parse.paged(loaded(pages(spark, path, reader)))) if reader else out
