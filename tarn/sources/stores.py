"""Tables that outlive a session: nodes, vectors, postings and profiles, and the registry of their backends."""

from __future__ import annotations

import json
import uuid
from typing import Protocol, runtime_checkable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.operators import blockmax, lexical, parse, vector
from tarn.operators.profile import Profile

NODES = (
    "node_id string, parent_id string, doc_id string, node_type string, title string, text string, `order` int, level int, token_count int, section_path array<string>, "
    "title_path array<string>, source string, file_name string, source_type string, page int, ancestors array<string>, metadata map<string,string>"
)


@runtime_checkable
class VectorStore(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...
    def append(self, rows: DataFrame) -> None: ...
    def rows(self) -> DataFrame: ...


@runtime_checkable
class LexicalStore(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


@runtime_checkable
class NodeStore(Protocol):
    def nodes(self) -> DataFrame: ...
    def upsert(self, nodes: DataFrame) -> None: ...


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _version(spark: SparkSession, base: str) -> str | None:
    """The folder that the last line of ``base/CURRENT`` names."""
    if not _exists(spark, f"{base}/CURRENT"):
        return None
    last = spark.read.text(f"{base}/CURRENT").agg(F.max("value")).first()[0]
    return last.partition(" ")[2]


def _point(spark: SparkSession, base: str, name: str) -> None:
    """Appends a numbered line to ``base/CURRENT``: readers see the old version or the new one, never none."""
    last = spark.read.text(f"{base}/CURRENT").agg(F.max("value")).first()[0] if _exists(spark, f"{base}/CURRENT") else "0"
    line = f"{int(last.partition(' ')[0]) + 1:012d} {name}"
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{base}/CURRENT")


def _publish(spark: SparkSession, base: str, rows: DataFrame, kind: str, options: dict | None = None, below: str = "") -> None:
    """Writes a new version beside the old ones and then points to it, so readers never see half a table."""
    name = f"v-{uuid.uuid4().hex}"
    rows.write.options(**(options or {})).format(kind).save(f"{base}/{name}{below}")
    _point(spark, base, name)


class JsonNodeStore:
    """Nodes as JSON Lines, without their vectors; missing fields read as empty text and zero, missing ancestors are derived from the parents.

    An upsert adds a segment with the nodes of its documents, so what is written follows the change; a document's nodes are those of its last
    segment. ``compact`` writes them anew as one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def nodes(self) -> DataFrame:
        at = _version(self.spark, self.path)
        if at is None:
            return self.spark.createDataFrame([], NODES)
        stored = self.spark.read.schema(f"{NODES}, segment int").json(f"{self.path}/{at}")
        last = stored.groupBy("doc_id").agg(F.max("segment").alias("segment"))
        rows = stored.join(last, stored["doc_id"].eqNullSafe(last["doc_id"]) & (stored["segment"] == last["segment"]), "left_semi").drop("segment").filter("node_id is not null")
        if not rows.filter("ancestors is null").isEmpty():
            rows = parse.rooted(rows.drop("ancestors")).select(rows.columns)
        return rows.withColumns({"text": F.coalesce("text", F.lit("")), "order": F.coalesce("order", F.lit(0)), "level": F.coalesce("level", F.lit(0))})

    def replace(self, nodes: DataFrame) -> None:
        _publish(self.spark, self.path, nodes.drop("embedding"), "json", below="/segment=0")

    def upsert(self, nodes: DataFrame) -> None:
        """Documents that come in replace their stored nodes."""
        at = _version(self.spark, self.path)
        rows = nodes.drop("embedding").dropDuplicates(["node_id"])
        if at is None:
            self.replace(rows)
        else:
            rows.write.json(f"{self.path}/{at}/segment={self._segments(at)}")

    def remove(self, documents: DataFrame) -> None:
        """Documents ``(doc_id)`` go: a segment with a row without a node hides what they had."""
        at = _version(self.spark, self.path)
        if at is not None:
            documents.select("doc_id").distinct().write.json(f"{self.path}/{at}/segment={self._segments(at)}")

    def compact(self) -> None:
        self.replace(self.nodes())

    def _segments(self, at: str) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{at}/segment=*")
        return len(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p))

    def trees(self) -> DataFrame:
        return trees(self.nodes())


def upserted(stored: DataFrame, incoming: DataFrame, seq: str | None = None) -> DataFrame:
    """All stored rows of incoming documents go; of incoming rows with one node_id the last by ``seq`` stays."""
    rest = stored.join(incoming.select("doc_id").distinct(), "doc_id", "left_anti")
    if seq is not None:
        incoming = incoming.withColumn("_n", F.row_number().over(W.partitionBy("node_id").orderBy(F.col(seq).desc()))).filter("_n = 1").drop("_n")
    else:
        incoming = incoming.dropDuplicates(["node_id"])
    return rest.unionByName(incoming, allowMissingColumns=True)


def trees(nodes: DataFrame) -> DataFrame:
    """(doc_id, root_id, nodes): a document's nodes in order, as one value; ``to_json`` and ``from_json`` carry it further."""
    inner = F.struct(*[F.col(c) for c in ("order", "node_id", "parent_id", "node_type", "title", "text", "level")])
    return nodes.groupBy("doc_id").agg(F.min_by("node_id", F.struct(F.col("parent_id").isNotNull(), "order", "node_id")).alias("root_id"), F.array_sort(F.collect_list(inner)).alias("nodes"))


class ParquetVectorStore:
    """Vectors of one dimension with their passages; appended, never rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def dimension(self) -> int | None:
        if not _exists(self.spark, self.path):
            return None
        first = self.rows().filter("embedding is not null").select(F.size("embedding")).first()
        return first[0] if first else None

    def append(self, rows: DataFrame) -> None:
        """A row whose vector has another dimension than the stored ones is an error before anything is written."""
        want = self.dimension() or rows.filter("embedding is not null").select(F.size("embedding")).first()
        want = want if isinstance(want, int) or want is None else want[0]
        if want is not None and not rows.filter(F.size("embedding") != want).isEmpty():
            raise ValueError(f"vectors of dimension {want} only")
        rows.write.mode("append").parquet(self.path)

    def search(self, queries: DataFrame, k: int, where=None) -> DataFrame:
        return vector.top_k(self.rows(), queries, k, where)


class PostingsStore:
    """A written lexical index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rebuild(self, docs: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        lexical.build(docs).write(f"{self.path}/{name}")
        _point(self.spark, self.path, name)

    def index(self) -> lexical.LexicalIndex:
        at = _version(self.spark, self.path)
        if at is None:
            raise FileNotFoundError(f"no index below {self.path}")
        return lexical.LexicalIndex.read(self.spark, f"{self.path}/{at}")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return lexical.top_k(self.index(), queries, k)


class BlockStore(PostingsStore):
    """A written index of blocks with their largest weights, whose lists are pruned."""

    def rebuild(self, docs: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        blockmax.build(docs).write(f"{self.path}/{name}")
        _point(self.spark, self.path, name)

    def index(self) -> blockmax.BlockIndex:
        at = _version(self.spark, self.path)
        if at is None:
            raise FileNotFoundError(f"no index below {self.path}")
        return blockmax.BlockIndex.read(self.spark, f"{self.path}/{at}")


def save_profile(spark: SparkSession, path: str, profile: Profile) -> None:
    spark.createDataFrame([(json.dumps(profile.to_dict(), ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_profile(spark: SparkSession, path: str) -> Profile:
    """A missing or broken file, or one that holds no object, is an empty profile."""
    try:
        text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).limit(1).collect())
        return Profile.of(json.loads(text))
    except (AnalysisException, ValueError):
        return Profile.of(None)


VECTOR = {"parquet": ParquetVectorStore}
LEXICAL = {"bm25": PostingsStore, "blocks": BlockStore}
NODE = {"json": JsonNodeStore}
RESERVED = {"sqlite", "sqlite_vec"}


def store(kind: str, backend: str, spark: SparkSession, path: str):
    """A store by kind ('vector', 'lexical', 'node') and backend; unknown backends are a ValueError, reserved ones not implemented."""
    known = {"vector": VECTOR, "lexical": LEXICAL, "node": NODE}[kind]
    if backend in RESERVED and kind != "lexical":
        raise NotImplementedError(f"the {backend} backend is reserved")
    if backend not in known:
        raise ValueError(f"unknown {kind} backend: {backend}")
    return known[backend](spark, path)
