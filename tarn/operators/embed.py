"""Embeddings: a deterministic offline one, pluggable models, and pooling over trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from tarn.functions import text as T
from tarn.sources.lineage import written

from .parse import rooted

DIMENSIONS = 384
#: Parents whose sums a task holds at once.
SUMS = 4096


def _vectors(rows: list[np.ndarray | None]) -> pa.Array:
    """Vectors as one Arrow list array, without a Python object a component."""
    ends = np.cumsum([0] + [0 if v is None else len(v) for v in rows]).astype(np.int32)
    flat = [v for v in rows if v is not None]
    mask = pa.array([v is None for v in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0), pa.float64()), mask=mask)


def hashed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """SHA-256 digests of the text with a 4-byte little-endian counter, one after the other; every byte is a component between 0 and 1."""
    digests = [F.sha2(F.concat(F.coalesce(text, F.lit("")).cast("binary"), F.unhex(F.lit((i).to_bytes(4, "little").hex()))), 256) for i in range(-(-dimensions // 32))]
    # a byte is a letter of Latin-1; finding each one's place in the hexadecimal string would walk it from the start
    parts = F.transform(F.array(*digests), lambda h: F.transform(F.split(F.decode(F.unhex(h), "ISO-8859-1"), ""), lambda c: F.ascii(c) / 255.0))
    return F.slice(F.flatten(parts), 1, dimensions)


def embedder(backend: str, dimensions: int = DIMENSIONS, model: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    """'fake' or 'offline': the hashed embedding. 'model': a given (pandas) UDF. Anything else is an error."""
    if backend in ("fake", "offline"):
        return lambda text: hashed(text, dimensions)
    if backend == "model":
        if model is None:
            raise ValueError("the model backend needs a UDF from text to array<double>")
        return model
    raise ValueError(f"unknown embedding backend: {backend}")


def hydrated(nodes: DataFrame) -> DataFrame:
    """Blank nodes get their children's texts, in order, a blank line between, those of blank children being their children's.

    Where ``nodes`` carry no ``ancestors`` they are derived. As joining is associative, a text goes to every ancestor up to the first with a text of its own.
    """
    nodes = rooted(nodes)
    solid = nodes.filter(~T.is_blank(F.col("text")))
    below = solid.select("node_id", "order", T.strip(F.col("text")).alias("_t"), F.posexplode("ancestors").alias("_i", "_of"))
    inner = solid.filter("node_type <> 'paragraph'").select(F.col("node_id").alias("_of"), F.lit(True).alias("_solid"))
    below = below.join(inner, "_of", "left").withColumn("_stop", F.max(F.when(F.col("_solid"), F.col("_i"))).over(W.partitionBy("node_id")))
    below = below.filter(F.col("_i") > F.coalesce("_stop", F.lit(-1)))
    joined = below.groupBy("_of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "_t"))), lambda x: x["_t"]), "\n\n").alias("_text"))
    out = nodes.join(joined, nodes["node_id"] == joined["_of"], "left")
    return out.withColumn("text", F.when(T.is_blank(F.col("text")) & F.col("_text").isNotNull(), F.col("_text")).otherwise(F.col("text"))).drop("_of", "_text")


def pooled(nodes: DataFrame, parent: str = "parent_id", embedding: str = "embedding") -> DataFrame:
    """(parent, embedding, children): the component-wise mean of the children that have a vector. A vector stays one row: tasks add up
    their own children first, then their sums meet. Children with vectors of several sizes give none."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for p, v, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                held = sums.get(p)
                if held is None:
                    sums[p] = [x.copy(), n]
                elif held[0] is None or len(held[0]) != len(x):
                    sums[p] = [None, held[1] + n]
                else:
                    held[0] += x
                    held[1] += n
                if len(sums) >= SUMS:
                    yield pack(sums)
        yield pack(sums)

    def pack(sums: dict) -> pa.RecordBatch:
        keys, values = list(sums), list(sums.values())
        sums.clear()
        return pa.record_batch([pa.array(keys, kind), _vectors([s for s, _ in values]), pa.array([n for _, n in values], pa.int64())], ["parent", "embedding", "children"])

    own = nodes.filter(F.col(embedding).isNotNull() & F.col(parent).isNotNull()).select(F.col(parent).alias("parent"), F.col(embedding).cast("array<double>").alias("embedding"), F.lit(1).cast("long").alias("children"))
    kind = to_arrow_type(own.schema["parent"].dataType)
    schema = f"parent {own.schema['parent'].dataType.simpleString()}, embedding array<double>, children long"
    local = own.mapInArrow(add, schema)
    total = F.aggregate("vectors", F.transform(F.col("vectors")[0], lambda x: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    met = local.groupBy("parent").agg(F.collect_list("embedding").alias("vectors"), F.sum("children").alias("children"), F.count(F.lit(1)).alias("_n"), F.max(F.size("embedding")).alias("_most"), F.min(F.size("embedding")).alias("_least"))
    whole = (F.size("vectors") == F.col("_n")) & (F.col("_most") == F.col("_least"))
    return met.select("parent", F.when(whole, F.transform(total, lambda x: x / F.col("children"))).alias("embedding"), "children")


def _lifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ups, embedding), ups being ancestors with weights, to partial sums of weight * vector by ancestor; vectors of two sizes make an empty one."""
    sums: dict = {}

    def pack() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(sums), pa.string()), _vectors(list(sums.values()))], ["of", "part"])
        sums.clear()
        return out

    for batch in batches:
        for ups, v in zip(batch.column(0), batch.column(1), strict=True):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            for up in ups.as_py():
                held = sums.get(up["a"])
                if held is None:
                    sums[up["a"]] = up["w"] * x
                elif len(held) == len(x):
                    held += up["w"] * x
                else:
                    sums[up["a"]] = np.zeros(0)
            if len(sums) >= SUMS:
                yield pack()
    yield pack()


def lifted(nodes: DataFrame, pooling: str = "mean") -> DataFrame:
    """(of, embedding): the vector of each node that has none of its own and embedded descendants, in one exchange.

    Means of means are linear: a vector counts for an ancestor with the product of 1 / embedded children along the way, so every
    vector is added to all its ancestors at once, up to the first with a vector of its own. With pooling 'none' only parents of embedded nodes
    are listed, without a vector. A node above vectors of several sizes has none.
    """
    own = nodes.filter(F.col("embedding").isNotNull())
    ways = own.select("node_id", F.col("ancestors").alias("_up"), F.posexplode("ancestors").alias("_i", "_a"))
    stops = own.select(F.col("node_id").alias("_a"), F.lit(True).alias("_own"))
    ways = ways.join(stops, "_a", "left").withColumn("_stop", F.max(F.when(F.col("_own"), F.col("_i"))).over(W.partitionBy("node_id"))).filter(F.col("_i") > F.coalesce("_stop", F.lit(-1)))
    if pooling != "mean":
        direct = ways.filter(F.col("_i") == F.size("_up") - 1)
        return direct.select(F.col("_a").alias("of")).distinct().withColumn("embedding", F.lit(None).cast("array<double>"))
    kid = F.when(F.col("_i") == F.size("_up") - 1, F.col("node_id")).otherwise(F.get(F.col("_up"), F.col("_i") + 1))
    fan = ways.select("_a", kid.alias("_kid")).distinct().groupBy("_a").agg(F.count(F.lit(1)).alias("_kids"))
    paths = ways.join(fan, "_a").groupBy("node_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("_i", "_a", "_kids")))).alias("_p"))
    start = F.struct(F.array().cast("array<struct<a:string,w:double>>").alias("l"), F.lit(1.0).alias("w"))
    step = lambda s, x: F.struct(F.concat(s["l"], F.array(F.struct(x["_a"].alias("a"), (s["w"] / x["_kids"]).alias("w")))).alias("l"), (s["w"] / x["_kids"]).alias("w"))
    weights = paths.select("node_id", F.aggregate("_p", start, step, lambda s: s["l"]).alias("_ups"))
    parts = weights.join(own.select("node_id", F.col("embedding").cast("array<double>").alias("embedding")), "node_id").select("_ups", "embedding").mapInArrow(_lifted, "of string, part array<double>")
    total = F.aggregate("parts", F.transform(F.col("parts")[0], lambda x: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    met = parts.groupBy("of").agg(F.collect_list("part").alias("parts"), F.min(F.size("part")).alias("_least"), F.max(F.size("part")).alias("_most"))
    return met.select("of", F.when((F.col("_least") == F.col("_most")) & (F.col("_least") > 0), total).alias("embedding"))


def enriched(nodes: DataFrame, embed: Callable[[Column], Column], leaf: str = "paragraph", pooling: str = "mean", counter: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """Texts hydrated, leaves embedded and counted, parents pooled.

    A parent of embedded children has the sum of its children's tokens, any other node the count of its own text by ``counter``.
    With pooling 'none' parents have no vector. A node above vectors of several sizes gets none.
    """
    is_leaf = (F.col("node_type") == leaf) & ~T.is_blank(F.col("text"))
    n = hydrated(nodes)
    n = written(n.withColumn("embedding", F.when(is_leaf, embed(F.col("text")))).withColumn("token_count", counter(F.col("text"))), "embedded")
    up = written(lifted(n, pooling).select(F.col("of").alias("_of"), F.col("embedding").alias("_e"), F.lit(True).alias("_mine")), "lifted")
    # a node that sums up its children passes on what they have, any other one its own count, as far up as there are sums
    mine = up.select(F.col("_of").alias("_a"), "_mine")
    told = n.join(up.select(F.col("_of").alias("node_id")), "node_id", "left_anti").select("node_id", "token_count", F.posexplode("ancestors").alias("_i", "_a"))
    told = told.join(mine, "_a", "left").withColumn("_stop", F.max(F.when(F.col("_mine").isNull(), F.col("_i"))).over(W.partitionBy("node_id"))).filter(F.col("_i") > F.coalesce("_stop", F.lit(-1)))
    tokens = told.groupBy(F.col("_a").alias("_of")).agg(F.sum("token_count").alias("_tokens"))
    both = n.join(up.join(tokens, "_of", "left"), n["node_id"] == F.col("_of"), "left")
    own = {"token_count": F.when(F.col("_mine"), F.col("_tokens")).otherwise(F.col("token_count")).cast("int"), "embedding": F.when(F.col("_mine"), F.col("_e")).otherwise(F.col("embedding"))}
    return both.withColumns(own).drop("_of", "_e", "_mine", "_tokens")
