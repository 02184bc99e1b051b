"""Exact vector search by squared L2 distance, and min-max scaling of score lists.

Vectors stay where they are: each task keeps the best k of its own rows for a block of queries, held as a matrix of
bounded size, and a window ranks k rows a task and query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries that travel to the vectors; more meet them in a join.
QUERY_BLOCK = 1024
#: Pairs whose exact distances are computed at once.
SLICE = 1 << 14
EPSILON = 1e-8
#: Stands for a null id in a task, and sorts first, too.
NO_ID = -(1 << 63)


def distance(a: Column, b: Column) -> Column:
    """Squared L2 distance of two arrays, as an expression."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(x: np.ndarray, own: np.ndarray, ids: list, q: np.ndarray, k: int, digits: int) -> pd.DataFrame:
    """The ``k`` nearest of the rows x for each query: a matrix product finds who can be, exact distances decide."""
    norms, least = (x * x).sum(1), 10.0**-digits
    rough = norms[:, None] + (q * q).sum(1) - 2 * (x @ q.T)
    if len(x) > k:
        # the product is off by rounding alone; what lies within that and one digit of the k-th stays
        slack = least + 1e-12 * (norms.max() + (q * q).sum(1).max(initial=0))
        at, of = np.nonzero(rough.T <= np.partition(rough, k - 1, axis=0)[k - 1][:, None] + 2 * slack)
    else:
        at, of = np.divmod(np.arange(len(q) * len(x)), len(x))
    dist = np.concatenate([((x[of[i : i + SLICE]] - q[at[i : i + SLICE]]) ** 2).sum(1) for i in range(0, len(at), SLICE)] or [np.zeros(0)])
    dist = np.floor(dist * 10**digits + 0.5) / 10**digits
    order = np.lexsort((own[of], dist, at))
    at, of, dist = at[order], of[order], dist[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    top = place < k
    return pd.DataFrame({"query_id": np.array(ids)[at[top]], "seq": own[of[top]], "dist": dist[top]})


def top_k(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, seq: str = "seq", query_id: str = "query_id", embedding: str = "embedding", digits: int = 9) -> DataFrame:
    """(query_id, rank, seq, dist): the ``k`` nearest rows, ties by ``seq``. A filter is applied before the search, so it is exact.

    Up to QUERY_BLOCK queries travel to the vectors, which are read once; more are joined with them as blocks (see ``vecjoin``).
    Rows without a vector, with a null or non-finite component, or of another dimension than the query take no part.
    """
    kept = vectors.filter(where) if where is not None else vectors
    asked = queries.select(query_id, embedding).filter(F.col(embedding).isNotNull())
    few = asked.limit(QUERY_BLOCK + 1).collect()
    if len(few) > QUERY_BLOCK:
        from .vecjoin import Blocks

        return Blocks.of(kept, seq, embedding).top_k(asked, k, query_id, embedding, digits)
    # no filter on the vectors: where they are computed from a text as they are read, it would compute them twice
    rows = kept.select(F.coalesce(F.col(seq).cast("long"), F.lit(NO_ID)).alias("seq"), F.col(embedding).cast("array<double>").alias("v"))
    by_dim: dict[int, list] = {}
    for r in few:
        by_dim.setdefault(len(r[1]), []).append(r)
    mats = {d: ([r[0] for r in rs], np.array([r[1] for r in rs], np.float64)) for d, rs in by_dim.items()}

    kind = pa.schema([("query_id", pa.int64()), ("seq", pa.int64()), ("dist", pa.float64())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, v = batch.column(0).to_numpy(), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
            for d, (ids, q) in mats.items():
                at = np.flatnonzero(sizes == d)
                if not d or not len(at):
                    continue
                x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                fine = np.isfinite(x).all(1)
                if fine.any():
                    yield pa.RecordBatch.from_pandas(nearest(x[fine], seqs[at[fine]], ids, q, k, digits), kind, preserve_index=False)

    out = rows.mapInArrow(near, "query_id long, seq long, dist double").withColumn("seq", F.nullif(F.col("seq"), F.lit(NO_ID)))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("dist", "seq"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "seq", "dist")


def threshold(vectors: DataFrame, queries: DataFrame, k: int, least: float, **kw) -> DataFrame:
    """Of the nearest ``k`` those with a similarity 1 / (dist + epsilon) of at least ``least``."""
    return top_k(vectors, queries, k, **kw).filter(similarity(F.col("dist")) >= least)


def similarity(dist: Column) -> Column:
    return 1.0 / (dist + EPSILON)


def scaled(score: Column, by: list[str]) -> Column:
    """Min-max scaling over each group's list; a list without spread is all 0."""
    w = W.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low <= EPSILON, 0.0).otherwise((score - low) / (high - low))


def maximal_marginal(hits: DataFrame, vectors: DataFrame, k: int, weight: float = 0.5, seq: str = "seq", embedding: str = "embedding") -> DataFrame:
    """Greedy re-selection of a query's pool ``hits(query_id, seq, dist)`` for relevance and novelty; pools are bounded by their top-k."""
    pool = hits.join(vectors.select(F.col(seq).alias("seq"), F.col(embedding).alias("v")), "seq").select("query_id", "seq", "dist", "v")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dist", "seq"]).reset_index(drop=True)
        x = np.array(pdf["v"].tolist(), np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        near, like = -pdf["dist"].to_numpy(), x @ x.T
        taken: list[int] = []
        while len(taken) < min(k, len(pdf)):
            novelty = like[:, taken].max(1) if taken else np.zeros(len(pdf))
            gain = weight * near - (1 - weight) * novelty
            gain[taken] = -np.inf
            taken.append(int(gain.argmax()))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[taken].to_numpy(), "rank": range(1, len(taken) + 1), "seq": pdf["seq"].iloc[taken].to_numpy()})

    return pool.groupBy("query_id").applyInPandas(choose, "query_id long, rank int, seq long")
