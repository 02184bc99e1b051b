"""Exact vector search of any number of queries, as a join of blocks.

A bounded sample of the vectors gives pivots. Vectors and queries are grouped by their nearest pivot where they lie and packed into blocks, each
with its centre and the radius around it. Query blocks stand on shelves, those of neighbouring groups together, and a shelf is what one task holds: its
queries with the best ``k`` of each so far. The vector blocks pass by every shelf once, those of its own groups first. By the triangle inequality a pair of
blocks is at least the distance of the centres less both radii apart, so a query block leaves out what lies farther than its worst k-th distance.

So a vector travels once for ``SHELF`` queries, and of the pairs nothing travels but each query's final list. The pivots are all that passes the driver.
A group that holds a large part of the rows, or of the queries, is spread over several shelves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.sources.lineage import written

from .vector import SLICE

PIVOTS = 64
SAMPLE = 2048
VECTOR_BLOCK = 1024
QUERY_BLOCK = 256
#: Queries that a task holds.
SHELF = 1 << 16
#: Vector blocks that a shelf takes up at once, to meet the nearest ones first.
WAITING = 32
NONE = np.iinfo(np.int64).max

BLOCKS = "group int, block long, n int, centre array<double>, radius double, ids array<long>, rows binary"


def pivots_of(vectors: DataFrame, n: int = PIVOTS) -> dict[int, np.ndarray]:
    """By dimension: up to ``n`` vectors of a sample that are far from each other. The origin is always one, also of dimensions that the sample hasn't met."""
    sample = vectors.orderBy(F.xxhash64("seq"), "seq").limit(SAMPLE).select("v").collect()
    out: dict[int, np.ndarray] = {}
    for d in sorted({len(r["v"]) for r in sample}):
        x = np.array([r["v"] for r in sample if len(r["v"]) == d], np.float64)
        x = x[np.isfinite(x).all(1)]
        chosen = np.zeros((1, d))
        far = (x * x).sum(1)
        while len(chosen) < min(n, len(x) + 1) and far.max(initial=0) > 0:
            chosen = np.vstack([chosen, x[far.argmax()]])
            far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(1))
        out[d] = chosen
    return out


def _group_numbers(pivots: dict[int, np.ndarray]) -> dict[int, int]:
    """The first group's number of each dimension; a dimension without pivots has the negative of itself as its only group."""
    at, out = 0, {}
    for d in sorted(pivots):
        out[d] = at
        at += len(pivots[d])
    return out


def _blocks(pivots: dict[int, np.ndarray], size: int):
    """(seq, v) to blocks of at most ``size`` rows of one group. Rows with a non-finite or null component take no part."""
    first = _group_numbers(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}
        rows: list = []

        def close(group: int) -> None:
            nonlocal made
            ids, x = (np.concatenate(p) for p in zip(*held.pop(group), strict=True))
            for at in range(0, len(ids), size):
                part = x[at : at + size]
                centre = part.mean(0)
                radius = float(np.sqrt(((part - centre) ** 2).sum(1).max()))
                rows.append((group, base + made, len(part), centre.tolist(), radius, ids[at : at + size].tolist(), part.tobytes()))
                made += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            rows.clear()
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.int64()), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["group", "block", "n", "centre", "radius", "ids", "rows"])

        for batch in batches:
            seq = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).astype(int).tolist():
                at = np.flatnonzero(sizes == d)
                x = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                fine = np.isfinite(x).all(1)
                x, own = x[fine], seq[at][fine]
                p = pivots.get(d)
                group = np.full(len(x), -d) if p is None else first[d] + ((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)).argmin(1)
                for g in np.unique(group).tolist():
                    held.setdefault(g, []).append((own[group == g], x[group == g]))
                    if sum(len(i) for i, _ in held[g]) >= size:
                        close(g)
            if len(rows) >= 16:
                yield out()
        for g in list(held):
            close(g)
        yield out()

    return run


class _Shelf:
    """The query blocks of a task, by dimension, with each query's nearest rows so far."""

    def __init__(self, k: int, digits: int):
        self.k, self.digits, self.met = k, digits, 0
        self.queries: dict[int, list] = {}
        self.waiting: list = []

    def put(self, centre: np.ndarray, radius: float, ids: np.ndarray, q: np.ndarray) -> None:
        n = len(ids)
        self.queries.setdefault(q.shape[1], []).append((centre, radius, ids, q, (q * q).sum(1), np.full((n, self.k), np.inf), np.full((n, self.k), NONE)))

    def pass_by(self, *block) -> None:
        self.waiting.append(block)
        if len(self.waiting) >= WAITING:
            self.meet()

    def meet(self) -> None:
        """The waiting vector blocks with each query block, nearest first, up to the first that is too far."""
        for d, held in self.queries.items():
            near = [w for w in self.waiting if w[3].shape[1] == d]
            if not near:
                continue
            norms = [(w[3] * w[3]).sum(1) for w in near]
            centres, radii = np.array([w[0] for w in near]), np.array([w[1] for w in near])
            for q in held:
                least = np.sqrt(((centres - q[0]) ** 2).sum(1)) - radii - q[1]
                for i in np.argsort(least, kind="stable").tolist():
                    if least[i] > np.sqrt(q[5][:, -1].max() + 10.0**-self.digits) * (1 + 1e-9) + 1e-9:
                        break
                    self.met += 1
                    self._pair(q, near[i][2], near[i][3], norms[i])
        self.waiting.clear()

    def _pair(self, held: tuple, own: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
        """A matrix product finds which rows can be among the nearest, exact distances decide."""
        _, _, _, q, squares, dist, seq = held
        k, last = self.k, dist[:, -1]
        rough = squares[:, None] + norms - 2 * (q @ x.T)
        limit = last
        if len(x) > k and np.isinf(last).any():
            limit = np.minimum(last, np.partition(rough, k - 1, axis=1)[:, k - 1])
        # the product is off by rounding alone; what lies within that and one digit of the k-th stays
        slack = 10.0**-self.digits + 1e-12 * (norms.max() + squares.max())
        at, of = np.nonzero(rough <= (limit + 2 * slack)[:, None])
        if not len(at):
            return
        found = np.concatenate([((x[of[i : i + SLICE]] - q[at[i : i + SLICE]]) ** 2).sum(1) for i in range(0, len(at), SLICE)])
        found = np.floor(found * 10**self.digits + 0.5) / 10**self.digits
        better = (found < last[at]) | ((found == last[at]) & (own[of] < seq[at, -1]))
        at, of, found = at[better], of[better], found[better]
        rows = np.unique(at)
        row = np.concatenate([np.repeat(np.arange(len(rows)), k), np.searchsorted(rows, at)])
        every, names = np.concatenate([dist[rows].ravel(), found]), np.concatenate([seq[rows].ravel(), own[of]])
        order = np.lexsort((names, every, row))
        top = order[np.searchsorted(row[order], np.arange(len(rows)))[:, None] + np.arange(k)]
        dist[rows], seq[rows] = every[top], names[top]

    def hits(self) -> Iterator[pa.RecordBatch]:
        self.meet()
        for held in self.queries.values():
            for _, _, ids, _, _, dist, seq in held:
                full = seq != NONE
                yield pa.record_batch([pa.array(np.repeat(ids, self.k)[full.ravel()], pa.int64()), pa.array(seq[full], pa.int64()), pa.array(dist[full], pa.float64())], ["query_id", "seq", "dist"])


def _searched(k: int, digits: int, count: bool = False):
    """Rows (turn, shelf, centre, radius, ids, rows), sorted by shelf and turn, to the nearest ``k`` rows of each query, or to the pairs of blocks that were met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, number = None, None

        def out() -> Iterator[pa.RecordBatch]:
            hits = list(shelf.hits())
            return iter([pa.record_batch([pa.array([shelf.met], pa.int64())], ["met"])] if count else hits)

        for batch in batches:
            turn, place, centre, radius, ids, rows = batch.columns
            for i in range(batch.num_rows):
                if place[i].as_py() != number:
                    if shelf is not None:
                        yield from out()
                    shelf, number = _Shelf(k, digits), place[i].as_py()
                own = ids[i].values.to_numpy(zero_copy_only=False)
                # copied, as what waits outlives its batch
                block = (centre[i].values.to_numpy(zero_copy_only=False).copy(), radius[i].as_py(), own.copy(), np.frombuffer(rows[i].as_py()).reshape(len(own), -1))
                (shelf.pass_by if turn[i].as_py() else shelf.put)(*block)
        if shelf is not None:
            yield from out()

    return run


HITS = "query_id long, seq long, dist double"


class Blocks:
    """Vector blocks kept as a table, with their pivots, to be searched by any number of query tables."""

    def __init__(self, table: DataFrame, pivots: dict[int, np.ndarray]):
        self.table, self.pivots = table, pivots

    @classmethod
    def of(cls, vectors: DataFrame, seq: str = "seq", embedding: str = "embedding", pivots: int = PIVOTS) -> Blocks:
        rows = vectors.select(F.col(seq).cast("long").alias("seq"), F.col(embedding).cast("array<double>").alias("v")).filter("seq is not null and size(v) > 0")
        chosen = pivots_of(rows, pivots)
        return cls(written(rows.mapInArrow(_blocks(chosen, VECTOR_BLOCK), BLOCKS), "vector-blocks"), chosen)

    def shelves(self, queries: DataFrame) -> DataFrame:
        """(turn, shelf, centre, radius, ids, rows): the query blocks on their shelves (turn 0), and for each shelf all vector blocks, those of its own groups (1) before
        the others (2)."""
        q = written(queries.mapInArrow(_blocks(self.pivots, QUERY_BLOCK), BLOCKS), "query-blocks")
        blocks = q.count()
        n = max(1, -(-blocks * QUERY_BLOCK // SHELF), min(q.sparkSession.sparkContext.defaultParallelism, blocks))
        placed = written(q.repartitionByRange(n, "group", "block").withColumn("shelf", F.spark_partition_id()), "shelves")
        homes = placed.select("shelf", "group").distinct().withColumn("_home", F.lit(1))  # pivots and shelves bound them, as shelves follow the groups
        # numbers of the shelves
        sent = self.table.crossJoin(F.broadcast(placed.select("shelf").distinct())).join(F.broadcast(homes), ["shelf", "group"], "left")
        own = placed.withColumn("turn", F.lit(0))
        both = own.unionByName(sent.withColumn("turn", F.when(F.col("_home").isNotNull(), 1).otherwise(2)).select(own.columns))
        return both.select("turn", "shelf", "centre", "radius", "ids", "rows").repartitionById(n, F.col("shelf")).sortWithinPartitions("shelf", "turn")

    def top_k(self, queries: DataFrame, k: int, query_id: str = "query_id", embedding: str = "embedding", digits: int = 9) -> DataFrame:
        """(query_id, rank, seq, dist) as ``vector.top_k``, of the whole table."""
        asked = queries.select(F.col(query_id).cast("long").alias("seq"), F.col(embedding).cast("array<double>").alias("v")).filter("seq is not null and size(v) > 0")
        return best(self.shelves(asked).mapInArrow(_searched(k, digits), HITS), k).select("query_id", "rank", "seq", "dist")

    def passed_over(self, queries: DataFrame, k: int, query_id: str = "query_id", embedding: str = "embedding", digits: int = 9) -> DataFrame:
        """One row: pairs of query and vector blocks of one dimension, and how many of them are met."""
        asked = queries.select(F.col(query_id).cast("long").alias("seq"), F.col(embedding).cast("array<double>").alias("v")).filter("seq is not null and size(v) > 0")
        met = self.shelves(asked).mapInArrow(_searched(k, digits, count=True), "met long").agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"))
        blocks = self.table.groupBy(F.size("centre").alias("d")).agg(F.count(F.lit(1)).alias("n"))
        q = asked.mapInArrow(_blocks(self.pivots, QUERY_BLOCK), BLOCKS)
        every = q.groupBy(F.size("centre").alias("d")).agg(F.count(F.lit(1)).alias("m")).join(blocks, "d").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("pairs"))
        return every.crossJoin(met).select("pairs", "met")  # one row each


def best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("dist", "seq"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)
