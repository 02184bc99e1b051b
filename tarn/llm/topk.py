"""Exact top-k inner products by the three-phase uniform threshold.

The components are cut into lists; a list's partial products with a query are its local scores. Queries and
vectors lie in blocks, and a tile is a list of a block of queries against the same list of a block of vectors: the unit of all work.
Phase 1: every tile names its best partial products, and mean, spread and largest value of each list become known. The objects
named are resolved, and the k-th best whole score is a safe cutoff for the query.
Phase 2: the cutoff goes to the tiles, in equal parts: a list's threshold is its mean and as many of its spreads as all
lists need to reach the cutoff. An object below all thresholds is below the cutoff; in no list can it lie so low
either that the largest values of all others don't make up for it. Tiles send the entries that pass, packed; tiles whose
largest value is below are not computed again. Partial products too large for 64 bits pass every threshold.
Phase 3: the entries visit the tiles of the lists that they lack, and what reaches the cutoff as a whole is ranked. Parts are added
modulo 2**64, so a score that fits 64 bits is exact, however large its parts are.

A list of a block of vectors is a unit: it is sent once a phase to the task that has its tiles, and the blocks of queries, with
what is known or asked of them, pass by in order. A task so holds one block of vectors and one of queries at a time, and
entries are packed from phase to phase: no row stands for less than a tile until whole scores have reached the cutoff.

Copies of a vector are one object with its k + 1 smallest ids, more of which no query needs. Vectors are laid into blocks by the signs of
fixed random directions, so that like ones lie together and whole tiles can be passed over.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cached_property, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table

#: Lists of components. Two leave the sharpest threshold: the more parts, the smaller the part that must be reached.
LISTS = 2
#: As many vectors and queries as a tile has, about.
BLOCK, QUERY_BLOCK = 16384, 256
#: Queries of a tile that are multiplied at once; entries that are sent as a row, about.
STEP, SENT = 64, 1 << 16
#: Times k that a query's tiles of a list name in all, and each of them at least: the more are resolved first, the higher the cutoff.
NAMED, NAMED_EACH = 3, 1.5
#: Entries of a block of queries that wait for their k best to be taken.
WAITING = 1 << 20
LEAST = np.iinfo(np.int64).min
#: The largest double below 2**63, for components, and where a partial product counts as very large: such entries pass every threshold.
MOST, MOST_PART = (1 << 63) - (1 << 10), 1 << 60
DIRECTIONS = 16
PLACE_BITS = 20
NONE = np.zeros(0, np.int64)


def _integers(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, kept within MOST."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * v.astype(np.float64)), -float(MOST), float(MOST)).astype(np.int64)


def _scaled(scale: int, dims: int):
    """Rows (id, embedding) to (id, components times scale, floored, as int64, filled up with zeros, and the code of the block order)."""
    directions = np.random.default_rng(64).choice([-1.0, 1.0], (dims, DIRECTIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = None if i is None or not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False)
                if x is None or not np.isfinite(x).all():
                    continue
                row = np.zeros(dims, np.int64)
                row[: len(x)] = _integers(x, scale)
                ids.append(i)
                rows.append(row)
            grid = np.array(rows, np.int64).reshape(-1, dims)
            code = ((grid.astype(np.float64) @ directions) > 0) @ (1 << np.arange(DIRECTIONS))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(code.astype(np.int64))], ["id", "vec", "code"])

    return run


def _first_ids(keep: int):
    """A task's copies of a vector to one row with their smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[bytes, tuple[int, set[int]]] = {}
            for i, v, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                by.setdefault(v, (c, set()))[1].add(i)
            ids = [heapq.nsmallest(keep, s) for _, s in by.values()]
            yield pa.record_batch([pa.array(list(by), pa.binary()), pa.array([c for c, _ in by.values()], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["vec", "code", "ids"])

    return run


def _packed(grid: np.ndarray) -> bytes:
    """Integers in as few bytes each as they all fit in, after that number."""
    low, high = (int(grid.min()), int(grid.max())) if grid.size else (0, 0)
    size = next(n for n in (1, 2, 4, 8) if -(1 << 8 * n - 1) <= low and high < 1 << 8 * n - 1)
    return bytes([size]) + np.ascontiguousarray(grid, f"i{size}").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"i{blob[0]}", offset=1)


def _blocks(dims: int):
    """Rows (block, vectors, ids) to a row for each list: packed components, own id (or LEAST where there are more); the ids go with list 0."""
    cuts = np.array_split(np.arange(dims), min(LISTS, dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                block, vecs, ids = (batch.column(c)[n].as_py() for c in range(3))
                grid = np.frombuffer(b"".join(vecs), np.int64).reshape(-1, dims)
                alone = np.array([i[0] if len(i) == 1 else LEAST for i in ids], np.int64).tobytes()
                for g, c in enumerate(cuts):
                    yield pa.record_batch([pa.array([block], pa.int64()), pa.array([g], pa.int32()), pa.array([_packed(grid[:, c])], pa.binary()), pa.array([alone], pa.binary()), pa.array([None if g else ids], pa.list_(pa.list_(pa.int64())))], ["block", "list", "part", "alone", "ids"])

    return run


BLOCKS = "block long, list int, part binary, alone binary, ids array<array<long>>"


class _Side:
    """A list of a block of vectors or queries."""

    def __init__(self, part: bytes, alone: bytes):
        self.alone = np.frombuffer(alone, np.int64)
        self.grid = _unpacked(part).reshape(len(self.alone), -1)
        self.largest = max(abs(int(self.grid.min(initial=0))), abs(int(self.grid.max(initial=0))))
        self.made: dict[type, np.ndarray] = {}

    def of(self, kind: type) -> np.ndarray:
        if kind not in self.made:
            self.made[kind] = self.grid.astype(kind)
        return self.made[kind]

    @cached_property
    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """The sum of all vectors, and of their products with themselves."""
        x = self.of(np.float64)
        return x.sum(0), x.T @ x

    @cached_property
    def by_id(self) -> np.ndarray:
        return np.argsort(self.alone, kind="stable")


class _Tile:
    """A list of a block of queries against a block of vectors."""

    def __init__(self, q: _Side, x: _Side):
        self.q, self.x = q, x
        most = q.grid.shape[1] * q.largest * x.largest
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < MOST_PART else object

    def modulo(self, p: np.ndarray) -> np.ndarray:
        """Products modulo 2**64, as int64."""
        return ((p + (1 << 63)) % (1 << 64) - (1 << 63) if self.kind is object else p).astype(np.int64)

    def products(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partial products of some queries, as they are, and within MOST_PART for comparing."""
        p = self.q.of(self.kind)[rows] @ self.x.of(self.kind).T
        return p, np.clip(p, -MOST_PART, MOST_PART).astype(np.int64) if self.kind is object else p

    def sums(self, rows: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Some queries' sums of partial products and of their squares."""
        if near.dtype.kind == "f":
            a, (one, two) = self.q.of(np.float64)[rows], self.x.moments
            return np.stack([a @ one, ((a @ two) * a).sum(1)])
        wide = near.astype(np.float64)
        return np.stack([wide.sum(1), np.einsum("ij,ij->i", wide, wide)])

    def own(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among ``rows`` and of vectors that are the query's own alone."""
        ids, there = self.q.alone[rows], self.x.alone[self.x.by_id]
        low, high = np.searchsorted(there, ids), np.searchsorted(there, ids, "right")
        n = np.where(ids == LEAST, 0, high - low)
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)), n), self.x.by_id[at]

    def some(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """The partial products at some places, modulo 2**64."""
        out = [np.zeros(0, np.int64)]
        for at in range(0, len(rows), 1 << 15):
            a, b = (x.of(self.kind)[i[at : at + (1 << 15)]] for x, i in ((self.q, rows), (self.x, cols)))
            out.append(self.modulo((a * b).sum(1) if self.kind is object else np.einsum("ij,ij->i", a, b)))
        return np.concatenate(out)


def _bounds(near: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's largest value, and one that at least ``n`` of its entries reach, and not many more: the n-th best of the largest values of groups."""
    size, groups = near.shape[1], max(512, 16 * n)
    best, high = near, near.max(1) if size < 4 * groups else near[:, size // groups * groups :].max(1, initial=LEAST)
    if size >= 4 * groups:
        best = reduce(np.maximum, (near[:, at : at + groups] for at in range(0, size - groups + 1, groups)))
        high = np.maximum(high, best.max(1))
    return high, np.partition(best, best.shape[1] - n, axis=1)[:, best.shape[1] - n]


def _best_places(near: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's largest value, and the places of ``n`` best entries (all above LEAST, if fewer), rows ascending."""
    high, least = _bounds(near, n)
    passes = near >= least[:, None]
    for r in np.flatnonzero(np.count_nonzero(passes, axis=1) > 8 * n):
        passes[r] = False  # many ties
        passes[r, np.argpartition(near[r], near.shape[1] - n)[near.shape[1] - n :]] = True
    i, j = np.divmod(np.flatnonzero(passes), near.shape[1])
    value = near[i, j]
    order = np.lexsort((-value if near.dtype.kind == "f" else ~value, i))
    i, j, value = i[order], j[order], value[order]
    ok = (np.arange(len(i)) - np.searchsorted(i, i) < n) & (value > LEAST)
    return high, i[ok], j[ok]


#: Entries of a tile: their list, how many lists are summed up so far, how many there are; a count for each query, then their places, packed; sums, packed.
PACKED = "list int, done int, qb long, xb long, n long, at binary, parts binary"
#: With them a tile's figures: largest value, sum and sum of squares a query, and how many vectors it has.
FIRST = f"{PACKED}, high binary, sums binary, size long"
FIRST_ARROW = pa.schema([("list", pa.int32()), ("done", pa.int32()), ("qb", pa.int64()), ("xb", pa.int64()), ("n", pa.int64()), ("at", pa.binary()), ("parts", pa.binary()), ("high", pa.binary()), ("sums", pa.binary()), ("size", pa.int64())])


def _entries(g: int, done: int, qb: int, xb: int, rows: np.ndarray, cols: np.ndarray, parts: np.ndarray, *figures) -> pa.RecordBatch:
    """A row of ``PACKED``, or of ``FIRST``; ``rows`` ascend."""
    counts = np.bincount(rows).astype(np.int32)
    at = len(counts).to_bytes(4, "little") + counts.tobytes() + _packed(cols)
    schema = FIRST_ARROW if figures else pa.schema(list(FIRST_ARROW)[:7])
    return pa.record_batch([pa.array([v], f.type) for v, f in zip((g, done, qb, xb, len(rows), at, _packed(parts), *figures), schema, strict=True)], schema=schema)


def _places(at: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(at[:4], "little")
    return np.repeat(np.arange(n), np.frombuffer(at, np.int32, n, 4)), _unpacked(at[4 + 4 * n :]).astype(np.int64)


#: What passes through a unit's task, in the order of qb and kind: its block of vectors, then for each block of queries itself (with what is asked), and what is known of the tile.
BLOCK_ROW, QUERY_ROW, TILE_ROW = range(3)


def _tiles(batches: Iterator[pa.RecordBatch], last: int) -> Iterator[tuple[_Tile, dict]]:
    """The tiles that rows of the kind ``last`` ask for, with these rows and those of their queries."""
    unit = x = q = None
    asked: dict = {}
    for batch in batches:
        for n in range(batch.num_rows):
            row = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
            if row["kind"] == BLOCK_ROW:
                unit, x, q = (row["list"], row["unit"]), _Side(row["part"], row["alone"]), None
                continue
            if unit != (row["list"], row["unit"]):
                raise ValueError(f"a tile of {row['unit']}, list {row['list']}, without its vectors")
            if row["kind"] == QUERY_ROW:
                asked, q = row, _Side(row["part"], row["alone"])
            if row["kind"] == last:
                if q is None or asked["qb"] != row["qb"]:
                    raise ValueError(f"a tile of queries {row['qb']} without them")
                yield _Tile(q, x), asked | {c: v for c, v in row.items() if v is not None}


def _first_phase(k: int):
    """Tiles to their k best entries a query, and their figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, row in _tiles(batches, QUERY_ROW):
            found = [(NONE, NONE, NONE, NONE, np.zeros((2, 0)))]
            for at in range(0, len(t.q.alone), STEP):
                rows = np.arange(at, min(at + STEP, len(t.q.alone)))
                p, near = t.products(rows)
                sums = t.sums(rows, near)
                near[t.own(rows)] = LEAST
                high, i, j = _best_places(near, min(k, near.shape[1]))
                found.append((rows[i], j, t.modulo(p[i, j]), high.astype(np.int64), sums))
            i, j, parts, high = (np.concatenate(c) for c in list(zip(*found, strict=True))[:4])
            yield _entries(row["list"], 1, row["qb"], row["unit"], i, j, parts, high.tobytes(), np.concatenate([f[4] for f in found], axis=1).tobytes(), len(t.x.alone))

    return run


def _second_phase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles with their largest values, and queries with thresholds, to the entries that pass."""
    for t, row in _tiles(batches, TILE_ROW):
        least = np.minimum(np.frombuffer(row["least"], np.int64), MOST_PART)
        asked = np.flatnonzero(np.frombuffer(row["high"], np.int64) >= least)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(asked), STEP):
            rows = asked[at : at + STEP]
            p, near = t.products(rows)
            passes = near >= _below(least[rows], near.dtype)[:, None]
            passes[t.own(rows)] = False
            i, j = np.divmod(np.flatnonzero(passes), near.shape[1])
            found.append((rows[i], j, t.modulo(p[i, j])))
            if (n := sum(len(f[0]) for f in found)) and (n >= SENT or at + STEP >= len(asked)):
                yield _entries(row["list"], 1, row["qb"], row["unit"], *(np.concatenate(c) for c in zip(*found, strict=True)))
                found = []


def _below(x: np.ndarray, kind: np.dtype) -> np.ndarray:
    """``x`` as ``kind``, rounded down: integers beyond a float's exact ones mustn't become larger."""
    y = x.astype(kind)
    if kind.kind != "f":
        return y
    # a value at MOST_PART or so is above all that the kind holds exactly, and above all products of that kind
    return np.where(y.astype(np.float64) > x.astype(np.float64), np.nextafter(y, kind.type(-np.inf)), y)


def _third_phase(batches: Iterator[pa.RecordBatch], flat: bool = False) -> Iterator[pa.RecordBatch]:
    """Entries in a tile of a list that they lack: the part is added. Where queries have a cutoff, what reaches it stays; ``flat``: a row each."""
    for t, row in _tiles(batches, TILE_ROW):
        rows, cols = _places(row["at"])
        score = _unpacked(row["parts"]).astype(np.int64) + t.some(rows, cols)
        if row.get("cutoff") is not None:
            ok = score >= np.frombuffer(row["cutoff"], np.int64)[rows]
            rows, cols, score = rows[ok], cols[ok], score[ok]
        if flat:
            yield _flat(row["qb"], row["unit"], rows, cols, score)
        elif len(rows):
            yield _entries(row["list"], row["done"] + 1, row["qb"], row["unit"], rows, cols, score)


def _flat(qb: int, xb: int, rows: np.ndarray, cols: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array((qb << PLACE_BITS) + rows), pa.array((xb << PLACE_BITS) + cols), pa.array(score)], ["q", "x", "score"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries to a row each."""
    for batch in batches:
        for n in range(batch.num_rows):
            qb, xb, at, parts = (batch.column(c)[n].as_py() for c in ("qb", "xb", "at", "parts"))
            yield _flat(qb, xb, *_places(at), _unpacked(parts).astype(np.int64))


SCORES = "q long, x long, score long"


def _best(k: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query's place, object, score) of each query, each once; in the order of place, then score."""
    rows, x, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((x, ~score, rows))
    rows, x, score = rows[order], x[order], score[order]
    # an object's whole score is the same from whichever list it was named
    ok = np.append(True, (rows[1:] != rows[:-1]) | (x[1:] != x[:-1]))[: len(rows)]
    rows, x, score = rows[ok], x[ok], score[ok]
    ok = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[ok], x[ok], score[ok]


def _limits(k: int, m: int):
    """Rows of a block of queries together, resolved entries and tiles' figures, to each list's thresholds, with the cutoff."""

    def made(qb: int, found: list, high: dict, sums: dict, size: dict) -> Iterator[pa.RecordBatch]:
        n = len(high[0])
        cutoff, known = np.full(n, LEAST), np.zeros(n, bool)
        if found:
            rows, _, score = _best(k, found)
            ends = np.searchsorted(rows, np.arange(n), "right")
            known = ends - np.searchsorted(rows, np.arange(n)) == k
            cutoff[known] = score[ends[known] - 1]
        top = np.array([high[g] for g in range(m)])
        wide, cut = top.astype(np.float64), cutoff.astype(np.float64)
        mean, square = np.array([sums[g] / size[g] for g in range(m)]).transpose(1, 0, 2)
        spread = 1 + np.sqrt(np.maximum(0, square - mean * mean))
        # floors add up to the cutoff at most, whatever the means and spreads are; one off for each list covers their rounding as doubles
        slack = 1 + 1e-12 * (np.abs(mean).sum(0) + np.abs(wide).sum(0) + np.abs(cut))
        part = mean + (cut - mean.sum(0)) * spread / spread.sum(0)
        # a largest value at MOST_PART may stand for more
        others = np.where(top.max(0) < MOST_PART, cut - (wide.sum(0) - wide), -np.inf)
        # partial products are compared within MOST_PART
        least = np.clip(np.floor(np.maximum(part, others) - slack), -2.0 * MOST_PART, MOST_PART).astype(np.int64)
        least[:, ~known] = LEAST
        for g in range(m):
            yield pa.record_batch([pa.array([g], pa.int32()), pa.array([qb], pa.int64()), pa.array([least[g].tobytes()], pa.binary()), pa.array([cutoff.tobytes()], pa.binary())], ["list", "qb", "least", "cutoff"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, waiting = None, [], 0
        high, sums, size = {}, {}, {}
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                if row["qb"] != at:
                    if at is not None:
                        yield from made(at, found, high, sums, size)
                    at, found, waiting, high, sums, size = row["qb"], [], 0, {}, {}, {}
                if row["high"] is None:
                    rows, cols = _places(row["at"])
                    found.append((rows, (row["xb"] << PLACE_BITS) + cols, _unpacked(row["parts"]).astype(np.int64)))
                    waiting += len(rows)
                    if waiting >= WAITING:
                        found = [_best(k, found)]
                        waiting = 0
                else:
                    g = row["list"]
                    h, s = np.frombuffer(row["high"], np.int64), np.frombuffer(row["sums"], np.float64).reshape(2, -1)
                    high[g], sums[g], size[g] = (np.maximum(high[g], h), sums[g] + s, size[g] + row["size"]) if g in high else (h, s, row["size"])
        if at is not None:
            yield from made(at, found, high, sums, size)

    return run


class Search:
    """The phases over saved blocks; ``counts`` tells how many entries each one sent."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, k: int, scale: int):
        self.k = k
        width = lambda df: df.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
        self.dims = dims = max(1, width(vectors), width(queries))
        self.lists = min(LISTS, dims)
        pair = lambda df: df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        whole = lambda df: pair(df).mapInArrow(_scaled(scale, dims), "id long, vec binary, code long")
        local = whole(vectors).mapInArrow(_first_ids(k + 1), "vec binary, code long, ids array<long>")
        once = local.groupBy("vec").agg(F.first("code").alias("code"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
        self.x = self._laid(saved(once, "topk-vectors"), BLOCK, "topk-blocks")
        asked = whole(queries).select("vec", "code", F.array("id").alias("ids")).distinct()
        self.q = self._laid(saved(asked, "topk-queries"), QUERY_BLOCK, "topk-query-blocks")
        self.counts: dict[str, int] = {}

    def _laid(self, rows: DataFrame, size: int, name: str) -> DataFrame:
        """Blocks of like vectors, about as large as ``size``: a code's rows follow those of the codes before it, in the order of their hash."""
        codes = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
        # at most 2**DIRECTIONS rows
        codes = codes.withColumn("before", F.sum("n").over(W.orderBy("code")) - F.col("n"))
        place = F.col("before") + F.pmod(F.xxhash64("vec", "ids"), F.col("n"))
        laid = rows.join(F.broadcast(codes), "code").withColumn("place", place).withColumn("block", F.expr(f"place div {size}"))
        laid = laid.groupBy("block").agg(F.collect_list(F.struct("vec", "ids")).alias("rows")).select("block", "rows.vec", "rows.ids")
        return saved(laid.mapInArrow(_blocks(self.dims), BLOCKS), name)

    def _units(self, queries: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
        """The rows of every unit together and in order: ``queries(list, qb, part, alone, ...)`` go to all units of their list, ``tiles(list, unit, qb, ...)`` to their own."""
        kind = lambda n: F.lit(n).alias("kind")
        rows = self.x.select("list", F.col("block").alias("unit"), F.lit(None).cast("long").alias("qb"), kind(BLOCK_ROW), "part", "alone")
        every = self.x.select("list", F.col("block").alias("unit"))
        rows = rows.unionByName(queries.join(F.broadcast(every), "list").withColumn("kind", kind(QUERY_ROW)), allowMissingColumns=True)
        if tiles is not None:
            rows = rows.unionByName(tiles.withColumn("kind", kind(TILE_ROW)), allowMissingColumns=True)
        return rows.repartition(2 * self.units, "list", "unit").sortWithinPartitions("list", "unit", F.col("qb").asc_nulls_first(), "kind")

    def _next(self, entries: DataFrame) -> DataFrame:
        """Entries as rows of the tiles that have the next list of their vectors."""
        return entries.select(((F.col("list") + 1) % self.lists).alias("list"), F.col("xb").alias("unit"), "qb", "done", "at", "parts")

    def run(self) -> DataFrame:
        k, m = self.k, self.lists
        rank = lambda by, score, tie: F.row_number().over(W.partitionBy(by).orderBy(F.col(score).desc(), tie))
        self.units = max(1, self.x.count())
        q = self.q.select("list", F.col("block").alias("qb"), "part", "alone")
        # phase 1: every tile's best and its figures
        best = max(math.ceil(NAMED * k * m / self.units), math.ceil(NAMED_EACH * k))
        first = saved(self._units(q).mapInArrow(_first_phase(best), FIRST), "topk-first")
        named = first.select("list", "done", "qb", "xb", "n", "at", "parts")
        self.counts["named"] = (named.agg(F.sum("n").alias("n")).first()["n"] or 0) * (m - 1)
        for _ in range(1, m):
            named = self._units(q, self._next(named)).mapInArrow(_third_phase, PACKED)
        # resolved entries and the tiles' figures of a block of queries meet
        both = named.unionByName(first.select("list", "qb", "high", "sums", "size"), allowMissingColumns=True)
        limits = both.repartition("qb").sortWithinPartitions("qb").mapInArrow(_limits(k, m), "list int, qb long, least binary, cutoff binary")
        limits = saved(limits, "topk-limits")
        # phase 2: a tile hears the thresholds of its queries
        asked = q.join(limits.select("list", "qb", "least"), ["list", "qb"])
        high = first.select("list", F.col("xb").alias("unit"), "qb", "high")
        seen = Observation("topk-second")
        sent = self._units(asked, high).mapInArrow(_second_phase, PACKED).observe(seen, F.sum("n").alias("n"))
        # phase 3: from list to list
        last = q.join(limits.select("list", "qb", "cutoff"), ["list", "qb"])
        for step in range(1, m):
            rows = self._units(last if step == m - 1 else q, self._next(sent))
            sent = rows.mapInArrow(partial(_third_phase, flat=True), SCORES) if step == m - 1 else rows.mapInArrow(_third_phase, PACKED)
        whole = saved(sent if m > 1 else sent.mapInArrow(_whole, SCORES), "topk-whole")
        self.counts["second"] = seen.get["n"] or 0
        ids = self.x.filter("list = 0").select("block", F.posexplode("ids").alias("place", "ids")).select((F.shiftleft("block", PLACE_BITS) + F.col("place")).alias("x"), "ids")
        own = self.q.filter("list = 0").select("block", F.posexplode("ids").alias("place", "ids")).select((F.shiftleft("block", PLACE_BITS) + F.col("place")).alias("q"), F.col("ids")[0].alias("query_id"))
        each = whole.distinct().join(ids, "x").join(own, "q").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
        return each.withColumn("rank", rank("query_id", "score", "vec_id")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries(vec_id, embedding)`` against ``vectors(vec_id, embedding)``.

    Score: inner product of floor(scale * x); ties to the smaller id; rows with the query's own id are not its candidates.
    Vectors without an id, null or with a null or non-finite component take no part; shorter ones count as filled up with zeros. Scores that fit
    64 bits are exact, whatever their parts are; others are taken modulo 2**64, and components beyond 64 bits as the largest there are. Repeated rows
    count once; other columns don't matter. No rows or no queries: an empty result.
    """
    return Search(vectors, queries, k, scale).run()


def op10_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))
