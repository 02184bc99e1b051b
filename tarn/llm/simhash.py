"""SimHash near-duplicates: a self-join of the binary trie of all fingerprints.

Texts with one fingerprint are joined first. The trie's top levels are traversed as a table: every pair of nodes
at depth p whose prefixes differ in at most the budget's bits, dense nodes in pieces. Each pair's task goes on
in numpy: it walks both subtrees together, adds up differing bits and drops a pair of nodes as soon
as the budget is exceeded. A task returns a spanning forest of the links it found, never all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .graph import connected_components

BITS = 64
#: Fingerprints in a piece of a trie node, at least; the number of top levels follows the number of fingerprints.
PIECE = 1024
#: Every level more copies each fingerprint to more pairs of nodes, so from LEVELS on it takes nodes of LARGE fingerprints (8 MB) to add one.
LEVELS = 14
LARGE = 1 << 20
SMALL = 64
FRONTIER = 1 << 20
#: Rows up to so many are broadcast by their hashes (tens of MB); beyond, they are joined.
TOLD = 1 << 20


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """A bit is set if more than half of the shingles' hashes have it. No words: 0; fewer than a shingle: the one sequence."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) < words:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return set_fingerprint(np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], np.uint64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The same of hashes given: a bit is set if more than half of them have it."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(row, doc_id, fp), row being the hash of doc_id and text, fp a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["row", "doc_id", "fp"])

    own = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "row long, doc_id long, fp long")


def trie_join(a: np.ndarray, b: np.ndarray | None, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted distinct uint64 arrays within ``budget`` bits; b None: pairs i < j of a itself."""
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    one = np.ones(1, np.int64)
    todo = [(0, 0 * one, len(a) * one, 0 * one, len(b) * one, budget * one)]
    while todo:
        depth, alo, ahi, blo, bhi, left = todo.pop()
        small = ((ahi - alo) * (bhi - blo) <= SMALL) | (depth == BITS)
        if small.any():
            yield from _leaves(a, b, own, alo[small], ahi[small], blo[small], bhi[small], budget)
            on = ~small
            alo, ahi, blo, bhi, left = alo[on], ahi[on], blo[on], bhi[on], left[on]
        if not len(alo):
            continue
        bit = np.uint64(1 << (BITS - 1 - depth))
        keep = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
        amid = np.searchsorted(a, (a[alo] & keep) | bit)
        bmid = np.searchsorted(b, (b[blo] & keep) | bit)
        parts = [(alo, amid, blo, bmid, left), (amid, ahi, bmid, bhi, left), (alo, amid, bmid, bhi, left - 1), (amid, ahi, blo, bmid, left - 1)]
        if own:  # of a node with itself, one of the two mixed pairs is enough
            other = alo != blo
            parts[3] = tuple(x[other] for x in parts[3])
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        on = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] >= 0)
        nxt = [x[on] for x in nxt]
        todo += [(depth + 1, *(x[at : at + FRONTIER] for x in nxt)) for at in range(0, len(nxt[0]), FRONTIER)]


def _leaves(a, b, own, alo, ahi, blo, bhi, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Small pairs of ranges, compared entry by entry."""
    na, nb = ahi - alo, bhi - blo
    n = na * nb
    for at in range(0, len(n), FRONTIER // SMALL):
        s = slice(at, at + FRONTIER // SMALL)
        own_n = n[s]
        if not own_n.sum():
            continue
        k = np.repeat(np.arange(len(own_n)), own_n)
        pos = np.arange(len(k)) - np.repeat(np.cumsum(own_n) - own_n, own_n)
        i, j = alo[s][k] + pos // nb[s][k], blo[s][k] + pos % nb[s][k]
        ok = np.bitwise_count(a[i] ^ b[j]) <= budget
        if own:
            ok &= i < j
        if ok.any():
            yield i[ok], j[ok]


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int, shift: int) -> list[tuple[int, int]]:
    """The pairs that join something not yet joined; j counts from ``shift``."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in pairs:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            r, q = root(x), root(y + shift)
            if r != q:
                up[max(r, q)] = min(r, q)
                out.append((x, y))
    return out


def _links(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for same, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                a = np.sort(x.values.to_numpy(zero_copy_only=False).view(np.uint64))
                b = None if same else np.sort(y.values.to_numpy(zero_copy_only=False).view(np.uint64))
                other = a if same else b
                found = forest(trie_join(a, b, budget), len(a) + (0 if same else len(b)), 0 if same else len(a))
                us += [int(a[i].astype(np.int64)) for i, _ in found]
                vs += [int(other[j].astype(np.int64)) for _, j in found]
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def fingerprint_links(classes: DataFrame, budget: int = 2) -> DataFrame:
    """``classes(fp)`` distinct: links (u, v) that connect all fingerprints within ``budget`` bits."""
    n = classes.count()
    p = max(2, min(LEVELS, (n // PIECE).bit_length()), (n // LARGE).bit_length())
    room = max(PIECE, 2 * n >> p)
    node = F.shiftrightunsigned("fp", BITS - p)
    own = classes.select("fp", node.alias("node"))
    pieces = own.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / room).alias("k"))
    # 2**14 rows at most may be broadcast
    own = own.join(F.broadcast(pieces) if p <= LEVELS else pieces, "node").withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("k")))
    own = saved(own.groupBy("node", "piece").agg(F.collect_list("fp").alias("fps")), "trie-nodes")
    masks = [sum(1 << b for b in bits) for k in range(budget + 1) for bits in combinations(range(p), k)]
    ids = own.select("node", "piece")
    near = ids.select(F.col("node").alias("a"), F.col("piece").alias("i"), F.explode(F.array(*[F.col("node").bitwiseXOR(F.lit(m)) for m in masks])).alias("b"))
    pairs = near.join(ids.select(F.col("node").alias("b"), F.col("piece").alias("j")), "b").filter("a < b or (a = b and i <= j)")
    left = own.select(F.col("node").alias("a"), F.col("piece").alias("i"), F.col("fps").alias("x"))
    right = own.select(F.col("node").alias("b"), F.col("piece").alias("j"), F.col("fps").alias("y"))
    tasks = pairs.join(left, ["a", "i"]).join(right, ["b", "j"]).select((F.expr("a = b and i = j")).alias("same"), "x", "y")
    return tasks.mapInArrow(_links(budget), "u long, v long")


def components(fps: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Of ``fps(row, doc_id, fp)`` the saved rows, and (fp, component, component_id) of each fingerprint: a fingerprint of its component, and the smallest doc_id."""
    fps = saved(fps, "fingerprints")
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "fingerprint-classes")
    roots = connected_components(fingerprint_links(classes, budget))
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    least = linked.join(classes, linked["node"] == classes["fp"]).groupBy("root").agg(F.min("first_doc").alias("least"))
    of = linked.join(least, "root").select(F.col("node").alias("fp"), "root", "least")
    ids = classes.join(of, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"), F.coalesce("least", "first_doc").alias("component_id"))
    return fps, saved(ids, "fingerprint-components")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: documents linked by chains of fingerprints within ``budget`` bits.

    Null and blank texts have fingerprint 0 and are linked like any other; component_id is the smallest doc_id
    reachable, nulls aside; repeated rows repeat; other columns don't matter; an empty table gives an empty result.
    """
    fps, ids = components(fingerprints(docs, words, seed), budget)
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of ``rows(row, doc_id, component)``, row being the hash of doc_id and text.

    The smallest doc_id stays, a null one only where there is no other, then the smallest hash; rows that are alike stay once.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    keep = rows.groupBy("component").agg(first.alias("first")).select(F.col("first.row").alias("_tarn_row")).distinct()
    alike = rows.groupBy(F.col("row").alias("_tarn_row")).agg((F.count(F.lit(1)) > 1).alias("again"))
    state = alike.join(keep.withColumn("kept", F.lit(True)), "_tarn_row", "left")
    # rows that go, and rows of which there are more alike; all others pass where they lie
    odd = saved(state.filter("again or kept is null").select("_tarn_row", (F.col("again") & F.col("kept").isNotNull()).alias("_tarn_one")), "odd-rows")
    told = F.broadcast(odd) if odd.count() <= TOLD else odd
    marked = docs.withColumn("_tarn_row", F.xxhash64("doc_id", "text")).join(told, "_tarn_row", "left")
    once = marked.filter("_tarn_one").dropDuplicates(["_tarn_row"])
    return marked.filter("_tarn_one is null").unionByName(once).select(docs.columns)


def deduplicated(docs: DataFrame, words: int = 3, budget: int = 2, seed: int = 42) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest doc_id stays.

    Rows that share an id but not their component are judged apart; the rest is as ``one_of_each`` says.
    """
    fps, ids = components(fingerprints(docs, words, seed), budget)
    return one_of_each(docs, fps.join(ids, "fp").select("row", "doc_id", "component"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
