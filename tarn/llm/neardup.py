"""Near-duplicates by SimHash, with an exact check: word shingles with a Jaccard similarity from a bound on.

The SimHash operator comes first: fingerprints of the sets of shingles, its trie self-join for pairs within a few bits,
and the whole sets of these pairs decide. Pairs at the bound differ in 8 to 18 bits, though, where a trie of 64 bits passes over nothing
(see the README), so what the error budget can't reach is completed by prefix filters, which miss no pair: shingles
have one order, the common ones last, and two sets that are similar enough share one of the first n - ceil(bound n) + 1 shingles
of both. Shingles that a sample shows to be common only set the order. Candidates are compared by their whole sets. Pairs that
are linked already, directly or by a chain, needn't be compared: groups of many texts with a common shingle are first linked by chains
through them and to their largest part, and only what is still apart then is compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .graph import connected_components
from .simhash import TOLD, fingerprint_links, one_of_each, set_fingerprint

WORDS = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: One text in so many is sampled for common shingles; at least so many of the sample hold one; at most so many are put last.
SAMPLE, COMMON, MOST = 16, 4, 1 << 17
#: Groups of so many texts are compared pair by pair at once; larger ones after being linked by chains.
FEW = 8
CHAINS = 3
#: Bits that fingerprints may differ in for the SimHash self-join.
BUDGET = 3
MIX = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all sequences of ``words`` folded words; of a shorter text the one sequence, of a blank one none."""
    w = (text or "").lower().encode().split()
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w))][: len(w)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(h) - words + 1
    s = np.zeros(n, np.uint64)
    for i in range(words):
        s ^= h[i : i + n]
        s *= np.uint64(MIX[i % len(MIX)])
        s ^= s >> np.uint64(29)
    return np.unique(s)


def _digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _sampled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.record_batch([pa.array(shingles(t.as_py(), words).view(np.int64))], ["key"])

    return run


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and how many sampled texts hold each."""
    texts = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    counted = texts.mapInArrow(_sampled(words), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    found = counted.orderBy(F.desc("n"), "key").limit(MOST).toPandas()
    keys, n = found["key"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix(s: np.ndarray, keys: np.ndarray, n: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The first shingles of a set in the common order, so many that any two sets similar enough share one."""
    p = len(s) + (-len(s) * least[0]) // least[1] + 1 if len(s) else 0
    if not len(keys):
        return s[:p]
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    return s[np.argsort(np.where(keys[at] == s, n[at], 0), kind="stable")][:p]


def _prefixes(words: int, least: tuple[int, int], keys: np.ndarray, n: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column(2)]
            fps = pa.array(np.array([_digest(s) for s in sets], np.uint64).view(np.int64))
            bits = pa.array(np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64))
            firsts = pa.array([prefix(s, keys, n, least).tobytes() for s in sets], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), fps, bits, pa.array([len(s) for s in sets], pa.int32()), firsts], ["row", "doc_id", "fp", "bits", "n", "firsts"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        firsts = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(2)]
        many = np.array([len(x) for x in firsts], np.int64)
        if not many.sum():
            continue
        fp, n = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), many) for k in (0, 1))
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        yield pa.record_batch([pa.array(np.concatenate(firsts)), pa.array(fp), pa.array(n), pa.array(at.astype(np.int32))], ["key", "fp", "n", "at"])


def _whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray] | None:
    t = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in t]) for k in range(len(names))] if t else None


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of shingles that two sets or more have in their prefixes, copies once; a task has all of a shingle."""
    names = ["key", "fp", "n", "at"]
    if (cols := _whole(batches, names)) is None:
        return
    order = np.lexsort((cols[1], cols[0]))
    cols = [c[order] for c in cols]
    new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
    cols = [c[new] for c in cols]
    again = cols[0][1:] == cols[0][:-1]
    on = np.r_[again, False] | np.r_[False, again]
    for at in range(0, int(on.sum()), 1 << 16):
        yield pa.record_batch([pa.array(c[on][at : at + (1 << 16)]) for c in cols], names)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.view(np.uint64) ^ np.uint64(MIX[salt])) * np.uint64(MIX[1])
    return (x ^ (x >> np.uint64(31))) * np.uint64(MIX[2])


def _candidates(step: int, least: tuple[int, int]):
    """Pairs to compare. Step 0: all of small groups, chains of the others; 1: texts with some of the group's largest part; 2: all that are still apart."""
    p, q = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (cols := _whole(batches, ["key", "fp", "n", "at", "root"])) is None:
            return
        order = np.lexsort((cols[1], cols[2], cols[0]))
        key, fp, n, at, root = (c[order] for c in cols)
        n, at = n.astype(np.int64), at.astype(np.int64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        seen = [np.zeros((0, 2), np.int64)]
        waiting = 0

        def take(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal waiting
            lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            # what both can still share from this shingle on, if it is the first they share
            rest = np.minimum(n[i] - at[i], n[j] - at[j])
            on = (root[i] != root[j]) & (q * lo >= p * hi) & (rest * (p + q) >= p * (n[i] + n[j]))
            a, b = fp[i[on]], fp[j[on]]
            seen.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            waiting += len(a)

        def distinct() -> pa.RecordBatch:
            nonlocal seen, waiting
            x = np.unique(np.concatenate(seen), axis=0)
            seen, waiting = [np.zeros((0, 2), np.int64)], 0
            return pa.record_batch([pa.array(np.ascontiguousarray(x[:, k])) for k in (0, 1)], ["a", "b"])

        size = ends - starts
        for m in range(2, FEW + 1) if step == 0 else ():
            s = starts[size == m]
            for i in range(m):
                for j in range(i + 1, m):
                    take(s + i, s + j)
        for lo, hi in zip(starts[size > FEW].tolist(), ends[size > FEW].tolist(), strict=True):
            g = np.arange(lo, hi)
            if step == 0:
                take(g[1:], g[:-1])
                for salt in range(CHAINS - 1):
                    x = g[np.argsort(_mixed(fp[g], salt))]
                    take(x[1:], x[:-1])
                continue
            parts, of, many = np.unique(root[g], return_inverse=True, return_counts=True)
            if len(parts) == 1:
                continue
            big = int(np.argmax(many))
            if step == 1:
                left, main = g[of != big], g[of == big]
                main = main[np.argsort(_mixed(fp[main], 0))]
                for k in range(CHAINS + FEW):
                    take(left, main[((_mixed(fp[left], 0) + np.uint64(k)) % np.uint64(len(main))).astype(np.int64)])
                for salt in range(CHAINS):
                    x = left[np.argsort(_mixed(fp[left], salt + 2))]
                    take(x[1:], x[:-1])
                continue
            # the larger sets of each text that the bound on sizes admits, of other parts
            last = np.searchsorted(n[lo:hi] * p, n[lo:hi] * q, side="right") + lo
            for i in range(lo, hi - 1):
                if last[i - lo] > i + 1:
                    j = np.arange(i + 1, last[i - lo])
                    take(np.full(len(j), i), j)
                if waiting > 1 << 20:
                    yield distinct()
        yield distinct()

    return run


def _packed(s: np.ndarray) -> bytes:
    """Sets travel and are compared by the upper 40 bits of their hashes."""
    s = np.unique(s >> np.uint64(24))
    return (s >> np.uint64(8)).astype(np.uint32).tobytes() + s.astype(np.uint8).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    n = len(b) // 5
    return np.frombuffer(b, np.uint32, n).astype(np.uint64) << np.uint64(8) | np.frombuffer(b, np.uint8, n, 4 * n)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words) for t in batch.column(0)]
            fps = np.array([_digest(s) for s in found], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(fps), pa.array([_packed(s) for s in found], pa.binary())], ["fp", "set"])

    return run


def _compared(least: tuple[int, int]):
    p, q = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = _unpacked(x.as_py()), _unpacked(y.as_py())
                both = len(x) + len(y) - len(np.union1d(x, y))
                on.append(q * both >= p * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(on, pa.bool_()))

    return run


def _similar(own: DataFrame, firsts: DataFrame, pairs: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) of ``pairs(a, b)`` whose whole sets are similar enough; only the texts of these pairs are read as sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    one = saved(firsts.select("fp", "row").join(ids, "fp", "left_semi").groupBy("fp").agg(F.min("row").alias("row")), "candidate-rows").select("row")
    told = F.broadcast(one) if one.count() <= TOLD else one
    sets = own.select("row", "text").join(told, "row", "left_semi").select("text").mapInArrow(_sets(words), "fp long, set binary")
    # a row that stands more than once in the table gives its set more than once
    sets = saved(sets.groupBy("fp").agg(F.first("set").alias("set")), "shingle-sets")
    x, y = (sets.select(F.col("fp").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
    return saved(pairs.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(_compared(least), "u long, v long"), "similar-pairs")


def _close(firsts: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets by SimHash: those of one fingerprint with the first of them, and the first ones of fingerprints that the trie self-join links."""
    first = saved(firsts.filter("n > 0").groupBy("bits").agg(F.min("fp").alias("a")), "simhash-classes")
    alike = firsts.select("bits", F.col("fp").alias("b")).distinct().join(first, "bits").filter("a <> b").select("a", "b")
    links = fingerprint_links(first.select(F.col("bits").alias("fp")), BUDGET)
    x, y = (first.select(F.col("bits").alias(c), F.col("a").alias(n)) for c, n in (("u", "a"), ("v", "b")))
    near = links.join(x, "u").join(y, "v").select("a", "b")
    return alike.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_documents(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """(row, doc_id, component) for every row: documents linked by chains of pairs whose shingles are ``least`` similar.

    row is the hash of doc_id and text. Blank and null texts have no shingles and are copies of each other; texts of fewer words than a shingle
    are similar if their words are the same. component is the digest of one of the component's sets.
    """
    own = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys, n = common_shingles(docs, words)
    firsts = saved(own.mapInArrow(_prefixes(words, least, keys, n), "row long, doc_id long, fp long, bits long, n int, firsts binary"), "shingle-prefixes")
    postings = firsts.select("fp", "n", "firsts").mapInArrow(_postings, "key long, fp long, n int, at int")
    shared = saved(postings.repartition("key").mapInArrow(_shared, "key long, fp long, n int, at int"), "shared-shingles")
    links = _similar(own, firsts, saved(_close(firsts), "candidate-pairs"), words, least)
    roots = connected_components(links)
    for step in range(3):
        at = shared.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        pairs = at.select("key", "fp", "n", "at", "root").repartition("key").mapInArrow(_candidates(step, least), "a long, b long").distinct()
        new = _similar(own, firsts, saved(pairs, "candidate-pairs"), words, least)
        links = links.unionByName(new)
        if not new.isEmpty():
            roots = connected_components(links)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return firsts.select("row", "doc_id", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("row", "doc_id", F.coalesce("root", "fp").alias("component"))


def deduplicated(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest doc_id stays."""
    return one_of_each(docs, similar_documents(docs, words, least))
