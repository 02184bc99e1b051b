"""Line dedup that can be undone: sharded cuckoo filters backed by exact reference-count tables.

Three tables make the state. ``postings(digest, doc_id)`` has each document's long lines,
``counts(digest, n_docs, last_doc)`` the exact number of documents of each, and ``filters(shard, filter)``
one cuckoo filter a shard over the digests that enough documents hold. New documents only add postings,
deleted ones only take theirs away, and counts and filters of the touched shards follow.
A digest is the MD5 of a line's key, 16 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, saved, table
from .cuckoo import CuckooFilter

MIN_CHARS = 40
MIN_DOCS = 5
#: Digests that one shard's filter is built for, and the least number of shards; a shard is chosen by a digest's last four bytes.
SHARD_DIGESTS = 1 << 16
MIN_SHARDS = 16
#: Filters of up to this size together are sent to every task; larger ones meet the digests in a join on the shard.
FILTER_BYTES = 32 << 20
#: Digests that a task packs by shard before it sends them to their filters.
PACK_DIGESTS = 1 << 20


def line_keys(text: bytes | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The digest of each line of a text; None for lines too short to count."""
    out: list[bytes | None] = []
    for line in (text or b"").split(b"\n"):
        key = line.strip().lower()
        n = len(key)
        if n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            out.append(hashlib.md5(key, usedforsecurity=False).digest())
        else:
            out.append(None)
    return out


def _digests(batch: pa.RecordBatch, min_chars: int) -> tuple[list, np.ndarray]:
    """The distinct (doc_id, digest) of a batch of documents."""
    ids, digests = [], []
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        own = set(line_keys(text.as_py(), min_chars))
        own.discard(None)
        ids += [doc] * len(own)
        digests += own
    return ids, np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)


def _shards_of(rows: np.ndarray, shards: int) -> np.ndarray:
    return np.ascontiguousarray(rows[:, 12:]).view(">u4").ravel().astype(np.int64) % shards


def shard_of(digest, shards: int) -> F.Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, 13, 4)), 16, 10).cast("long"), F.lit(shards))


def _rows(ids: list, rows: np.ndarray) -> pa.RecordBatch:
    digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))])
    return pa.record_batch([pa.array(ids, pa.int64()), digests.cast(pa.binary())], ["doc_id", "digest"])


def _postings(min_chars: int, filters: dict[int, bytes] | None = None, shards: int = 1):
    """Documents to their distinct (doc_id, digest); with filters, only those that may be in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = {k: CuckooFilter.from_bytes(v) for k, v in filters.items()} if filters is not None else None
        for batch in batches:
            ids, rows = _digests(batch, min_chars)
            if probe is not None and ids:
                keep = np.zeros(len(ids), bool)
                shard = _shards_of(rows, shards)
                order = np.argsort(shard, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    if (f := probe.get(int(shard[at[0]]))) is not None:
                        keep[at] = f.contains(rows[at])
                ids, rows = [ids[i] for i in np.flatnonzero(keep)], rows[keep]
            yield _rows(ids, rows)

    return run


def _packs(min_chars: int, shards: int):
    """Documents to rows (shard, ids, digests), many digests of a shard in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            shard = _shards_of(rows, shards)
            order = np.argsort(shard, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)
            cols = [[int(shard[at[0]]) for at in parts], [[ids[i] for i in at] for at in parts], [rows[at].tobytes() for at in parts]]
            ids.clear()
            held.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["shard", "ids", "digests"])

        for batch in batches:
            own, rows = _digests(batch, min_chars)
            ids += own
            held.append(rows)
            if len(ids) >= PACK_DIGESTS:
                yield flush()
        if ids:
            yield flush()

    return run


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs with their shard's filter to the (doc_id, digest) that may be in it."""
    for batch in batches:
        for ids, digests, blob in zip(batch.column("ids"), batch.column("digests"), batch.column("filter"), strict=True):
            rows = np.frombuffer(digests.as_py(), np.uint8).reshape(-1, 16)
            keep = CuckooFilter.from_bytes(blob.as_py()).contains(rows)
            yield _rows(ids.values.filter(pa.array(keep)).to_pylist(), rows[keep])


def _filters(groups: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": groups["shard"].iloc[:1], "filter": [CuckooFilter.of(list(groups["digest"])).to_bytes()]})


@dataclass(frozen=True)
class LineIndex:
    """The state; ``build``, ``insert`` and ``delete`` return a new one, so the old stays readable."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep_postings: bool = True) -> LineIndex:
        """keep_postings=False: counts and filters only, for one pass over a corpus that nothing is deleted from."""
        postings = cls._read(docs, min_chars)
        if keep_postings:
            postings = saved(postings, "line-postings")
        counts = saved(cls._count(postings), "line-counts")
        return cls(postings, counts, *cls._filter(counts, min_docs), min_chars, min_docs)

    @staticmethod
    def _read(docs: DataFrame, min_chars: int) -> DataFrame:
        return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_postings(min_chars), "doc_id long, digest binary")

    @staticmethod
    def _count(postings: DataFrame) -> DataFrame:
        # by (digest, doc_id) first: a line of very many documents is counted in many tasks
        each = postings.groupBy("digest", "doc_id").agg(F.lit(1).alias("one"))
        return each.groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))

    @staticmethod
    def _filter(counts: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
        """The filters and the number of shards, which follows the number of digests."""
        often = counts.filter(F.col("n_docs") >= min_docs).select("digest")
        shards = max(MIN_SHARDS, 1 << (often.count() // SHARD_DIGESTS).bit_length())
        each = often.select(shard_of(F.col("digest"), shards).alias("shard"), "digest")
        return saved(each.groupBy("shard").applyInPandas(_filters, "shard long, filter binary"), "line-filters"), shards

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents with new ids: their postings are appended, only the counts they touch change."""
        return self._changed(self._read(docs, self.min_chars).distinct(), add=True)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Takes out the documents of ``ids(doc_id)``, as if they had never been inserted."""
        return self._changed(self.postings.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), add=False)

    def _changed(self, delta: DataFrame, add: bool) -> LineIndex:
        delta = saved(delta, "line-delta")
        postings = self.postings.unionByName(delta) if add else self.postings.join(delta, ["doc_id", "digest"], "left_anti")
        postings = saved(postings, "line-postings")
        touched = delta.select("digest").distinct()
        fresh = self._count(postings.join(touched, "digest", "left_semi"))
        counts = saved(self.counts.join(touched, "digest", "left_anti").unionByName(fresh), "line-counts")
        filters, shards = self._moved(counts, touched)
        return replace(self, postings=postings, counts=counts, filters=filters, shards=shards)

    def _moved(self, counts: DataFrame, touched: DataFrame) -> tuple[DataFrame, int]:
        """Filters after a change: digests that came to enough documents are inserted, those that fell below deleted."""
        often = F.col("n_docs") >= self.min_docs
        now = counts.filter(often).join(touched, "digest", "left_semi").select("digest", F.lit(True).alias("now"))
        was = self.counts.filter(often).join(touched, "digest", "left_semi").select("digest", F.lit(True).alias("was"))
        moves = now.join(was, "digest", "full_outer").filter("now is null or was is null").select(shard_of(F.col("digest"), self.shards).alias("shard"), "digest", F.col("now").isNotNull().alias("enter"))

        def move(key, filters: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            enter, leave = moved.loc[moved["enter"], "digest"], moved.loc[~moved["enter"], "digest"]
            if not len(filters):
                return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.of(list(enter)).to_bytes()]})
            f = CuckooFilter.from_bytes(filters["filter"].iloc[0])
            done = all([f.delete(d) for d in leave]) and all(f.insert(d) for d in enter)
            return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes() if done else None]})

        moved = saved(self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(move, "shard long, filter binary"), "line-filters")
        if moved.filter("filter is null").isEmpty():
            return moved, self.shards
        return self._filter(counts, self.min_docs)  # a shard ran out of room

    def drops(self, docs: DataFrame) -> DataFrame:
        """(doc_id, digests): the lines that each of ``docs`` loses. Filters pass only likely lines on; the exact table decides."""
        own = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        size = self.filters.agg(F.sum(F.length("filter")).alias("n")).first()["n"] or 0
        if size <= FILTER_BYTES:
            filters = {r["shard"]: r["filter"] for r in self.filters.toLocalIterator()}
            near = own.mapInArrow(_postings(self.min_chars, filters, self.shards), "doc_id long, digest binary")
        else:
            packs = own.mapInArrow(_packs(self.min_chars, self.shards), "shard long, ids array<long>, digests binary")
            near = packs.join(self.filters, "shard").mapInArrow(_probed, "doc_id long, digest binary")
        often = self.counts.filter(F.col("n_docs") >= self.min_docs)
        gone = near.join(often, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        return gone.groupBy("doc_id").agg(F.collect_set("digest").alias("drops"))

    def cleaned(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (the text without its dropped lines) added.

        Null or empty text: one empty line. Rows that share a doc_id count as one document. A null
        doc_id is a document too, smaller than all others. Columns of ``docs`` with the names of the added ones are replaced, all
        others stay as they are. An empty table gives an empty result.
        """
        names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
        own, lost = free(docs, "_tarn_id"), free(docs, "_tarn_drops")
        drops = self.drops(docs).withColumnsRenamed({"doc_id": own, "drops": lost})
        both = docs.select(*[F.col(f"`{c}`") for c in names]).join(drops, F.col("doc_id").eqNullSafe(F.col(own)), "left").drop(own)
        rest = [both.schema[c] for c in names]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", n_lines long, n_dropped long, kept string"
        min_chars = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, gone, kept = [], [], []
                for text, drops in zip(batch.column("text"), batch.column(lost), strict=True):
                    raw = (text.as_py() or "").encode()
                    lines = raw.split(b"\n")
                    left = lines
                    if drops.is_valid:
                        out = set(drops.as_py())
                        left = [line for line, key in zip(lines, line_keys(raw, min_chars), strict=True) if key is None or key not in out]
                    n.append(len(lines))
                    gone.append(len(lines) - len(left))
                    kept.append(b"\n".join(left).decode("utf-8", "replace"))
                cols = [batch.column(c) for c in names]
                yield pa.record_batch([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*names, "n_lines", "n_dropped", "kept"])

        return both.mapInArrow(run, schema)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cleaned = LineIndex.build(docs, keep_postings=False).cleaned(docs.select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
