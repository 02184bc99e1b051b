"""Substring dedup by super-k-mer partitioning.

A window is k consecutive words. Consecutive windows with the same minimiser (the smallest hash of any m words
in the window) travel as one packed string to the minimiser's bucket; there all windows are sorted by their hash,
equal hashes are compared word for word, and each window learns the smallest document it starts in.

Hot keys: a string that occurs again in one task is sent once, with its smallest document; the other occurrences are
decided on the spot and leave by any bucket, in turn. Minimisers that hold more than a set part of all strings are not kept
together: their windows travel one by one to the bucket of the whole window's hash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import free, saved, table

WINDOW = 13
GRAM = 3
#: Text that one bucket stands for, and the least number of buckets.
BUCKET_BYTES = 4 << 20
MIN_BUCKETS = 64
#: A minimiser is hot from this part of all strings on, or from the part that an average bucket holds if that is less, so
#: there are at most so many hot ones, or one a bucket: 8 bytes for 4 MB of text.
HOT_PART = 16384
HOT_LEAST = 64
#: Text scanned at once, and text after which a task packs what it holds.
SLICE_BYTES = 2 << 20
FLUSH_BYTES = 12 << 20
#: Decided ranges that a flush sends by one bucket.
DONE_ROWS = 4096
#: Bytes whose words are hashed at once.
HASHED_BYTES = 1 << 18

_seeds = np.random.default_rng(20240229)
_BYTE = _seeds.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _seeds.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Words:
    """The words of a buffer in which they stand one space apart: their places and hashes."""

    def __init__(self, buf: bytes):
        raw = np.frombuffer(buf, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.start = np.concatenate([[0], gaps + 1]).astype(np.int64)
        self.stop = np.append(gaps, len(raw)).astype(np.int64)
        raw = np.append(raw, np.uint8(32))
        size = self.stop - self.start + 1
        self.hash = np.empty(len(size), np.uint64)
        cuts = np.unique(np.append(np.searchsorted(self.start, np.arange(0, len(raw), HASHED_BYTES)), len(size)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            low, high = int(self.start[a]), int(self.stop[b - 1]) + 1
            first = self.start[a:b] - low
            place = np.arange(high - low) - np.repeat(first, size[a:b])
            value = _BYTE[raw[low:high]] * _PLACE[place & 4095] + _mixed(place.astype(np.uint64) >> np.uint64(12))
            self.hash[a:b] = _mixed(np.add.reduceat(value, first))

    def windows(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the k words from each of ``at`` on."""
        h = np.zeros(len(at), np.uint64)
        for i in range(k):
            h = h * _STEP + self.hash[at + i]
        return _mixed(h)

    def minimisers(self, k: int, m: int) -> np.ndarray:
        """For each place where k words start, the smallest hash of m words in them."""
        n = len(self.hash)
        best = self.windows(m, np.arange(max(0, n - m + 1)))
        span, width = k - m + 1, 1
        while 2 * width <= span:
            best, width = np.minimum(best[:-width], best[width:]), 2 * width
        return np.minimum(best[: len(best) - (span - width)], best[span - width :]) if width < span else best


def runs(texts: list[bytes], k: int, m: int) -> tuple[bytes, Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """The runs of windows with one minimiser, of all texts: buffer, words, first word of each text, owner, first and end window, minimiser."""
    norm = [b" ".join(t.split()) for t in texts]
    counts = np.array([n.count(b" ") + 1 if n else 0 for n in norm], np.int64)
    long = np.flatnonzero(counts >= k)
    if not len(long):
        return None
    buf = b" ".join([norm[i] for i in long])
    w = Words(buf)
    first = np.cumsum(counts[long]) - counts[long]
    own = np.repeat(np.arange(len(long)), counts[long] - k + 1)
    at = np.arange(len(own)) - np.repeat(np.cumsum(counts[long] - k + 1) - (counts[long] - k + 1), counts[long] - k + 1) + first[own]
    least = w.minimisers(k, m)[at]
    new = np.append(True, (own[1:] != own[:-1]) | (least[1:] != least[:-1]))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(own))
    return buf, w, first, long[own[head]], at[head], at[tail - 1] + 1, least[head]


def _heavy(k: int, m: int, least_local: int = 4):
    """Counts of the minimisers that a task sees often; with key null, of all strings and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = size = 0
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, texts in slices(batch.column(0), SLICE_BYTES):
                size += sum(map(len, texts))
                if (got := runs(texts, k, m)) is not None:
                    strings += len(got[6])
                    own, n = np.unique(got[6], return_counts=True)
                    keys, back = np.unique(np.concatenate([keys, own[n > 1]]), return_inverse=True)
                    counts = np.bincount(back, np.concatenate([counts, n[n > 1]]), len(keys)).astype(np.int64)
        often = counts >= least_local
        yield pa.record_batch([pa.array([None, *keys[often].view(np.int64).tolist()], pa.int64()), pa.array([strings, *counts[often].tolist()], pa.int64()), pa.array([size, *[0] * int(often.sum())], pa.int64())], ["key", "n", "size"])

    return run


HEAD = struct.Struct("<III")


def _pack(entries: list[tuple[bytes, list]], done: list[tuple[int, int, int, int]]) -> bytes:
    """entries: (string, [doc, mark, places...]); done: (doc, mark, first word, end word) decided already."""
    docs, marks = np.array([e[0] for _, e in entries], np.int64), np.array([e[1] for _, e in entries], np.int64)
    sizes = np.array([len(e) - 2 for _, e in entries], np.int32)
    words = np.array([s.count(b" ") + 1 for s, _ in entries], np.int32)
    places = np.array([p for _, e in entries for p in e[2:]], np.int32)
    over = np.array(done, np.int64).reshape(-1, 4)
    raw = HEAD.pack(len(entries), len(places), len(over)) + docs.tobytes() + over.tobytes() + marks.tobytes() + sizes.tobytes() + words.tobytes() + places.tobytes() + b" ".join([s for s, _ in entries])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, n_places, n_done = HEAD.unpack_from(raw)
    at = HEAD.size
    out = []
    for kind, count in ((np.int64, n), (np.int64, 4 * n_done), (np.int64, n), (np.int32, n), (np.int32, n), (np.int32, n_places)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    return np.stack([out[0], out[2]], 1), out[1].reshape(-1, 4), out[3], out[4], out[5], raw[at:]


def _strings(k: int, m: int, buckets: int, hot: np.ndarray):
    """Documents to packed strings, a row for each bucket and flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        to: dict[bytes, int] = {}
        more: list[tuple[bytes, int, list]] = []
        done: list[tuple[int, int, int, int]] = []
        size, turn = 0, TaskContext.get().partitionId() * 0x9E3779B1

        def flush() -> pa.RecordBatch:
            nonlocal size, turn
            # what is decided already goes by any bucket: rows of a hot window don't meet again
            parts = {(turn + i) % buckets: done[at : at + DONE_ROWS] for i, at in enumerate(range(0, len(done), DONE_ROWS))} if len(done) <= DONE_ROWS * buckets else {b: done[b::buckets] for b in range(buckets)}
            turn += len(parts) + 1
            by: dict[int, list] = {b: [] for b in parts}
            for s, e in held.items():
                by.setdefault(to[s], []).append((s, e))
            for s, b, e in more:
                by.setdefault(b, []).append((s, e))
            blobs = [_pack(es, parts.get(b, [])) for b, es in by.items()]
            out = pa.record_batch([pa.array(list(by), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "data"])
            for x in (held, to, more, done):
                x.clear()
            size = 0
            return out

        for batch in batches:
            for base, texts in slices(batch.column(2), SLICE_BYTES):
                ids = batch.column(0).slice(base, len(texts)).to_pylist()
                marks = batch.column(1).slice(base, len(texts)).to_pylist()
                texts = [b"" if d is None else t for d, t in zip(ids, texts, strict=True)]
                if (got := runs(texts, k, m)) is None:
                    continue
                buf, w, _, own, head, tail, least = got
                origin = np.full(len(texts), -1, np.int64)
                firsts = np.unique(own)
                origin[firsts] = got[2]
                if len(hot) and (is_hot := np.isin(least, hot)).any():
                    n = (tail - head)[is_hot]
                    single = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(head[is_hot], n)
                    cold = ~is_hot
                    own = np.concatenate([own[cold], np.repeat(own[is_hot], n)])
                    least = np.concatenate([least[cold], w.windows(k, single)])
                    head, tail = np.concatenate([head[cold], single]), np.concatenate([tail[cold], single + 1])
                bucket = (least % np.uint64(buckets)).astype(np.int64).tolist()
                place = (head - origin[own]).tolist()
                n_windows = (tail - head).tolist()
                for o, s, e, b, p, n in zip(own.tolist(), w.start[head].tolist(), w.stop[tail + k - 2].tolist(), bucket, place, n_windows, strict=True):
                    key = buf[s:e]
                    doc, mark = ids[o], marks[o]
                    entry = held.get(key)
                    if entry is None:
                        held[key] = [doc, mark, p]
                        to[key] = b
                    elif entry[0] == doc and entry[1] == mark:
                        entry.append(p)
                    elif entry[0] < doc:
                        done.append((doc, mark, p, p + n + k - 1))
                    elif entry[0] > doc:
                        done.extend((entry[0], entry[1], q, q + n + k - 1) for q in entry[2:])
                        held[key] = [doc, mark, p]
                    else:  # another text under the same id: neither is the smaller one
                        more.append((key, b, [doc, mark, p]))
                size += len(buf)
                if size >= FLUSH_BYTES:
                    yield flush()
        if held or done:
            yield flush()

    return run


def decide(blobs: list[bytes], k: int) -> np.ndarray:
    """Rows (doc, mark, first word, end word) of the runs of windows that also start in a smaller document."""
    parts = [_unpack(b) for b in blobs]
    out = [p[1] for p in parts]
    ids = np.concatenate([p[0] for p in parts])
    sizes, words, places = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (2, 3, 4))
    buf = b" ".join([p[5] for p in parts if len(p[5])])
    if not len(ids):
        return np.concatenate(out)
    w = Words(buf)
    # strings follow one another in the buffer; where each begins is known from their words
    first = np.cumsum(words) - words
    n = words - k + 1
    own = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[own]
    h = w.windows(k, at)
    doc = ids[own, 0]
    order = np.lexsort((doc, h))
    hs, ds = h[order], doc[order]
    new = np.append(True, hs[1:] != hs[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    over = ds > ds[head]
    late = np.zeros(len(h), bool)
    a, b = order[over], order[head[over]]
    sa, ea, sb, eb = w.start[at[a]].tolist(), w.stop[at[a] + k - 1].tolist(), w.start[at[b]].tolist(), w.stop[at[b] + k - 1].tolist()
    equal = np.fromiter((buf[p:q] == buf[r:s] for p, q, r, s in zip(sa, ea, sb, eb, strict=True)), bool, len(sa))
    late[a[equal]] = True
    if not equal.all():  # hashes agree and words don't: those groups are settled by their words
        for g in np.unique(head[over][~equal]):
            least: dict[bytes, int] = {}
            end = g + 1
            while end < len(new) and not new[end]:
                end += 1
            for i in order[g:end]:
                word = buf[w.start[at[i]] : w.stop[at[i] + k - 1]]
                late[i] = doc[i] > least.setdefault(word, doc[i])
    hit = np.flatnonzero(late)
    if len(hit):
        cut = np.append(True, (hit[1:] != hit[:-1] + 1) | (own[hit[1:]] != own[hit[:-1]]))
        s = hit[cut]
        e = hit[np.append(cut[1:], True)]
        o = own[s]
        a0, a1 = at[s] - first[o], at[e] - first[o] + k
        # a string stands at each of its document's places
        reps = sizes[o]
        begin = (np.cumsum(sizes) - sizes)[o]
        idx = np.repeat(begin, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        p = places[idx]
        out.append(np.stack([np.repeat(ids[o, 0], reps), np.repeat(ids[o, 1], reps), p + np.repeat(a0, reps), p + np.repeat(a1, reps)], 1))
    return np.concatenate(out)


def marked(docs: DataFrame, mark: str) -> DataFrame:
    """``docs`` with what tells rows of one id apart: the text's 64-bit hash for ids that several rows have, else 0."""
    own = free(docs, "_tarn_id")
    again = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(own)
    again = saved(again, "repeated-ids")
    if again.isEmpty():
        return docs.withColumn(mark, F.lit(0).cast("long"))
    both = docs.join(again, F.col("doc_id") == F.col(own), "left")
    return both.withColumn(mark, F.when(F.col(own).isNull(), F.lit(0)).otherwise(F.xxhash64("text"))).drop(own)


def repeated_spans(docs: DataFrame, k: int = WINDOW, m: int = GRAM, mark: str = "_tarn_mark") -> DataFrame:
    """(doc_id, mark, first, stop): word ranges of windows that also start in a document with a smaller id; for ``docs`` with a column ``mark``."""
    own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).alias("mark"), F.col("text").cast("binary").alias("text"))
    heavy = own.select("text").mapInArrow(_heavy(k, m), "key long, n long, size long")
    heavy = saved(heavy.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "minimisers")
    total = heavy.filter("key is null").first()
    n, size = (total["n"], total["size"]) if total else (0, 0)
    buckets = max(MIN_BUCKETS, size // BUCKET_BYTES)
    # at most HOT_PART keys of 8 bytes, or one a bucket, can reach the mark
    least = max(HOT_LEAST, n // max(HOT_PART, buckets))
    hot = np.sort(np.array([r["key"] for r in heavy.filter((F.col("n") >= least) & F.col("key").isNotNull()).select("key").collect()], np.int64).view(np.uint64))
    packed = own.mapInArrow(_strings(k, m, buckets, hot), "bucket long, data binary")

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(decide(list(pdf["data"]), k), columns=["doc_id", "mark", "first", "stop"])

    return packed.groupBy("bucket").applyInPandas(reduce, "doc_id long, mark long, first long, stop long")


def without_repeats(docs: DataFrame, k: int = WINDOW, m: int = GRAM) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (the words left, one space apart) added.

    Null and blank texts have no words; texts shorter than a window lose none. A null doc_id is neither smaller nor
    larger than another, so its row loses nothing and removes nothing. Rows that share a doc_id don't affect
    each other. Columns of ``docs`` with the names of the added ones are replaced, all others stay. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    mark, own, own_mark, ranges = (free(docs, f"_tarn_{c}") for c in ("mark", "id", "m", "spans"))
    told = marked(docs.select(*[F.col(f"`{c}`") for c in names]), mark)
    spans = repeated_spans(told, k, m, mark).groupBy(F.col("doc_id").alias(own), F.col("mark").alias(own_mark)).agg(F.collect_list(F.struct("first", "stop")).alias(ranges))
    both = told.join(spans, (F.col("doc_id") == F.col(own)) & (F.col(mark) == F.col(own_mark)), "left").drop(own, own_mark, mark)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", n_words long, n_removed long, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column(ranges), strict=True):
                w = (text.as_py() or "").encode().split()
                left = w
                if spans.is_valid:
                    change = np.zeros(len(w) + 1, np.int64)
                    at = spans.values
                    np.add.at(change, at.field("first").to_numpy(), 1)
                    np.add.at(change, at.field("stop").to_numpy(), -1)
                    left = [x for x, c in zip(w, np.cumsum(change).tolist(), strict=False) if not c]
                n.append(len(w))
                gone.append(len(w) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, schema)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
