"""Benchmark decontamination over a positional inverted index.

Documents are cut into chunks of some million words. A chunk has one row for each of its terms, with the places of that
term counted through the chunk, and one row with its documents and where they start; a frequent term is spread over as
many rows as there are chunks. A search sends the postings of the benchmark's terms, chunk by chunk, to the tasks. There all
windows are intersected at once: a window starts with the places of its rarest term in that chunk, shifted by the term's
offset, and each further term, rarest first, keeps the places that its own shifted list has. What is left is the exact
phrase. With ``within`` the terms need only lie near their rarest one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_table, saved, table

WINDOW = 10
#: Words and documents after which a chunk ends; a document is never cut.
CHUNK_WORDS = 1 << 22
CHUNK_DOCS = 1 << 17
#: Bytes of a text that are split into words at once.
SLICE = 1 << 22
#: Rows that leave a task at once.
ROWS = 1 << 16
#: Benchmark text that one search carries to its tasks, and the longest piece of an item.
BLOCK_BYTES = 2 << 20
PIECE_WORDS = 4096
#: Candidate places that a task holds at once.
CANDIDATES = 1 << 21

#: Digits, letters and everything beyond ASCII make words; A-Z are folded.
FOLD = ascii_table(b"0123456789abcdefghijklmnopqrstuvwxyz")

INDEX = "chunk long, term string, n long, places binary, doc_ids array<long>, starts array<long>"
HITS = "chunk long, place long, doc_id long, n_words long, items array<struct<item_id:string,spans:array<struct<start:long,stop:long>>>>"
SPANS = pa.list_(pa.struct([("item_id", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]))


def slices(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time."""
    folded = (text or b"").translate(FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE) if at + SLICE < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the rows of the index."""
    base, made = TaskContext.get().partitionId() << 32, 0
    vocabulary: defaultdict = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    ids, docs, starts = [], [], [0]

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal made
        chunk, made = base + made, made + 1
        words = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        order = np.argsort(words, kind="stable").astype(np.uint32)
        counts = np.bincount(words, minlength=len(vocabulary))
        ends = np.cumsum(counts)
        steps = np.diff(order, prepend=np.uint32(0))
        firsts = ends - counts
        steps[firsts] = order[firsts]
        offsets = np.concatenate([[0], ends * 4])
        terms = pa.array(list(vocabulary), pa.binary()).cast(pa.string())
        places = pa.Array.from_buffers(pa.large_binary(), len(terms), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(steps)])
        for at in range(0, len(terms), ROWS):
            n = min(ROWS, len(terms) - at)
            columns = [pa.repeat(pa.scalar(chunk, pa.int64()), n), terms[at : at + n], pa.array(counts[at : at + n], pa.int64()), places[at : at + n].cast(pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["chunk", "term", "n", "places", "doc_ids", "starts"])
        one = [[chunk], [None], [len(words)], [None], [docs], [starts]]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(one, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["chunk", "term", "n", "places", "doc_ids", "starts"])
        vocabulary.clear()
        ids.clear()
        docs.clear()
        starts[:] = [0]

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n = 0
            for words in slices(text.as_py()):
                ids.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                n += len(words)
            docs.append(doc)
            starts.append(starts[-1] + n)
            if starts[-1] >= CHUNK_WORDS or len(docs) >= CHUNK_DOCS:
                yield from flush()
    if docs:
        yield from flush()


def _pieces(window: int, blocks: int):
    """(item_id, text) to pieces (block, item_id, words) of some thousand words that share window - 1 words, so that no window is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            out: list = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = [w for part in slices(text.as_py()) for w in part]
                for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                    out.append((seen % blocks, item or "", b" ".join(words[at : at + PIECE_WORDS + window - 1])))
                    seen += 1
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()).cast(pa.string())], ["block", "item_id", "words"])

    return run


@dataclass
class Wanted:
    """The windows of a block of the benchmark: numbered terms, a row of term numbers a window (-1 beyond its end), its item."""

    terms: dict[str, int]
    windows: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, pieces: list[tuple[str, str]], window: int) -> Wanted:
        terms: dict[str, int] = {}
        names = sorted({item for item, _ in pieces})
        number = {x: i for i, x in enumerate(names)}
        rows, lengths, items = [], [], []
        for item, text in pieces:
            ids = np.array([terms.setdefault(w, len(terms)) for w in text.split(" ")], np.int32)
            if len(ids) < window:
                ids, n = np.concatenate([ids, np.full(window - len(ids), -1, np.int32)]), len(ids)
            else:
                n = window
            own = np.lib.stride_tricks.sliding_window_view(ids, window)
            rows.append(own)
            lengths.append(np.full(len(own), n))
            items.append(np.full(len(own), number[item]))
        if not rows:
            return cls({}, np.zeros((0, window), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), [])
        return cls(terms, np.concatenate(rows), np.concatenate(lengths), np.concatenate(items), names)


class Lists:
    """The postings of one chunk by term number, as one sorted array of term * span + place."""

    def __init__(self, chunk: pa.Table, terms: dict[str, int]):
        words = chunk.filter(pa.compute.is_valid(chunk["term"]))
        head = chunk.filter(pa.compute.is_null(chunk["term"]))
        self.doc_ids, self.starts = head["doc_ids"][0].as_py(), np.array(head["starts"][0].as_py(), np.int64)
        numbers = np.array([terms[t] for t in words["term"].to_pylist()], np.int64)
        order = np.argsort(numbers)
        steps = [np.frombuffer(x.as_buffer(), np.uint32) for x in words["places"].take(pa.array(order)).combine_chunks()]
        sizes = np.array([len(x) for x in steps], np.int64)
        self.span = int(self.starts[-1]) + 64  # no window reaches from one term's places into another's
        self.first, self.count = np.zeros(len(terms) + 1, np.int64), np.zeros(len(terms) + 1, np.int64)
        ends = np.cumsum(sizes)
        self.first[numbers[order]], self.count[numbers[order]] = ends - sizes, sizes
        flat = np.cumsum(np.concatenate(steps), dtype=np.int64) if steps else np.zeros(0, np.int64)
        before = np.concatenate([[0], flat[ends[:-1] - 1]]) if steps else np.zeros(0, np.int64)
        self.keys = flat - np.repeat(before, sizes) + np.repeat(numbers[order] * self.span, sizes)

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the term's list has the place."""
        want = term * self.span + place
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return self.keys[at] == want

    def places(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of ``terms``: (index into terms, place), all places of each, a bounded number at a time unless one list is longer."""
        sizes = self.count[terms]
        ends, at = np.cumsum(sizes), 0
        while at < len(terms):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + CANDIDATES, "right")))
            own = np.repeat(np.arange(at, stop), sizes[at:stop])
            k = np.arange(len(own)) - np.repeat(ends[at:stop] - sizes[at:stop] - before, sizes[at:stop]) + self.first[terms[own]]
            yield own, self.keys[k] - terms[own] * self.span
            at = stop

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1


def _rarest_first(lists: Lists, wanted: Wanted) -> tuple[np.ndarray, np.ndarray]:
    """Windows all of whose terms the chunk has, and the offsets of their terms, those of the rarest first; offsets beyond the end come last."""
    n = lists.count[wanted.windows]
    n[wanted.windows < 0] = np.iinfo(np.int64).max
    here = np.flatnonzero((n > 0).all(1))
    return here, np.argsort(n[here], axis=1, kind="stable")


def phrases(lists: Lists, wanted: Wanted) -> tuple[np.ndarray, ...]:
    """(window, start, stop) of every exact occurrence inside one document."""
    here, order = _rarest_first(lists, wanted)
    if not len(here):
        return (np.zeros(0, np.int64),) * 3
    win, size = wanted.windows[here].astype(np.int64), wanted.lengths[here]
    at = np.arange(len(here))
    t0, t1 = win[at, order[:, 0]], np.where(size > 1, win[at, order[:, 1]], -1) if win.shape[1] > 1 else np.full(len(here), -1)
    gap = np.where(t1 >= 0, order[:, 1] - order[:, 0], 0) if win.shape[1] > 1 else np.zeros(len(here), np.int64)
    # neighbouring windows have the same two rarest terms at the same distance: their lists are intersected once
    pairs, member = np.unique(np.stack([t0, t1, gap], 1), axis=0, return_inverse=True)
    member = member.ravel()
    by_pair = np.argsort(member, kind="stable")
    n_of = np.bincount(member, minlength=len(pairs))
    first_of = np.cumsum(n_of) - n_of
    found = []
    for own, place in lists.places(pairs[:, 0]):
        second = pairs[own, 1]
        keep = (second < 0) | lists.has(second, place + pairs[own, 2])
        own, place = own[keep], place[keep]
        for cut in range(0, len(own), CANDIDATES // 16):
            o, p = own[cut : cut + CANDIDATES // 16], place[cut : cut + CANDIDATES // 16]
            k = np.repeat(first_of[o] - (np.cumsum(n_of[o]) - n_of[o]), n_of[o]) + np.arange(n_of[o].sum())
            w, start = by_pair[k], np.repeat(p, n_of[o])
            start = start - order[w, 0]
            for r in range(2, win.shape[1]):
                off = order[w, r]
                keep = (r >= size[w]) | lists.has(win[w, off], start + off)
                w, start = w[keep], start[keep]
            found.append((w, start))
    w, start = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    stop, fine = start + size[w], start >= 0
    w, start, stop = w[fine], start[fine], stop[fine]
    inside = stop <= lists.starts[lists.doc_of(start) + 1]
    return here[w[inside]], start[inside], stop[inside]


def nearby(lists: Lists, wanted: Wanted, within: int) -> tuple[np.ndarray, ...]:
    """(window, start, stop): places of a window's rarest term that have each other term of it at most ``within`` words away in the same
    document, from the leftmost to the rightmost of the nearest ones (the left one of two as near)."""
    here, order = _rarest_first(lists, wanted)
    if not len(here):
        return (np.zeros(0, np.int64),) * 3
    win, size = wanted.windows[here].astype(np.int64), wanted.lengths[here]
    found = []
    for w, place in lists.places(win[np.arange(len(here)), order[:, 0]]):
        low, high = place.copy(), place.copy()
        for r in range(1, win.shape[1]):
            term = win[w, order[w, r]]
            doc = lists.doc_of(place)
            least, most = lists.starts[doc], lists.starts[doc + 1]
            base = term * lists.span
            k = np.searchsorted(lists.keys, base + place)
            left = lists.keys[np.maximum(k - 1, 0)] - base
            right = lists.keys[np.minimum(k, len(lists.keys) - 1)] - base
            to_left = np.where((left >= least) & (left <= place), place - left, within + 1)
            to_right = np.where((right >= place) & (right < most), right - place, within + 1)
            to, near = np.minimum(to_left, to_right), np.where(to_left <= to_right, left, right)
            past = r >= size[w]
            keep = past | (to <= within)
            low, high = np.where(past, low, np.minimum(low, near))[keep], np.where(past, high, np.maximum(high, near))[keep]
            w, place = w[keep], place[keep]
        found.append((w, low, high + 1))
    w, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    return here[w], low, high


def _searched(wanted: Wanted, within: int | None):
    """A chunk's postings to one row a document, with the spans of each item found in it."""

    def run(chunk: pa.Table) -> pa.Table:
        lists = Lists(chunk, wanted.terms)
        w, start, stop = phrases(lists, wanted) if within is None else nearby(lists, wanted, within)
        doc, item = lists.doc_of(start), wanted.items[w]
        order = np.lexsort((stop, start, item, doc))
        doc, item, start, stop = doc[order], item[order], start[order], stop[order]
        hits: list = [[] for _ in lists.doc_ids]
        last = None
        for d, i, a, b in zip(doc.tolist(), item.tolist(), start.tolist(), stop.tolist(), strict=True):
            origin = int(lists.starts[d])
            if last != (d, i):
                hits[d].append({"item_id": wanted.names[i], "spans": [{"start": a - origin, "stop": b - origin}]})
                last = (d, i)
            elif a - origin <= (span := hits[d][-1]["spans"][-1])["stop"]:
                span["stop"] = max(span["stop"], b - origin)
            else:
                hits[d][-1]["spans"].append({"start": a - origin, "stop": b - origin})
        n = len(lists.doc_ids)
        cols = [pa.repeat(chunk["chunk"][0], n), pa.array(range(n), pa.int64()), pa.array(lists.doc_ids, pa.int64()), pa.array(np.diff(lists.starts), pa.int64()), pa.array(hits, SPANS)]
        return pa.table(cols, names=["chunk", "place", "doc_id", "n_words", "items"])

    return run


class PositionalIndex:
    """The positional postings of a corpus, kept as a table. Each row is a document, whether or not it shares its id; null texts have no words."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> PositionalIndex:
        own = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary"))
        return cls(saved(own.mapInArrow(_postings, INDEX), "positions"))

    def write(self, path: str) -> None:
        self.rows.write.parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> PositionalIndex:
        return cls(spark.read.parquet(path))

    def search(self, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, within: int | None = None) -> DataFrame:
        """(chunk, place, doc_id, n_words, items) of every document, items being those with a window in it and the spans of words they cover.

        The benchmark goes to the tasks in blocks of some megabytes, one pass over the postings of its terms a block; a document's
        rows from several blocks are merged. Items that share an id are one, null ids read as ''; items without words have no window.
        """
        spark = self.rows.sparkSession
        own = items.select(F.col(item_id).cast("string"), F.col(text).cast("binary"))
        total = own.agg(F.coalesce(F.sum(F.length(F.col(text))), F.lit(0))).first()[0]
        blocks = max(1, -(-int(total) // BLOCK_BYTES))
        pieces = saved(own.mapInArrow(_pieces(window, blocks), "block int, item_id string, words string"), "pieces")
        parts = []
        for block in range(blocks):
            wanted = Wanted.of([(r[0], r[1]) for r in pieces.filter(F.col("block") == block).select("item_id", "words").collect()], window)
            terms = spark.createDataFrame([(t,) for t in wanted.terms], "term string")
            of_items = self.rows.join(F.broadcast(terms), "term", "left_semi").unionByName(self.rows.filter("term is null"))
            parts.append(of_items.groupBy("chunk").applyInArrow(_searched(wanted, within), HITS))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if blocks > 1:
            out = out.groupBy("chunk", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"))
        return out


def covered(spans: F.Column) -> F.Column:
    """The number of words that lie in any of the spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(x["start"], s["end"]))).alias("n"), F.greatest(s["end"], x["stop"]).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row a row of ``docs``.

    Null texts and null items have no words; rows that share a doc_id are documents of their own, items that share an item_id are one
    (null: ''); other columns, whatever their names, are left out; an empty table of documents gives no rows, one of items no hits.
    """
    found = PositionalIndex.build(docs).search(items, window=window)
    ids = F.array_sort(F.array_distinct(F.transform("items", lambda x: x["item_id"])))
    hit = covered(F.flatten(F.transform("items", lambda x: x["spans"])))
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
