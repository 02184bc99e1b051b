"""Katz backoff language model of any order: Good-Turing discounted n-gram counts, exactly normalised backoff weights.

Texts are packed into chunks. A chunk's distinct n-grams of every level (words, pairs, ... up to the order) go, sorted and packed, to the
bucket of their 64-bit hash; there the training counts of all chunks are added up and each chunk gets the totals of what it asked for, so
one exchange both counts and looks up. An n-gram that is everywhere is still one entry a chunk. Then, from pairs up, a round a level: with
the totals and the weights of the levels below a chunk knows the probability of each of its shorter n-grams, and sends its share of every
context's discounted mass and of the mass below, each n-gram counted in one chunk only, to the context's bucket. That bucket has the
context's weight and answers with it; at the top level it adds it to the documents that backed off.

P(w | v u) = d(c) c(v u w) / c(v u) for an n-gram that was seen, else weight(v u) P(w | u), and so on down to words; weight 1 after an
unseen context. P(w) = d(c) c(w) / N, the mass left by the discounts is that of any unseen word. A text's first words follow start
marks, an end mark follows its last.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import saved, table
from .superkmers import SLICE_BYTES, Words

CHUNK_BYTES = 12 << 20
BUCKET_BYTES = 4 << 20
MIN_BUCKETS = 64
#: Counts up to K are discounted by Good-Turing; larger ones by REST of a count, so that every context keeps some mass to back off with.
K = 5
REST = 1e-3
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
MODEL = -1  # the chunk number of a stored model's own rows

#: Words in an n-gram, unless told otherwise: triples need twice the disk that the registered query may use (figures in the README).
ORDER = 2

TABLE = "bucket long, chunk long, keys array<binary>, counts array<binary>, owns array<binary>, hist array<long>"
CONTEXTS = "bucket long, chunk long, words binary, a binary, b binary, asks binary"


def _small(x: np.ndarray) -> bytes:
    """Numbers, byte planes apart, compressed."""
    x = np.ascontiguousarray(x)
    head = struct.pack("<2sQ", x.dtype.str[1:].encode(), len(x))
    return head + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())


def _large(blob: bytes) -> np.ndarray:
    kind, n = struct.unpack_from("<2sQ", blob)
    dtype = np.dtype("<" + kind.decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[10:], max_output_size=n * dtype.itemsize + 1), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).ravel()


def _sorted_small(keys: np.ndarray) -> bytes:
    return _small(np.diff(keys, prepend=np.uint64(0)))


def _sorted_large(blob: bytes) -> np.ndarray:
    return np.cumsum(_large(blob), dtype=np.uint64)


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket of sorted keys begins; buckets are the keys' first bits."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, edges), len(keys))


def pack_chunks(docs: DataFrame, train: Column) -> DataFrame:
    """Rows (chunk, size, data): some documents with their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 24, 0
        ids: list[Any] = []
        flags: list[bool] = []
        texts: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal n, size
            head = struct.pack("<Q", len(ids)) + np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([(i is None) * 2 + f for i, f in zip(ids, flags, strict=True)], np.uint8).tobytes()
            raw = head + np.array([len(t) for t in texts], "<i8").tobytes() + b"".join(texts)
            out = pa.record_batch([pa.array([base + n], pa.int64()), pa.array([size], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(raw)], pa.binary())], ["chunk", "size", "data"])
            n, size = n + 1, 0
            for x in (ids, flags, texts):
                x.clear()
            return out

        for batch in batches:
            for at, part in slices(batch.column(2), SLICE_BYTES):
                ids += batch.column(0).slice(at, len(part)).to_pylist()
                flags += batch.column(1).slice(at, len(part)).to_pylist()
                texts += part
                size += sum(map(len, part))
                if size >= CHUNK_BYTES:
                    yield close()
        if ids:
            yield close()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), F.col("text").cast("binary").alias("text"))
    return saved(own.mapInArrow(run, "chunk long, size long, data binary"), "katz-chunks", "uncompressed")


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams from the keys of their first words and of their last."""
    h = context * np.uint64(0x9E3779B97F4A7C15) + word
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _start_key(n: int) -> np.uint64:
    """The key of n start marks."""
    key = np.array([START])
    for _ in range(n - 1):
        key = _mixed(key, np.array([START]))
    return key[0]


@dataclass
class Level:
    """A chunk's distinct n-grams, sorted by key; ``context`` and ``lower`` (their first and their last words) are places in the level below."""

    keys: np.ndarray
    of: np.ndarray
    context: np.ndarray
    lower: np.ndarray
    start: int  # the place of the n-gram of start marks, which is a context only; -1 at the top


@dataclass
class Chunk:
    """The tokens of a chunk and its n-grams by level, words first."""

    ids: np.ndarray
    null: np.ndarray
    train: np.ndarray
    n_tokens: np.ndarray
    levels: list[Level]

    @classmethod
    def read(cls, data: bytes, order: int, top: int) -> Chunk:
        """A chunk with its levels up to ``top`` of a model of ``order``."""
        raw = zstandard.ZstdDecompressor().decompress(data)
        (n,) = struct.unpack_from("<Q", raw)
        ids = np.frombuffer(raw, "<i8", n, 8)
        flags = np.frombuffer(raw, np.uint8, n, 8 + 8 * n)
        ends = 8 + 17 * n + np.cumsum(np.frombuffer(raw, "<i8", n, 8 + 9 * n))
        starts = np.append(8 + 17 * n, ends[:-1])
        tokens, counts = [], []
        at = 0
        while at < n:
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES)))
            norm = [b" ".join(raw[s:e].lower().split()) for s, e in zip(starts[at:stop].tolist(), ends[at:stop].tolist(), strict=True)]
            own = np.array([t.count(b" ") + 1 if t else 0 for t in norm], np.int64)
            out = np.full(int(own.sum()) + len(own), END, np.uint64)
            if own.sum():
                here = np.ones(len(out), bool)
                here[np.cumsum(own + 1) - 1] = False
                out[here] = Words(b" ".join([t for t in norm if t])).hash
            tokens.append(out)
            counts.append(own + 1)
            at = stop
        tok = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        words, back = np.unique(np.append(tok, START), return_inverse=True)
        none = np.zeros(0, np.int64)
        levels = [Level(words, back[:-1], none, none, int(back[-1]))]
        first = np.cumsum(size) - size
        for level in range(2, top + 1):
            levels.append(cls._longer(levels[0], levels[-1], first, level < order))
        return cls(ids, (flags & 2) > 0, (flags & 1) > 0, size, levels)

    @staticmethod
    def _longer(words: Level, below: Level, first: np.ndarray, mark: bool) -> Level:
        """The level above ``below``, with the n-gram of start marks if that is a context of another level."""
        context_of = np.append(below.start, below.of[:-1])[: len(below.of)]
        context_of[first] = below.start
        word_of, lower_of = words.of, below.of
        if mark:
            context_of, word_of, lower_of = np.append(context_of, below.start), np.append(word_of, words.start), np.append(lower_of, below.start)
        code, of = np.unique(context_of * len(words.keys) + word_of, return_inverse=True)
        context, word = code // len(words.keys), code % len(words.keys)
        h = _mixed(below.keys[context], words.keys[word])
        order = np.argsort(h)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of = place[of]
        lower = np.empty(len(order), np.int64)
        lower[of] = lower_of
        return Level(h[order], of[: len(below.of)], context[order], lower, int(of[-1]) if mark else -1)

    def messages(self, chunk: int, bits: int) -> list[tuple]:
        """The chunk's n-grams with their training counts here, a row for each bucket that gets any."""
        on = np.repeat(self.train, self.n_tokens)
        counts = [np.bincount(x.of, on, len(x.keys)).astype(np.uint32) for x in self.levels]
        for x, n in zip(self.levels, counts, strict=True):
            if x.start >= 0:
                n[x.start] = int(self.train.sum())
        cuts = [_cuts(x.keys, bits) for x in self.levels]
        rows = []
        for b in range(1 << bits):
            parts = [slice(c[b], c[b + 1]) for c in cuts]
            if any(c[b] < c[b + 1] for c in cuts):
                rows.append((b, chunk, [_sorted_small(x.keys[p]) for x, p in zip(self.levels, parts, strict=True)], [_small(n[p]) for n, p in zip(counts, parts, strict=True)], None, None))
        return rows


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """All distinct keys, their totals, and for each list its totals and whether it is the first that counts the key."""
    flat, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    every, back = np.unique(flat, return_inverse=True)
    total = np.bincount(back, n, len(every)).astype(np.int64)
    first = np.full(len(every), len(flat))
    on = np.flatnonzero(n > 0)
    np.minimum.at(first, back[on], on)
    owner = np.zeros(len(flat), bool)
    owner[first[first < len(flat)]] = True
    ends = np.cumsum([len(k) for k in keys])[:-1]
    return every, total, np.split(total[back], ends), np.split(owner, ends)


def _counted(order: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One bucket: the totals for each chunk, and the table's own row (chunk MODEL) with its counts of counts."""
        pdf = pdf.sort_values("chunk")
        known = bool((pdf["chunk"] == MODEL).any())
        bucket = int(pdf["bucket"].iloc[0])
        levels = [_totals([_sorted_large(x[n]) for x in pdf["keys"]], [_large(x[n]) for x in pdf["counts"]]) for n in range(order)]
        rows: list[tuple] = []
        for i, chunk in enumerate(pdf["chunk"]):
            if chunk != MODEL:
                rows.append((bucket, chunk, None, [_small(x[2][i].astype(np.uint32)) for x in levels], [_small(np.packbits(x[3][i] & ~np.bool_(known))) for x in levels[1:]], None))
        real = [x[1][x[0] != _start_key(n)] for n, x in enumerate(levels, 1)]
        hist = [h for c in real for h in np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2].tolist()]
        hist += [int(real[0].sum()), int((real[0] > 0).sum())]
        kept = [(x[0][x[1] > 0], x[1][x[1] > 0]) for x in levels]
        rows.append((bucket, MODEL, [_sorted_small(k) for k, _ in kept], [_small(c.astype(np.uint32)) for _, c in kept], None, hist))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "counts", "owns", "hist"])

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Katz's ratios for counts 0..K from the numbers of types seen 1..K+1 times; where these don't give one inside (0, 1), half a count is taken off."""
    d = np.array([1.0] + [1 - 0.5 / r for r in range(1, K + 1)])
    if n[0] and all(n):
        tail = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            x = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) if tail != 1 else 0
            if 0 < x < 1:
                d[r] = x
    return d


@dataclass(frozen=True)
class Constants:
    """What training leaves besides the tables: N, V, the discounts, and the mass of an unseen word."""

    tokens: int
    types: int
    word_d: np.ndarray
    gram_d: tuple[np.ndarray, ...]  # of pairs, triples, ...
    scale: float
    unseen: float

    @classmethod
    def of(cls, hist: list[int]) -> Constants:
        *levels, (n, v) = [hist[at : at + K + 1] for at in range(0, len(hist), K + 1)]
        w = levels[0]
        dw, *dg = map(discounts, levels)
        small = sum(r * w[r - 1] for r in range(1, K + 1))
        rest = v - sum(w[:K])
        left = (sum(w[r - 1] * r * (1 - dw[r]) for r in range(1, K + 1)) + REST * rest) / n if n else 1.0
        unseen = max(left, 1 / (n + 1))
        assert small <= n or not n
        return cls(n, v, dw, tuple(dg), (1 - unseen) / (1 - left) if left < 1 else 0.0, unseen)

    @staticmethod
    def kept(c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        c = c.astype(np.float64)
        return np.where(c <= K, c * d[np.minimum(c, K).astype(np.int64)], c - REST)

    def word_p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.kept(c, self.word_d) * self.scale / max(1, self.tokens), self.unseen)


def _scored(const: Constants, bits: int, level: int, order: int):
    """A chunk and its totals to what the buckets of its contexts at ``level`` must hear and, at the last one, what is known of its documents."""

    last = level == order

    def run(key, chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        rows = []
        if len(chunks):
            c = Chunk.read(chunks["data"].iloc[0], order, level)
            answers = answers.sort_values(["level", "bucket"])
            told = answers[answers["level"] == 0]
            counts = [np.concatenate([_large(x[n]) for x in told["counts"]]).astype(np.int64) for n in range(level)]
            w = counts[0]
            p = const.word_p(w)
            p[c.levels[0].start] = 1
            for m in range(2, level):
                x, n = c.levels[m - 1], counts[m - 1]
                weight = np.ones(len(counts[m - 2]))
                weight[_contexts(x, counts[m - 2])] = np.concatenate([_large(b) for b in answers[answers["level"] == m]["weights"]] or [np.zeros(0)])
                p = np.where(n > 0, const.kept(n, const.gram_d[m - 2]) / np.maximum(1, counts[m - 2][x.context]), weight[x.context] * p[x.lower])
                p[x.start] = 1
            x, n, d = c.levels[level - 1], counts[level - 1], const.gram_d[level - 2]
            below, ctx = c.levels[level - 2].keys, counts[level - 2]
            own = np.concatenate([np.unpackbits(_large(b))[: len(_large(q[level - 1]))] for b, q in zip(told["owns"], told["counts"], strict=True)]).astype(bool)
            seen = n > 0
            used = own & seen
            if x.start >= 0:
                used[x.start] = False
            a = np.bincount(x.context[used], (n - const.kept(n, d))[used], len(below))
            b = np.bincount(x.context[used], p[x.lower][used], len(below))
            if last:
                log_p = np.log10(np.where(seen, const.kept(n, d) / np.maximum(1, ctx[x.context]), p[x.lower]))
                first = np.cumsum(c.n_tokens) - c.n_tokens
                base = np.log10((w + 0.5) / (const.tokens + 0.5 * (const.types + 1)))
                by_doc = lambda v: np.add.reduceat(v, first)
                word_of = c.levels[0].of
                docs = [_small(c.ids), _small(c.null.view(np.uint8)), _small(c.train.view(np.uint8)), _small(c.n_tokens), _small(by_doc((w > 0)[word_of].astype(np.int64))), _small(by_doc(base[word_of])), _small(by_doc(log_p[x.of]))]
                rows.append((-1 - number, number, b"".join(struct.pack("<Q", len(v)) + v for v in docs), None, None, None))
                asked = (~seen & (ctx[x.context] > 0))[x.of]
                doc, context_of = np.repeat(np.arange(len(c.ids)), c.n_tokens)[asked], x.context[x.of][asked]
                need = np.zeros(len(below), bool)
                need[x.context[used]] = True
                need[context_of] = True
                idx = np.flatnonzero(need)
                ask, times = np.unique(context_of * len(c.ids) + doc, return_counts=True)
                ask_ctx, ask_doc = ask // len(c.ids), ask % len(c.ids)
            else:
                idx = _contexts(x, ctx)
                ask_ctx = ask_doc = times = np.zeros(0, np.int64)
            rank = np.zeros(len(below), np.int64)
            rank[idx] = np.arange(len(idx))
            cut = _cuts(below[idx], bits)
            ask_cut = np.searchsorted(rank[ask_ctx], cut)
            for k in range(1 << bits):
                i, j, s, e = int(cut[k]), int(cut[k + 1]), int(ask_cut[k]), int(ask_cut[k + 1])
                if i == j:
                    continue
                own_n = _small(ctx[idx[i:j]].astype(np.uint32))
                asks = np.stack([rank[ask_ctx[s:e]] - i, ask_doc[s:e], times[s:e]], 1).astype(np.uint32).ravel()
                rows.append((k, number, _sorted_small(below[idx[i:j]]), _small(a[idx[i:j]]), _small(b[idx[i:j]]), struct.pack("<Q", len(own_n)) + own_n + _small(asks)))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "words", "a", "b", "asks"])

    return run


def _contexts(level: Level, counts: np.ndarray) -> np.ndarray:
    """Places of the contexts that training has seen."""
    need = np.zeros(len(counts), bool)
    need[level.context] = True
    return np.flatnonzero(need & (counts > 0))


def _weighed(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One bucket of contexts: for each chunk their weights or, at the top, the logarithms its documents are still to get."""
        if pdf["bucket"].iloc[0] < 0:
            return pdf
        pdf = pdf.sort_values("chunk")
        bucket = int(pdf["bucket"].iloc[0])
        keys = [_sorted_large(x) for x in pdf["words"]]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        a = np.bincount(back, np.concatenate([_large(x) for x in pdf["a"]]), len(every))
        b = np.bincount(back, np.concatenate([_large(x) for x in pdf["b"]]), len(every))
        rows, at, counts = [], 0, np.zeros(len(every), np.int64)
        todo = []
        for chunk, k, blob in zip(pdf["chunk"], keys, pdf["asks"], strict=True):
            own = back[at : at + len(k)]
            at += len(k)
            (n,) = struct.unpack_from("<Q", blob)
            counts[own] = np.maximum(counts[own], _large(blob[8 : 8 + n]))
            todo.append((chunk, own, _large(blob[8 + n :]).reshape(-1, 3).astype(np.int64)))
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where((counts > 0) & (a > 0), a / np.maximum(1, counts) / (1 - b), 1.0)
        log_weight = np.log10(weight)
        for chunk, own, asks in todo:
            if not last and chunk != MODEL:
                rows.append((bucket, chunk, None, _small(weight[own]), None, None))
            elif len(asks):
                doc, back_doc = np.unique(asks[:, 1], return_inverse=True)
                rows.append((bucket, chunk, _small(doc.astype(np.uint32)), _small(np.bincount(back_doc, log_weight[own[asks[:, 0]]] * asks[:, 2], len(doc))), None, None))
        empty = _small(np.zeros(0, np.uint32))
        w_blob = _small(counts.astype(np.uint32))
        rows.append((bucket, MODEL, _sorted_small(every), _small(a), _small(b), struct.pack("<Q", len(w_blob)) + w_blob + empty))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "words", "a", "b", "asks"])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _summed(tokens: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        blob = pdf["words"].iloc[0]  # the chunk's own row comes first
        parts, at = [], 0
        while at < len(blob):
            (n,) = struct.unpack_from("<Q", blob, at)
            parts.append(_large(blob[at + 8 : at + 8 + n]))
            at += 8 + n
        ids, null, train, size, known, base, score = parts
        score = score.copy()
        for doc, more in zip(pdf["words"].iloc[1:], pdf["a"].iloc[1:], strict=True):
            score[_large(doc)] += _large(more)
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": train == 0, "n_tokens": size, "n_known": known, "train_tokens": tokens, "base_score": base, "score": score})
        out.loc[null > 0, "doc_id"] = pd.NA
        return out

    return run


@dataclass(frozen=True)
class KatzModel:
    """A trained model: ``counts`` (n-grams of all levels by bucket), ``contexts`` (backoff masses by bucket, a table a level from pairs up) and the constants."""

    counts: DataFrame
    contexts: tuple[DataFrame, ...]
    constants: Constants
    bits: int
    order: int

    @classmethod
    def fit_and_score(cls, docs: DataFrame, train: Column, order: int = ORDER) -> tuple[KatzModel, DataFrame]:
        """Learns n-grams up to ``order`` words (2 or more) from the rows of ``docs`` where ``train`` holds and scores all of them (see ``op9_katz`` for the columns).

        Null and blank texts are their end mark alone; a null doc_id stays null; repeated rows are counted and
        scored each; without any training text every word is unseen; other columns don't matter; an empty table gives an empty result.
        """
        if order < 2:
            raise ValueError("an order of 2 or more")
        return _run(docs, train, None, order)

    def score(self, docs: DataFrame) -> DataFrame:
        """Scores other documents; every row counts as held out."""
        return _run(docs, F.lit(False), self, self.order)[1]


def _run(docs: DataFrame, train: Column, model: KatzModel | None, order: int) -> tuple[KatzModel, DataFrame]:
    chunks = pack_chunks(docs, train)
    if model is None:
        size = chunks.agg(F.sum("size").alias("n")).first()["n"] or 0
        bits = max(MIN_BUCKETS, size // BUCKET_BYTES).bit_length() - 1
    else:
        bits = model.bits

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = pa.list_(pa.binary())
        kinds = [pa.int64(), pa.int64(), blobs, blobs, blobs, pa.list_(pa.int64())]
        names = ["bucket", "chunk", "keys", "counts", "owns", "hist"]
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = Chunk.read(data.as_py(), order, order).messages(number, bits)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    own = chunks.select("chunk", "data")
    asked = own.mapInArrow(ask, TABLE)
    if model is not None:
        asked = asked.unionByName(model.counts)
    answers = saved(asked.groupBy("bucket").applyInPandas(_counted(order), TABLE), "katz-counts", "uncompressed")
    table_rows = answers.filter(F.col("chunk") == MODEL)
    if model is None:
        n = order * (K + 1) + 2
        sums = table_rows.agg(*[F.sum(F.col("hist")[i]).alias(f"h{i}") for i in range(n)]).first()
        const = Constants.of([int(sums[i] or 0) for i in range(n)])
    else:
        const = model.constants
    contexts, replies = [], []
    for level in range(2, order + 1):
        last = level == order
        told = answers.filter(F.col("chunk") != MODEL).select("chunk", "bucket", F.lit(0).alias("level"), F.slice("counts", 1, level).alias("counts"), F.col("owns")[level - 2].alias("owns"), F.lit(None).cast("binary").alias("weights"))
        for reply in replies:
            told = told.unionByName(reply)
        heard = own.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_scored(const, bits, level, order), CONTEXTS)
        if model is not None:
            heard = heard.unionByName(model.contexts[level - 2])
        weighed = saved(heard.groupBy("bucket").applyInPandas(_weighed(last), CONTEXTS), "katz-contexts", "uncompressed")
        contexts.append(weighed.filter(F.col("chunk") == MODEL))
        back = weighed.filter(F.col("chunk") != MODEL)
        replies.append(back.select("chunk", "bucket", F.lit(level).alias("level"), F.lit(None).cast("array<binary>").alias("counts"), F.lit(None).cast("binary").alias("owns"), F.col("a").alias("weights")))
    scores = back.groupBy("chunk").applyInPandas(_summed(const.tokens), SCORES)
    return KatzModel(table_rows, tuple(contexts), const, bits, order), scores


def op9_katz(spark, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 1
    return KatzModel.fit_and_score(table(spark, sf_dir, "documents"), ~held_out)[1]
