"""Token ids in binary files: documents in ascending order, ids coded by the adaptive range coder.

A file is a run of chunks, a chunk a run of whole documents. Layout of a chunk, little-endian: ``HEAD``;
the doc_ids (int64) and their null flags (uint8); the number of ids of each document (int64); for each block
its code's size and the CRC-32 of its ids (uint32 each); the codes. Blocks have the same number of ids (the last is
filled up with zeros); ``LANES`` of them share a model that starts empty, and decode together. Chunks travel as rows of a
Parquet table, so any store that Spark writes to will do and the commit protocol covers lost executors.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rangecoder
from .bpe import MEMORY_BYTES, default_path, folded, slices
from .common import saved, table

END_ID = 1
MOST_ID = (1 << 16) - 1
TOO_WIDE = "ids of 65,536 and more need a wider format"
HEAD = struct.Struct("<4sHIQII")  # magic, version, documents, ids, ids a block, blocks
VERSION = 2
#: A chunk is closed at this many ids; with blocks of up to ``MOST_LENGTH`` ids it fills the lanes of the coder.
CHUNK_IDS = 2 << 20
LANES, MOST_LENGTH = 8192, 256
#: Texts are split and looked up in slices of this many bytes.
SLICE_BYTES = 16 << 20
#: Encoded words that a worker remembers, and their ids.
MEMORY_WORDS, MEMORY_IDS = 1_000_000, 8 << 20
PIECE = 1 << 14
#: The letters of the words that are asked for together, and what may stand behind them.
LATIN = "^[\\x00-\u00ff]*$"
SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
#: Stands for the end of a text; no word has a space.
BEHIND = b" "


class _Known:
    """Words and their ids, which lie one after the other in an array. The end of a text and the empty word come first."""

    def __init__(self):
        self.words = pa.array([], pa.large_binary())
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.slices = np.zeros(0, np.int32)  # how many asked for a word
        self.add(pa.array([BEHIND, b""], pa.large_binary()), np.array([END_ID], np.uint32), np.array([1, 0]))

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the words are; -1: unknown."""
        return pc.index_in(words, self.words).fill_null(-1).to_numpy().astype(np.int64)

    def add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places of the new words."""
        old = len(self.words)
        n, used = old + len(words), self.used + len(ids)
        if n > len(self.starts):
            more = np.zeros(max(n - old, len(self.starts)), np.int64)
            self.starts, self.sizes = np.append(self.starts, more), np.append(self.sizes, more)
        if used > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32))
        self.ids[self.used : used] = ids
        self.sizes[old:n] = sizes
        self.starts[old:n] = self.used + np.cumsum(sizes) - sizes
        self.slices = np.append(self.slices, np.zeros(len(words), np.int32))
        self.words, self.used = pa.concat_arrays([self.words, words]), used
        return np.arange(old, n)

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at ``places``, one after the other, and how many each has."""
        sizes = self.sizes[places]
        out = [np.zeros(0, np.uint32)]
        for k in range(0, len(places), PIECE):  # what fits a cache
            own = sizes[k : k + PIECE]
            at = np.repeat(self.starts[places[k : k + PIECE]] - np.cumsum(own) + own, own)
            at += np.arange(len(at))
            out.append(self.ids[at])
        return np.concatenate(out), sizes

    def kept(self) -> _Known:
        """The short words that more than one slice asked for, those of most slices if they are too many."""
        out, most = _Known(), MEMORY_WORDS // 2
        own = 2 + np.flatnonzero((self.slices > 1)[2:] & (pc.binary_length(self.words).to_numpy()[2:] <= MEMORY_BYTES))
        if len(own) > most:
            own = own[self.slices[own] > np.partition(self.slices[own], -most)[-most]]
        out.add(self.words.take(pa.array(own)), *self.of(own))
        return out


class LibraryEncoder:
    """The tokenizers library, asked once for each text without ASCII white space (its rules never reach across).

    Plain words are asked for by the hundred in one text; the library says which word each id is of. Signs behind a plain word are
    a word of their own. Anything else is a text of its own. When the memory is full, words that came again since it was last full stay.
    """

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path or default_path())
        self.lib.no_truncation()
        self.lib.no_padding()
        self._known = _Known()

    def _ask_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        groups = [words[i : i + 100] for i in range(0, len(words), 100)]
        for group, e in zip(groups, self.lib.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(group)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _ask_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _asked(self, at: np.ndarray, words: pa.Array, texts: pa.Array, ask) -> np.ndarray:
        """The places of distinct words; those without one are asked for."""
        new = at < 0
        at[new] = self._known.add(words.filter(pa.array(new)), *ask(texts.filter(pa.array(new)).to_pylist()))
        return at

    def _learn(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words that are all unknown."""
        texts = words.view(pa.large_string())
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            texts = pa.array([w.decode("utf-8", "replace") for w in words.to_pylist()], pa.large_string())
        stems = pc.utf8_rtrim(texts, SIGNS)
        plain = pc.and_(pc.utf8_is_alpha(stems), pc.match_substring_regex(stems, LATIN))
        odd = pc.invert(plain)
        own = odd.to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(stems).to_numpy()
        signed = np.flatnonzero(~own & (pc.binary_length(texts).to_numpy() > sizes))
        whole = words.take(pa.array(signed))
        stem = stems.filter(plain).dictionary_encode()
        sign = pa.array([w[n:] for w, n in zip(whole.to_pylist(), sizes[signed].tolist(), strict=True)], pa.large_binary()).dictionary_encode()
        bare = stem.dictionary.view(pa.large_binary())
        parts = self._known.places(pa.concat_arrays([bare, sign.dictionary]))
        at = np.zeros(len(words), np.int64)
        at[own] = self._known.add(words.filter(odd), *self._ask_texts(texts.filter(odd).to_pylist()))
        at[~own] = self._asked(parts[: len(bare)], bare, stem.dictionary, self._ask_words)[stem.indices.to_numpy()]
        signs = self._asked(parts[len(bare) :], sign.dictionary, sign.dictionary.view(pa.large_string()), self._ask_texts)[sign.indices.to_numpy()]
        ids, sizes = self._known.of(np.stack([at[signed], signs], 1).ravel())
        at[signed] = self._known.add(whole, ids, sizes.reshape(-1, 2).sum(1))
        return at

    def encode(self, texts: list[bytes], ends: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has; if asked with ``END_ID`` behind each text."""
        split = pc.ascii_split_whitespace(pa.array([folded(t) for t in texts], pa.large_binary()).view(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.view(pa.large_binary())
        known = self._known
        at = known.places(words)
        if len(known.words) + np.count_nonzero(at < 0) > MEMORY_WORDS or known.used > MEMORY_IDS or known.words.nbytes > MEMORY_IDS << 3:
            known = self._known = known.kept()
            at = known.places(words)
        new = at < 0
        at[new] = self._learn(words.filter(pa.array(new)))
        known.slices[at] += 1
        # before the first word and behind the last there may be an empty one
        which, last = at[coded.indices.to_numpy()], split.offsets.to_numpy()[1:]
        if ends:
            which = np.insert(which, last, 0)
            last = last + np.arange(1, len(texts) + 1)
        ids, sizes = known.of(which)
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[last], prepend=0)

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        ids, sizes = self.encode(texts)
        return [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]


@lru_cache(1)
def library(path: str | None) -> LibraryEncoder:
    """One a worker, without threads of its own: Spark already has a worker a core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(path)


def pack(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """Documents and their ids to a chunk."""
    ids = np.concatenate([i for _, i in docs]) if docs else np.zeros(0, np.uint32)
    return _packed(np.array([d or 0 for d, _ in docs]), np.array([d is None for d, _ in docs]), np.array([len(i) for _, i in docs]), ids)


def _packed(doc: np.ndarray, null: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    if len(ids) and ids.max() > MOST_ID:
        raise ValueError(TOO_WIDE)
    length = int(min(MOST_LENGTH, max(128, 1 << (max(1, len(ids)) // LANES).bit_length())))
    blocks = -(-len(ids) // length)
    grid = np.zeros((blocks, length), "<u2")
    grid.ravel()[: len(ids)] = ids
    codes = [c for at in range(0, blocks, LANES) for c in rangecoder.encode(grid[at : at + LANES])]
    sums = [zlib.crc32(row) for row in grid]
    parts = [
        HEAD.pack(b"TARN", VERSION, len(doc), len(ids), length, blocks),
        doc.astype("<i8").tobytes(),
        null.astype(np.uint8).tobytes(),
        sizes.astype("<i8").tobytes(),
        np.array([(len(c), s) for c, s in zip(codes, sums, strict=True)], "<u4").tobytes(),
    ]
    return b"".join(parts + codes)


def unpack(chunk: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """A chunk to its documents and their ids; a block whose checksum differs raises."""
    doc, null, sizes, ids = _unpacked(chunk)
    for d, z, end, size in zip(doc.tolist(), null.tolist(), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
        yield (None if z else d), ids[end - size : end]


def _unpacked(chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    magic, version, n_docs, n_ids, length, blocks = HEAD.unpack_from(chunk)
    if (magic, version) != (b"TARN", VERSION):
        raise ValueError("not a token chunk of this version")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(chunk, kind, n, at)
        at += out.nbytes
        return out

    doc, null, sizes = take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs)
    index = take("<u4", 2 * blocks).reshape(-1, 2)
    ends = at + np.cumsum(index[:, 0].astype(np.int64))
    grid = np.zeros((blocks, length), "<u2")
    for b in range(0, blocks, LANES):
        codes = [chunk[int(e) - int(s) : int(e)] for e, s in zip(ends[b : b + LANES], index[b : b + LANES, 0], strict=True)]
        grid[b : b + LANES] = rangecoder.decode(codes, length)
    for row, want in zip(grid, index[:, 1].tolist(), strict=True):
        if zlib.crc32(row) != want:
            raise ValueError("checksum of a block differs")
    return doc, null, sizes, grid.ravel()[:n_ids]


def write_tokens(docs: DataFrame, path: str | None = None, name: str = "tokens") -> DataFrame:
    """Encodes ``docs`` and writes the files; returns their rows (file, chunk, n_ids, data).

    Documents are range-partitioned by doc_id and sorted inside, nulls first; a file is one range. Rows that share an
    id follow the hash of their text, so many of them can be in several files and ``start`` is the same on every run. Null and empty
    texts have the end id alone. Repeated rows are written again, other columns don't matter, an empty table makes no files.
    A tokenizer with ids of 65,536 and more raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(path)
        file, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal held, n, number
            data = _packed(*map(np.concatenate, zip(*held, strict=True)))
            out = pa.record_batch([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["file", "chunk", "n_ids", "data"])
            held, n, number = [], 0, number + 1
            return out

        for batch in batches:
            for start, texts in slices(batch.column(1), SLICE_BYTES):
                doc = batch.column(0).slice(start, len(texts))
                ids, sizes = lib.encode(texts, ends=True)
                if ids.max() > MOST_ID:
                    raise ValueError(TOO_WIDE)
                doc, null, ids = doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), ids.astype(np.uint16)
                ends = np.cumsum(sizes)
                row, at = 0, 0
                while row < len(sizes):
                    # whole documents, until the chunk has enough
                    last = min(int(np.searchsorted(ends, at + CHUNK_IDS - n)), len(sizes) - 1)
                    end = int(ends[last])
                    held.append((doc[row : last + 1], null[row : last + 1], sizes[row : last + 1], ids[at:end]))
                    n += end - at
                    row, at = last + 1, end
                    if n >= CHUNK_IDS:
                        yield close()
        if held:
            yield close()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = own.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(ordered.mapInArrow(run, "file long, chunk long, n_ids long, data binary"), name, "uncompressed")


def read_tokens(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32, and ids if asked for."""
    # running sums inside each file, then over one row a file
    inner = W.partitionBy("file").orderBy("chunk")
    sizes = files.select("file", "chunk", "n_ids").withColumn("_in", F.sum("n_ids").over(inner) - F.col("n_ids"))
    whole = files.groupBy("file").agg(F.sum("n_ids").alias("_ids"))
    whole = whole.select("file", (F.sum("_ids").over(W.orderBy("file")) - F.col("_ids")).alias("_before"))
    starts = sizes.join(whole, "file").select("file", "chunk", (F.col("_in") + F.col("_before")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc, null, sizes, ids = _unpacked(data.as_py())
                wide = memoryview(ids.astype("<u4")).cast("B")
                ends = np.cumsum(sizes)
                parts = [wide[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                cols = [pa.array(doc, mask=null.astype(bool)), pa.array(start + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    cols.append(pa.array(map(bytes, parts), pa.binary()))
                yield pa.record_batch(cols, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return files.join(starts, ["file", "chunk"]).select("start", "data").mapInArrow(run, schema)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")), with_ids=False)
