"""Source divergence audit: how far the sources of a language use its terms differently.

Tasks count the terms of their documents by (lang, source), a bounded number of entries at a time, so that a term has one entry for each
source and chunk of documents however often it occurs. Entries travel packed by a hash of their term: they are repartitioned by that bucket,
rows come sorted by (bucket, lang, chunk), and a bucket's entries are sorted on by (term, source), chunks staying in order. A scan over the
runs yields document frequencies and counts, and keeps the terms that enough documents have. Kept terms then meet the totals of their
language's groups in slices, each of which emits partial sums for the pairs of sources and its own best terms of each source.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_table, saved, table

MIN_DOCS = 30
TERMS = 50
SMOOTHING = 5
SCALE = 1_000_000_000
#: Entries (lang, source, term) that a task counts before it sends them on.
ENTRIES = 400_000
#: Bytes of a text that are split into terms at once.
SLICE = 1 << 22
#: Terms times sources of a language that a slice should have, and the least number of slices a language.
CELLS = 1 << 22
LEAST_SLICES = 64

#: Letters and everything beyond ASCII make terms; A-Z are folded.
FOLD = ascii_table(b"abcdefghijklmnopqrstuvwxyz")

#: Text whose terms make a bucket, and the least number of buckets: a scan holds the entries of one bucket and language at a time, one for some 20 bytes of text.
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 512

PACKED = "bucket long, lang string, chunk long, terms string, names array<string>, sources binary, docs binary, counts binary"
KEPT = "lang string, term string, docs long, sources array<string>, counts array<long>"
PARTS = "lang string, source string, part string, item string, value long"


def _counted(buckets: int):
    """(lang, source, text) to the packed counts of chunks of documents: a row for each bucket and language, terms joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        docs: dict = defaultdict(Counter)
        counts: dict = defaultdict(Counter)
        held = 0

        def packed(lang: str) -> Iterator[tuple]:
            names = [s for la, s in docs if la == lang]
            terms = [t for s in names for t in docs[lang, s]]
            source = np.repeat(np.arange(len(names), dtype=np.int32), [len(docs[lang, s]) for s in names])
            n_docs = np.array([n for s in names for n in docs[lang, s].values()], np.int64)
            n = np.array([counts[lang, s][t] for s in names for t in docs[lang, s]], np.int64)
            bucket = np.fromiter(map(crc32, terms), np.uint32, len(terms)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
                used, own = np.unique(source[at], return_inverse=True)
                yield int(bucket[at[0]]), lang, chunk, b" ".join([terms[i] for i in at.tolist()]), [names[i] for i in used], own.astype(np.int32).tobytes(), n_docs[at].tobytes(), n[at].tobytes()

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in {la for la, _ in docs}:
                cols = list(zip(*packed(lang), strict=True)) or [[]] * 8
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                arrays[3] = arrays[3].cast(pa.string())
                yield pa.record_batch(arrays, ["bucket", "lang", "chunk", "terms", "names", "sources", "docs", "counts"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                folded = (text.as_py() or b"").translate(FOLD)
                own, all_, at, seen = docs[lang, source], counts[lang, source], 0, set()
                before = len(own)
                while at < len(folded):
                    end = folded.find(b" ", at + SLICE) if at + SLICE < len(folded) else -1
                    end = len(folded) if end < 0 else end
                    terms = folded[at:end].split()
                    all_.update(terms)
                    seen.update(terms)
                    at = end
                own.update(seen)
                held += len(own) - before
                if held >= ENTRIES:
                    yield from flush()
                    docs.clear()
                    counts.clear()
                    held, chunk = 0, chunk + 1
        yield from flush()

    return run


def _runs(rows: list[dict], least: int) -> pa.RecordBatch:
    """The entries of one bucket and language, in order of their chunks: sorted by (term, source), summed run by run, terms of enough documents kept."""
    terms = pa.array([t for r in rows for t in r["terms"].split(" ")])
    names = pa.array([r["names"][i] for r in rows for i in np.frombuffer(r["sources"], np.int32).tolist()])
    docs, n = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("docs", "counts"))
    entries = pa.table([terms, names], names=["term", "source"])
    order = pc.sort_indices(entries, [("term", "ascending"), ("source", "ascending")])
    entries, docs, n = entries.take(order).combine_chunks(), docs[order], n[order]
    first, run = np.ones(len(docs), bool), np.ones(len(docs), bool)
    for name, starts in (("term", first), ("source", run)):
        col = entries[name].combine_chunks()
        starts[1:] = pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(first | run)
    by_term = np.flatnonzero(first)
    df = np.add.reduceat(docs, by_term)
    sums = np.add.reduceat(n, at)
    edges = np.append(np.searchsorted(at, by_term), len(at))
    kept = np.flatnonzero(df >= least)
    take = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in kept]) if len(kept) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(edges[kept + 1] - edges[kept])]), pa.int32())
    cols = [
        pa.repeat(pa.scalar(rows[0]["lang"], pa.string()), len(kept)), entries["term"].combine_chunks().take(pa.array(by_term[kept])), pa.array(df[kept]),
        pa.ListArray.from_arrays(offsets, entries["source"].combine_chunks().take(pa.array(at[take]))), pa.ListArray.from_arrays(offsets, pa.array(sums[take])),
    ]
    return pa.record_batch(cols, ["lang", "term", "docs", "sources", "counts"])


def _scanned(least: int):
    """Packed rows sorted by (bucket, lang, chunk) to one row a term that at least ``least`` documents have. One bucket of a language is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["bucket"], row["lang"]) != (held[0]["bucket"], held[0]["lang"]):
                    yield _runs(held, least)
                    held = []
                held.append(row)
        if held:
            yield _runs(held, least)

    return run


def share(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), three digits at a time, so that nothing goes beyond 64 bits."""
    below = total + SMOOTHING * terms
    if below.max(initial=0) >= 1 << 53:
        raise OverflowError("more than 2^53 terms")
    rest, out = count + SMOOTHING, 0
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digits
    return 1 + out


def _compared(terms: int):
    """A slice of a language's terms and the totals of its groups to partial sums of the pairs and the first terms of each source."""

    def run(key: tuple, slice_: pa.Table, groups: pa.Table) -> pa.Table:
        if not slice_.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(("lang", "source", "part", "item", "value"), (pa.string(),) * 4 + (pa.int64(),), strict=True)})
        lang, names = key[0].as_py(), groups["source"].to_pylist()
        totals, kept = groups["total"].to_numpy(), int(groups["kept"][0].as_py())
        place = {s: i for i, s in enumerate(names)}
        lists = slice_["sources"].combine_chunks()
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        col = np.array([place[s] for s in lists.flatten().to_pylist()], np.int64)
        counts = np.zeros((len(lists), len(names)), np.int64)
        counts[row, col] = slice_["counts"].combine_chunks().flatten().to_numpy()
        p = share(counts, totals[None, :], kept)
        q = share(counts.sum(1), totals.sum(), kept)
        out: list = []
        for i, name in enumerate(names):
            sums = np.abs(p[:, i + 1 :] - p[:, i : i + 1]).sum(0).tolist()
            for j, value in enumerate(sums, i + 1):
                out += [(lang, name, "pair", names[j], value), (lang, names[j], "pair", name, value)]
        words = np.array([t.encode() for t in slice_["term"].to_pylist()], object)
        for i, name in enumerate(names):
            more = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
            gain = p[more, i] - q[more]
            if len(more) > terms:
                enough = gain >= np.partition(gain, len(gain) - terms)[len(gain) - terms]
                more, gain = more[enough], gain[enough]
            best = sorted(zip((-gain).tolist(), words[more], strict=True))[:terms]
            out += [(lang, name, "term", t.decode(), -v) for v, t in best]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["lang", "source", "part", "item", "value"])

    return run


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, docs, sources, counts): the terms of each language that at least ``min_docs`` of its documents have, with the count in each source that has any."""
    own = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("binary").alias("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    counted = own.mapInArrow(_counted(max(LEAST_BUCKETS, -(-int(total) // BUCKET_BYTES))), PACKED)
    ordered = counted.repartition("bucket").sortWithinPartitions("bucket", "lang", "chunk")
    return ordered.mapInArrow(_scanned(min_docs), KEPT)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: distances between the sources of a language, and the terms a source has more of than its language.

    Each row is a document, also where rows share an id; null texts, languages and sources read as ''; other columns are left out; an empty
    table gives no rows. A language without kept terms has pairs of value 0, one of a single source no pairs.
    """
    kept = saved(kept_terms(docs, min_docs), "terms")
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    used = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = saved(groups.join(used, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")), "groups")
    most = totals.groupBy("lang").agg((F.count(F.lit(1)) * F.max("kept")).alias("cells")).agg(F.coalesce(F.max("cells"), F.lit(0))).first()[0]
    slices = max(LEAST_SLICES, -(-int(most) // CELLS))
    left = kept.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)))
    right = totals.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    parts = saved(left.groupBy("lang", "slice").cogroup(right.groupBy("lang", "slice")).applyInArrow(_compared(terms), PARTS), "parts")
    by_value = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    sums = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    none = totals.filter("kept = 0").select("lang", "source")
    apart = none.join(none.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = sums.unionByName(apart).withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    best = parts.filter("part = 'term'").drop("part").withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= terms).withColumn("part", F.lit("term"))
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
