"""BM25 with pruned lists.

A term's list is cut where its documents were counted: each chunk of documents has its own piece, so no task meets a whole list
however frequent the term. A piece is ordered by weight and cut into blocks, each with its largest weight. Beside the blocks every
document has one row with its terms and weights. The best ``k`` of a query are found in four steps, all of them joins and sums:

1. The first blocks of the query's rarest terms name documents; the exact scores of the best of them give a threshold.
2. Terms whose largest weights together stay below the threshold can't lift a document over it: those with the longest lists
   are left out. Of the others' lists only blocks are read that can reach the threshold with all other terms at their best.
3. Documents whose sum so far and the left-out terms' bounds reach the threshold are candidates.
4. The rest of the candidates' scores comes from their own rows.

Whatever is left out lies strictly below the k-th score, so the result is that of scoring everything.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.sources.lineage import written

from . import lexical
from .lexical import K1, B, best

#: Postings of a block, and those a task orders at once.
BLOCK = 128
CHUNK = 1 << 20
#: Counted terms that a task holds as Python objects.
COUNTED = 1 << 16
#: The first pass reads terms until their lists have so many times k postings, and scores so many times k documents exactly.
SEED_POSTINGS = 20
SEEDS = 8
#: The part of the threshold that left-out terms may reach together: more reads less and leaves more candidates.
LEFT_OUT = 0.8
ROWS = 1 << 14

FORWARD = "seq long, len int, terms array<string>, tfs array<int>"
BLOCKS = "term string, chunk long, block int, top double, n int, seqs array<long>, weights array<double>"


@dataclass(frozen=True)
class BlockIndex:
    """``blocks`` (BLOCKS), ``terms(term, df, idf, top)``, ``forward(seq, len, terms, tfs)``, one row of ``stats(n, avg_len)``."""

    blocks: DataFrame
    terms: DataFrame
    forward: DataFrame
    stats: DataFrame

    @property
    def docs(self) -> DataFrame:
        return self.forward.select("seq", "len")

    def release(self) -> None:
        """Nothing is kept in memory."""

    def write(self, path: str) -> None:
        for name in ("blocks", "terms", "forward", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> BlockIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "terms", "forward", "stats")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, text) to one row a document that has a token."""
    rows: list = []
    held = 0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        rows.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())), strict=True)], ["seq", "len", "terms", "tfs"])

    for batch in batches:
        for seq, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = (text.as_py() or "").split()
            if tokens:
                own = Counter(tokens)
                rows.append((seq, len(tokens), list(own), list(own.values())))
                held += len(own)
                if held >= COUNTED:
                    yield flush()
                    held = 0
    yield flush()


def weight(tf, length, average: float):
    """What one occurrence list of a term in a document adds for an idf of one."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _blocks(average: float, chunk: int, block: int):
    """Rows of documents to blocks of postings, those of a chunk of documents ordered by term, weight and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            t = pa.Table.from_batches(held).combine_chunks()
            n_terms = pa.compute.list_value_length(t["terms"]).to_numpy()
            words = t["terms"].combine_chunks().flatten().dictionary_encode()
            seq, length = np.repeat(t["seq"].to_numpy(), n_terms), np.repeat(t["len"].to_numpy(), n_terms)
            w = weight(t["tfs"].combine_chunks().flatten().to_numpy().astype(np.float64), length, average)
            term = words.indices.to_numpy()
            order = np.lexsort((seq, -w, term))
            term, seq, w = term[order], seq[order], w[order]
            first = np.flatnonzero(np.diff(term, prepend=-1))
            place = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
            starts = np.flatnonzero(place % block == 0)
            ends = np.append(starts[1:], len(term))
            for at in range(0, len(starts), ROWS):
                s, e = starts[at : at + ROWS], ends[at : at + ROWS]
                offsets = pa.array(np.append(s, e[-1]) - s[0], pa.int32())
                part = slice(s[0], e[-1])
                cols = [
                    words.dictionary.take(pa.array(term[s])), pa.repeat(pa.scalar(base + made, pa.int64()), len(s)), pa.array((place[s] // block).astype(np.int32)), pa.array(w[s]), pa.array((e - s).astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(seq[part])), pa.ListArray.from_arrays(offsets, pa.array(w[part])),
                ]
                yield pa.record_batch(cols, ["term", "chunk", "block", "top", "n", "seqs", "weights"])
            made += 1
            held.clear()

        for batch in batches:
            ends = np.cumsum(pa.compute.list_value_length(batch.column("terms")).to_numpy())
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                stop = min(max(at + 1, int(np.searchsorted(ends, before + chunk - size, "right"))), batch.num_rows)
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - before
                at = stop
                if size >= chunk or at < batch.num_rows:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def build(docs: DataFrame, seq: str = "seq", text: str = "text") -> BlockIndex:
    """The index of ``docs(seq, text)``; blank documents are left out. The text is read once; nothing but term counts is shuffled."""
    own = docs.select(F.col(seq).cast("long").alias("seq"), F.col(text).alias("text"))
    forward = written(own.mapInArrow(_counted, FORWARD), "forward")
    stats = written(forward.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len")), "stats")
    average = stats.first()["avg_len"] or 1.0
    blocks = written(forward.mapInArrow(_blocks(average, CHUNK, BLOCK), BLOCKS), "blocks")
    tops = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"))
    return BlockIndex(blocks, written(lexical.idf_of(tops, stats), "terms"), forward, stats)


def asked(index: BlockIndex, queries: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids, term, u, df, top): the known terms of each query; u is the idf times the repeats."""
    q = queries.select(*ids, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("times"))
    return q.join(index.terms, "term").select(*ids, "term", (F.col("times") * F.col("idf")).alias("u"), "df", "top")


def _resolved(average: float, kept: list[str]):
    """Documents' rows, each ahead of the pairs that ask for it, to (kept, more): what the asked terms add to the pair's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, own = None, {}
        for batch in batches:
            pairs, scores = [], []
            cols = [batch.column(c) for c in ("seq", "len", "terms", "tfs", "asked")]
            for i, seq in enumerate(cols[0].to_pylist()):
                if cols[4][i].is_valid:
                    found = own if doc == seq else {}
                    pairs.append(i)
                    scores.append(sum(x["u"] * found.get(x["term"], 0.0) for x in cols[4][i].as_py()))
                else:
                    tfs = cols[3][i].values.to_numpy().astype(np.float64)
                    doc, own = seq, dict(zip(cols[2][i].as_py(), weight(tfs, cols[1][i].as_py(), average).tolist(), strict=True))
            at = pa.array(pairs, pa.int64())
            yield pa.record_batch([*(batch.column(c).take(at) for c in kept), pa.array(scores, pa.float64())], [*kept, "more"])

    return run


def _exact(pairs: DataFrame, terms: DataFrame, index: BlockIndex, ids: list[str], *others: str) -> DataFrame:
    """(ids, seq, others, more): what ``terms(ids, term, u)`` add to the score of each pair, from the documents' own rows, each of which travels once."""
    average = index.stats.first()["avg_len"] or 1.0
    each = terms.groupBy(*ids).agg(F.collect_list(F.struct("term", "u")).alias("asked"))
    kept = [*ids, "seq", *others]
    wanted = pairs.select(kept).join(each, ids, "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<struct<term:string,u:double>>")))
    rows = index.forward.join(pairs.select("seq").distinct(), "seq", "left_semi").unionByName(wanted, allowMissingColumns=True)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(kept).schema)
    return rows.repartition("seq").sortWithinPartitions("seq", F.col("asked").isNotNull()).mapInArrow(_resolved(average, kept), f"{kinds}, more double")


def _thresholds(scored: DataFrame, k: int, ids: list[str]) -> DataFrame:
    """(ids, least): the k-th score, less what rounding can shift; queries with fewer have none."""
    kth = best(scored, k, ids).filter(F.col("rank") == k)
    return kth.select(*ids, (F.col("score") - F.abs("score") * 1e-12 - 1e-8).alias("least"))


@dataclass(frozen=True)
class Plan:
    """The terms of a query batch: ``terms`` with ``leave`` (left out or not), ``total`` and ``rest`` (bounds of all and of the left-out terms), ``least``."""

    asked: DataFrame
    terms: DataFrame
    seeds: DataFrame


def plan(index: BlockIndex, queries: DataFrame, k: int, ids: list[str], text: str) -> Plan:
    """Threshold and left-out terms of each query."""
    q = written(asked(index, queries, ids, text), "asked")
    by_df = W.partitionBy(*ids).orderBy("df", "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    rare = q.withColumn("_sum", F.sum("df").over(by_df)).filter(F.col("_sum") - F.col("df") < SEED_POSTINGS * k).drop("_sum")
    seeds = rare.join(index.blocks.filter("block = 0").select("term", "n", "seqs", "weights"), "term")
    named = seeds.select(*ids, "u", F.explode(F.arrays_zip("seqs", "weights")).alias("x")).groupBy(*ids, F.col("x.seqs").alias("seq")).agg(F.sum(F.col("u") * F.col("x.weights")).alias("score"))
    pairs = best(named, SEEDS * k, ids).select(*ids, "seq")
    least = _thresholds(_exact(pairs, q, index, ids).withColumnRenamed("more", "score"), k, ids)
    bound = F.greatest(F.col("u"), F.lit(0.0)) * F.col("top")
    full = q.join(least, ids, "left").withColumns({"least": F.coalesce("least", F.lit(-1e300)), "bound": bound})
    # the longest lists go first; those of negative weight can lift nothing
    by_worth = W.partitionBy(*ids).orderBy(F.col("bound") > 0, F.col("df").desc(), "term")
    all_ = W.partitionBy(*ids)
    full = full.withColumns({"total": F.sum("bound").over(all_), "_sum": F.sum("bound").over(by_worth.rowsBetween(W.unboundedPreceding, W.currentRow))})
    full = full.withColumn("leave", F.col("_sum") < LEFT_OUT * F.col("least")).drop("_sum")
    return Plan(q, written(full.withColumn("rest", F.sum(F.when(F.col("leave"), F.col("bound")).otherwise(0.0)).over(all_)), "plan"), seeds)


def _readable(index: BlockIndex, plan: Plan) -> DataFrame:
    """The blocks that must be read for each query's terms."""
    lists = plan.terms.filter("not leave").join(index.blocks.withColumnRenamed("top", "_top"), "term")
    return lists.filter(F.greatest(F.col("u"), F.lit(0.0)) * F.col("_top") + F.col("total") - F.col("bound") >= F.col("least"))


def top_k(index: BlockIndex, queries: DataFrame, k: int, query_id: str | list[str] = "query_id", text: str = "query") -> DataFrame:
    """As ``lexical.top_k``: the ``k`` best documents of each query with rank and score, filled up with documents without a common term."""
    ids = [query_id] if isinstance(query_id, str) else query_id
    p = plan(index, queries, k, ids, text)
    sums = _readable(index, p).select(*ids, "u", "least", "rest", F.explode(F.arrays_zip("seqs", "weights")).alias("x"))
    sums = sums.groupBy(*ids, F.col("x.seqs").alias("seq")).agg(F.sum(F.col("u") * F.col("x.weights")).alias("_part"), F.first("least").alias("least"), F.first("rest").alias("rest"))
    found = written(sums.filter(F.col("_part") + F.col("rest") >= F.col("least")).select(*ids, "seq", "_part"), "candidates")
    scored = _exact(found, p.terms.filter("leave"), index, ids, "_part").select(*ids, "seq", T.rounded(F.col("_part") + F.col("more"), 9).alias("score"))
    return lexical.filled(best(scored, k, ids).drop("rank"), queries, index.docs, k, ids)


def pruning(index: BlockIndex, queries: DataFrame, k: int, query_id: str | list[str] = "query_id", text: str = "query") -> DataFrame:
    """(ids, blocks, blocks_read, postings, postings_read) of each query: what its terms' lists have, and what is read of them (twice, if both passes do)."""
    ids = [query_id] if isinstance(query_id, str) else query_id
    p = plan(index, queries, k, ids, text)
    size = lambda rows, a, b: rows.groupBy(*ids).agg(F.count(F.lit(1)).alias(a), F.sum("n").alias(b))
    whole = size(p.asked.select(*ids, "term").join(index.blocks.select("term", "n"), "term"), "blocks", "postings")
    read = size(_readable(index, p).select(*ids, "n").unionByName(p.seeds.select(*ids, "n")), "blocks_read", "postings_read")
    return whole.join(read, ids, "left").na.fill(0, ["blocks_read", "postings_read"])
