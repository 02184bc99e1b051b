"""BM25 over materialised postings.

The index is three tables: ``postings(term, seq, tf, len)``, ``terms(term, df, idf)`` and one row of corpus figures.
A document is one row, so its tokens are counted where it lies, in Arrow batches: for the terms' figures a task adds up its own documents first, and
nothing is shuffled for the postings. The terms of a batch of up to ``TRAVELLING`` query terms travel to the documents: where an index was just built, a task
scores its documents as it reads them; of a stored index the postings of the batch's terms, each once, meet by document. Either way a task keeps
the best ``k`` of each query, so no pair of query and document travels but those. A larger batch meets the postings in an equi-join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.sources.lineage import written

from .vector import NO_ID

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass(frozen=True)
class LexicalIndex:
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    #: The (seq, text) that the other tables are made from and the terms' figures, if the index was just built.
    texts: DataFrame | None = None
    figures: DataFrame | None = None

    def _held(self) -> list[DataFrame]:
        return [*([self.docs, self.postings] if self.texts is None else [self.figures]), self.terms, self.stats]

    @cached_property
    def single(self) -> bool:
        """Whether every document is one row of ``texts``."""
        return self.texts is not None and self.texts.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()

    def persist(self) -> LexicalIndex:
        """Keeps the tables for several uses, of an index that was just built the figures alone; ``release`` lets them go. A lost executor's part is counted again."""
        for t in self._held():
            t.persist()
        return self

    def release(self) -> None:
        for t in self._held():
            t.unpersist()

    def write(self, path: str) -> None:
        """Postings sorted by term inside files, so that a term's rows are found by file statistics."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.postings.repartitionByRange("term", "seq").sortWithinPartitions("term", "seq").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def read(cls, spark, path: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "terms", "stats")))


ROWS = 1 << 16


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, text) to (seq, len, term, tf); a document's own row has no term. str.split() cuts as ``functions.text.tokens`` does."""
    seqs, lens, terms, tfs = [], [], [], []

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(seqs, pa.int64()), pa.array(lens, pa.int32()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], ["seq", "len", "term", "tf"])
        for x in (seqs, lens, terms, tfs):
            x.clear()
        return out

    for batch in batches:
        for seq, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = (text.as_py() or "").split()
            if not tokens:
                continue
            own = Counter(tokens)
            n = len(own) + 1
            seqs += [seq] * n
            lens += [len(tokens)] * n
            terms.append(None)
            terms += own.keys()
            tfs.append(0)
            tfs += own.values()
            if len(seqs) >= ROWS:
                yield flush()
    yield flush()


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, text) to partial sums (term, df, n): the documents of each term; without a term, the documents with words and their words."""
    df: Counter = Counter()
    docs = words = 0

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array([None, *df], pa.string()), pa.array([docs, *df.values()], pa.int64()), pa.array([words, *[0] * len(df)], pa.int64())], ["term", "df", "n"])
        df.clear()
        return out

    for batch in batches:
        for text in batch.column(1):
            tokens = (text.as_py() or "").split()
            if tokens:
                docs, words = docs + 1, words + len(tokens)
                df.update(set(tokens))
                if len(df) >= 4 * ROWS:
                    yield flush()
                    docs = words = 0
    yield flush()


def idf_of(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """``terms(term, df, ...)`` with idf = ln(N - df + 0.5) - ln(df + 0.5); negative ones become a quarter of the mean over all terms."""
    df = terms.crossJoin(F.broadcast(stats.select("n")))  # one row
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).withColumn("idf", idf).select(*terms.columns, "idf")


def build(docs: DataFrame, seq: str = "seq", text: str = "text") -> LexicalIndex:
    """The index of ``docs(seq, text)``, seq being a long; blank documents are left out."""
    own = docs.select(F.col(seq).cast("long").alias("seq"), F.col(text).alias("text"))
    counted = own.mapInArrow(_counted, "seq long, len int, term string, tf long")
    each = counted.filter("term is null").select("seq", "len")
    postings = counted.filter("term is not null").select("term", "seq", "tf", "len")
    figures = own.mapInArrow(_figures, "term string, df long, n long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    whole = figures.filter("term is null")
    stats = whole.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.sum(F.col("n") / F.nullif(F.col("df"), F.lit(0))).alias("avg_len"))
    return LexicalIndex(each, postings, idf_of(figures.filter("term is not null").select("term", "df"), stats), stats, own, figures)


def score(index: LexicalIndex, queries: DataFrame, query_id: str | list[str] = "query_id", text: str = "query") -> DataFrame:
    """(query_id, seq, score) of every document that has a term of the query; a repeated query token counts again."""
    ids = [query_id] if isinstance(query_id, str) else query_id
    q = queries.select(*ids, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("times"))
    tf = F.col("tf")
    weight = F.col("times") * F.col("idf") * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))))
    hits = q.join(index.terms, "term").join(index.postings, "term").crossJoin(F.broadcast(index.stats.select("avg_len")))  # one row
    return hits.groupBy(*ids, "seq").agg(T.rounded(F.sum(weight), 9).alias("score"))


#: Query terms that travel to the documents.
TRAVELLING = 1 << 17
#: Pairs of query and document that a task scores at once.
PAIRS = 1 << 16


class _Asked:
    """A batch of queries in a task: their terms with weights, and the best ``k`` documents of each so far.

    ``rows(query, term, weight)`` are sorted by term; a term's number is its place among the distinct ones.
    """

    def __init__(self, queries: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int, avg_len: float):
        self.queries, self.weights, self.k, self.avg_len, self.n = queries, weights, k, avg_len, n
        self.start = np.searchsorted(terms, np.arange(terms[-1] + 2))
        self.scores, self.seqs = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros((n, k), bool)

    def add(self, seq: np.ndarray, lens: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Whole documents: ``seq`` and ``lens``, and for each of their terms the document's place, the term's number and its count; ``at`` ascends."""
        size = max(1, PAIRS // self.n)
        for low in range(0, len(seq), size):
            i, j = np.searchsorted(at, (low, low + size))
            if j > i:
                self._add(seq[low : low + size], lens[low : low + size], at[i:j] - low, term[i:j], tf[i:j].astype(np.float64))

    def _add(self, seq: np.ndarray, lens: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[at] / self.avg_len))
        first, times = self.start[term], self.start[term + 1] - self.start[term]
        row = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
        key = self.queries[row] * len(seq) + np.repeat(at, times)
        size = self.n * len(seq)
        score = np.floor(np.bincount(key, self.weights[row] * np.repeat(weight, times), size) * 1e9 + 0.5) / 1e9
        met = np.bincount(key, minlength=size) > 0
        q, d = np.nonzero(met.reshape(self.n, -1) & (score.reshape(self.n, -1) >= self.scores[:, -1][:, None]))
        if not len(q):
            return
        k, rows = self.k, np.unique(q)
        row = np.concatenate([np.repeat(np.arange(len(rows)), k), np.searchsorted(rows, q)])
        scores, seqs = np.concatenate([self.scores[rows].ravel(), score[q * len(seq) + d]]), np.concatenate([self.seqs[rows].ravel(), seq[d]])
        full = np.concatenate([self.full[rows].ravel(), np.ones(len(q), bool)])
        order = np.lexsort((seqs, -scores, ~full, row))
        top = order[np.searchsorted(row[order], np.arange(len(rows)))[:, None] + np.arange(k)]
        self.scores[rows], self.seqs[rows], self.full[rows] = scores[top], seqs[top], full[top]

    def hits(self) -> pa.RecordBatch:
        q, i = np.nonzero(self.full)
        return pa.record_batch([pa.array(q, pa.int64()), pa.array(self.seqs[q, i], pa.int64()), pa.array(self.scores[q, i])], ["q", "seq", "score"])


def _of_texts(numbers: dict[str, int], asked: tuple):
    """(seq, text) to the best of each query in this task."""
    known = numbers.__contains__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ = _Asked(*asked)
        for batch in batches:
            seqs = batch.column(0).to_numpy(zero_copy_only=False)
            at, lens, terms, tfs = [], np.zeros(len(seqs), np.int64), [], []
            for i, text in enumerate(batch.column(1)):
                tokens = (text.as_py() or "").split()
                lens[i] = len(tokens)
                own = Counter(filter(known, tokens))
                at += [i] * len(own)
                terms += map(numbers.__getitem__, own)
                tfs += own.values()
            best_.add(seqs, lens, np.array(at, np.int64), np.array(terms, np.int64), np.array(tfs, np.int64))
        yield best_.hits()

    return run


def _of_postings(asked: tuple):
    """(seq, t, tf, len), sorted by seq, to the best of each query in this task. A document's rows may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ = _Asked(*asked)
        left = [np.zeros(0, np.int64)] * 4

        def add(rows: list[np.ndarray]) -> None:
            seq, term, tf, lens = rows
            own, first, at = np.unique(seq, return_index=True, return_inverse=True)
            best_.add(own, lens[first], at, term, tf)

        for batch in batches:
            rows = [np.concatenate([a, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for a, c in zip(left, batch.columns, strict=True)]
            whole = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
            add([r[:whole] for r in rows])
            left = [r[whole:] for r in rows]
        add(left)
        yield best_.hits()

    return run


def scored(index: LexicalIndex, queries: DataFrame, k: int, ids: list[str], text: str = "query") -> DataFrame:
    """(ids, seq, score): the ``k`` best of the documents of ``score`` for each query."""
    q = queries.select(*ids, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("times"))
    known = q.join(index.terms, "term").select("term", *ids, "times", "idf").limit(TRAVELLING + 1).collect()
    if len(known) > TRAVELLING or (index.texts is not None and not index.single):
        return best(score(index, queries, ids, text), k, ids).drop("rank")
    spark, kinds = queries.sparkSession, queries.select(*ids).schema
    named = list(dict.fromkeys(tuple(r[1 : 1 + len(ids)]) for r in known))
    place = {name: i for i, name in enumerate(named)}
    names = spark.createDataFrame([(i, *n) for i, n in enumerate(named)], "q long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds))
    if not known:
        return names.select(*ids, F.lit(None).cast("long").alias("seq"), F.lit(None).cast("double").alias("score"))
    known.sort(key=lambda r: r[0])
    numbers = {t: i for i, t in enumerate(dict.fromkeys(r[0] for r in known))}
    rows = [np.array([place[tuple(r[1 : 1 + len(ids)])] for r in known]), np.array([numbers[r[0]] for r in known]), np.array([r["times"] * r["idf"] for r in known], np.float64)]
    asked = (*rows, len(named), k, index.stats.first()["avg_len"])
    kind, known_id = "q long, seq long, score double", F.coalesce("seq", F.lit(NO_ID))
    if index.texts is not None:
        hits = index.texts.withColumn("seq", known_id).mapInArrow(_of_texts(numbers, asked), kind)
    else:
        table = spark.createDataFrame(list(numbers.items()), "term string, t int")  # the batch's terms
        own = index.postings.join(F.broadcast(table), "term").select(known_id.alias("seq"), "t", "tf", "len")
        hits = own.repartition("seq").sortWithinPartitions("seq").mapInArrow(_of_postings(asked), kind)
    return best(hits, k, ["q"]).join(F.broadcast(names), "q").select(*ids, F.nullif(F.col("seq"), F.lit(NO_ID)).alias("seq"), "score")


def best(scored: DataFrame, k: int, by: list[str], score: str = "score", tie: str | list[str] = "seq", down: bool = True) -> DataFrame:
    """The first ``k`` of each group, ties by ``tie``, with their rank."""
    order = F.col(score).desc() if down else F.col(score).asc()
    ties = [tie] if isinstance(tie, str) else tie
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(order, *ties))).filter(F.col("rank") <= k)


def top_k(index: LexicalIndex, queries: DataFrame, k: int, query_id: str | list[str] = "query_id", text: str = "query") -> DataFrame:
    """The ``k`` best documents of each query, documents without a common term (score 0, in order) included where fewer match.

    ``index`` may also be a ``blockmax.BlockIndex``, whose lists are pruned.
    """
    if not isinstance(index, LexicalIndex):
        from . import blockmax

        return blockmax.top_k(index, queries, k, query_id, text)
    ids = [query_id] if isinstance(query_id, str) else query_id
    docs = index.docs if index.texts is None else index.texts.filter(~T.is_blank(F.col("text")))
    return filled(scored(index, queries, k, ids, text), queries, docs, k, ids)


def filled(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int, ids: list[str]) -> DataFrame:
    """``hits(ids, seq, score)`` of up to ``k`` documents a query, with documents of score 0 added where there are fewer, and ranks.

    A query with fewer than ``k`` matches finds its fill among the first 2k documents, so the fill is joined
    with those alone and never with the corpus.
    """
    hits = written(hits, "hits")  # read three times
    found = hits.groupBy(*ids).agg(F.count(F.lit(1)).alias("found"))
    short = queries.select(*ids).distinct().join(found, ids, "left").filter(F.coalesce("found", F.lit(0)) < k).select(*ids)
    first = docs.select("seq").orderBy("seq").limit(2 * k)
    fill = short.crossJoin(F.broadcast(first)).join(hits.select(*ids, "seq"), [*ids, "seq"], "left_anti").withColumn("score", F.lit(0.0))
    return best(hits.unionByName(fill), k, ids)


def _shares(terms: list[str], start: np.ndarray, asking: np.ndarray, sizes: np.ndarray, kinds: dict[str, int], allowed: np.ndarray, k: int):
    """(node_id, node_type, seq, terms) to the best of each query in an Arrow batch, by the part of its ``sizes`` terms that a node has.

    Term t is asked for by the queries ``asking[start[t] : start[t + 1]]``; ``allowed[query, kind]`` says which nodes a query wants, the last kind being none.
    """
    n, vocabulary = len(sizes), pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros(n)  # the k-th score of each query so far
        for batch in batches:
            ids, kind, seq, words = batch.columns
            size = max(1, PAIRS // n)
            q, node, score = [], [], []
            for low in range(0, batch.num_rows, size):
                part = words.slice(low, size)
                rows = len(part)
                found = pc.index_in(part.flatten(), value_set=vocabulary)
                own = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))
                hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
                term, own = found.filter(pa.array(hit)).to_numpy(zero_copy_only=False).astype(np.int64), own[hit]
                first, times = start[term], start[term + 1] - start[term]
                key = asking[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())] * rows + np.repeat(own, times)
                share = np.bincount(key, minlength=n * rows).reshape(n, rows) / np.maximum(sizes, 1)[:, None]
                of = np.array([kinds.get(x, len(kinds)) for x in kind.slice(low, size).to_pylist()])
                at, place = np.nonzero((share > 0) & (share >= least[:, None]) & allowed[:, of])
                q.append(at)
                node.append(place + low)
                score.append(share[at, place])
            if not q:
                continue
            q, node, score = np.concatenate(q), np.concatenate(node), np.concatenate(score)
            # the batch's nodes in order of (seq, id), null first; strings by code point, as in UTF-8
            seqs, names = seq.to_pylist(), ids.to_pylist()
            order = np.empty(batch.num_rows, np.int64)
            order[sorted(range(batch.num_rows), key=lambda i: (seqs[i] is not None, seqs[i] or 0, names[i] is not None, names[i] or ""))] = np.arange(batch.num_rows)
            best_ = np.lexsort((order[node], -score, q))
            q, node, score = q[best_], node[best_], score[best_]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            last = rank == k - 1
            least[q[last]] = np.maximum(least[q[last]], score[last])
            top = rank < k
            at = pa.array(node[top])
            yield pa.record_batch([pa.array(q[top], pa.int64()), ids.take(at), seq.take(at), pa.array(score[top])], ["q", "node_id", "seq", "score"])

    return run


def structured(nodes: DataFrame, queries: DataFrame, wanted: Column, k: int, query_id: list[str], text: str = "query") -> DataFrame:
    """Nodes of the ``wanted`` kinds (paragraphs aside) by the part of the query's terms in title and text, best ``k`` above 0.

    Up to ``TRAVELLING`` query terms travel to the nodes, and a task hands on k rows a query and Arrow batch, of which it keeps k a query; more terms meet the nodes' in a join.
    """
    kinds = nodes.filter((F.col("node_type") != "paragraph") & ~T.is_blank(F.col("text")))
    own = kinds.select("node_id", "node_type", F.col("order").alias("seq"), T.terms(F.concat_ws(" ", F.coalesce("title", F.lit("")), "text")).alias("terms"))
    q = queries.withColumn("_terms", T.terms(F.col(text))).withColumn("_wanted", wanted)
    asked = q.select(*query_id, "_wanted", F.size("_terms").alias("_n"), F.explode("_terms").alias("term"))
    known = asked.limit(TRAVELLING + 1).collect()
    ids = [tuple(r[: len(query_id)]) for r in known]
    # one plan a query, one row a node: anything else is added up by the join
    plans = {(i, tuple(r["_wanted"] or ()), r["_n"]) for i, r in zip(ids, known, strict=True)}
    single = len(plans) == len(set(ids)) and len(set(zip(ids, (r["term"] for r in known), strict=True))) == len(known)
    if len(known) > TRAVELLING or not single or not kinds.groupBy("node_id", "order").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        words = own.select("node_id", "node_type", "seq", F.explode("terms").alias("term"))
        hits = asked.join(words, "term").filter(F.array_contains("_wanted", F.col("node_type")))
        scored = hits.groupBy(*query_id, "node_id", "seq").agg((F.count(F.lit(1)) / F.first("_n")).alias("score"))
        return best(scored, k, query_id, tie=["seq", "node_id"])
    place = {i: n for n, i in enumerate(dict.fromkeys(ids))}
    spark, types = queries.sparkSession, queries.select(*query_id).schema
    names = spark.createDataFrame([(n, *i) for i, n in place.items()], "q long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types))
    terms = sorted({r["term"] for r in known})
    rows = sorted(zip((r["term"] for r in known), map(place.__getitem__, ids), strict=True))
    start = np.searchsorted(np.array([t for t, _ in rows], object), np.array([*terms], object)) if rows else np.zeros(0, np.int64)
    table = {t: n for n, t in enumerate(dict.fromkeys(t for r in known for t in r["_wanted"] or ()))}
    sizes, allowed = np.zeros(len(place), np.int64), np.zeros((len(place), len(table) + 1), bool)
    for i, r in zip(ids, known, strict=True):
        sizes[place[i]] = r["_n"]
        allowed[place[i], [table[t] for t in r["_wanted"] or () if t is not None]] = True
    kind = f"q long, node_id {own.schema['node_id'].dataType.simpleString()}, seq {own.schema['seq'].dataType.simpleString()}, score double"
    if not known:
        return names.select(*query_id, *(F.lit(None).cast(t).alias(c) for c, t in (("node_id", own.schema["node_id"].dataType), ("seq", own.schema["seq"].dataType), ("score", "double"), ("rank", "int")))).limit(0)
    hits = own.mapInArrow(_shares(terms, np.append(start, len(rows)), np.array([n for _, n in rows]), sizes, table, allowed, k), kind)
    return best(hits, k, ["q"], tie=["seq", "node_id"]).join(F.broadcast(names), "q").select(*query_id, "node_id", "seq", "score", "rank")
