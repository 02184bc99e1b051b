"""Hybrid retrieval from a query batch to packed passages, one DataFrame pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as T

from tarn.sources.lineage import among, cut, written

from . import blockmax, context, embed, fusion, lexical, rerank, vector
from .profile import Profile


@dataclass(frozen=True)
class Limits:
    k: int = 10
    fetch_k: int = 40
    alpha: float = 0.5
    token_budget: int = 1800
    top_n: int = 10

    def checked(self) -> Limits:
        """fetch_k below one means max(40, 4k); pools are never smaller than k, the budget not below 200."""
        fetch = max(40, 4 * self.k) if self.fetch_k <= 0 else max(self.fetch_k, self.k)
        return Limits(self.k, fetch, self.alpha, max(self.token_budget, context.LEAST_BUDGET), max(self.top_n, self.k))


@dataclass(frozen=True)
class Corpus:
    """What retrieval reads: ``passages(seq, text, ...)``, their vectors, the lexical index, and the node table if there is a tree."""

    passages: DataFrame
    vectors: DataFrame
    index: lexical.LexicalIndex | blockmax.BlockIndex
    nodes: DataFrame | None = None

    @classmethod
    def of(cls, passages: DataFrame, embedder: Callable[[Column], Column] | None = None, nodes: DataFrame | None = None, pruned: bool = False) -> Corpus:
        """Vectors by ``embedder`` (the hashed embedding if none is given), unless passages bring an ``embedding``. ``pruned`` builds blocks of postings
        with their largest weights, which takes longer and lets a search leave most of long lists unread: for large corpora. Vectors of a given ``embedder``
        are kept; hashed ones cost less anew than kept, as a vector takes as much room as a text."""
        fn = embedder or embed.hashed
        brought = "embedding" in passages.columns
        vectors = passages.select("seq", (F.col("embedding") if brought else fn(F.col("text"))).alias("embedding"))
        return cls(passages.drop("embedding"), vectors.persist() if embedder and not brought else vectors, blockmax.build(passages) if pruned else lexical.build(passages).persist(), nodes)

    def release(self) -> None:
        """Lets go of what ``of`` keeps."""
        self.vectors.unpersist()
        self.index.release()


def candidates(corpus: Corpus, planned: DataFrame, limits: Limits, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Fused pools of every subquery, then structured nodes of the kinds the plan prefers, with ``at`` in list order."""
    # numbers of the subqueries, whatever the query ids are; written out, so that they stay
    subs = cut(fusion.subqueries(planned).withColumn("qs", F.monotonically_increasing_id()))
    asked = subs.select("qs", "query", (embedder or embed.hashed)(F.col("query")).alias("embedding"))
    near = vector.top_k(corpus.vectors, asked, limits.fetch_k, query_id="qs").withColumnRenamed("query_id", "qs")
    words = lexical.top_k(corpus.index, asked.select("qs", "query"), limits.fetch_k, "qs")
    # the pools are ids and scores, read several times; their passages are picked out where they lie
    both = written(fusion.fused(near, words, limits.alpha, by=("qs",)).join(subs.select("qs", "query_id", "sub"), "qs").drop("qs"), "pools")
    held = cut(fusion.keyed(among(corpus.passages, both, "seq")))
    out = both.join(held, "seq").withColumns({"stage": F.lit(0), "structured": F.lit(None).cast("double")})
    if corpus.nodes is not None:
        kinds = planned.join(subs.select("query_id", "sub", F.col("query").alias("_sub_query")), "query_id").filter(F.size(F.array_remove("node_types", "paragraph")) > 0)
        hits = lexical.structured(corpus.nodes, kinds, F.array_remove("node_types", "paragraph"), limits.fetch_k, ["query_id", "sub"], "_sub_query")
        shared = [c for c in corpus.passages.columns if c in corpus.nodes.columns and c not in ("node_id", "seq")]
        hits = written(hits.select("query_id", "sub", "node_id", "score", F.col("rank").alias("place")), "structured")
        found = hits.join(cut(fusion.keyed(among(corpus.nodes.select("node_id", *shared), hits, "node_id"))), "node_id")
        found = found.withColumns({"structured": F.col("score"), "stage": F.lit(1)})
        out = out.unionByName(found, allowMissingColumns=True)
    return fusion.listed(out)


def counts(found: DataFrame) -> DataFrame:
    """(query_id, raw_candidates, structured_candidates) of a list of candidates: all of them, and a map from each subquery's place to its structured ones."""
    each = found.groupBy("query_id", "sub").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("stage") == 1).cast("long")).alias("s"))
    return each.groupBy("query_id").agg(F.sum("n").alias("raw_candidates"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("sub", "s")))).alias("structured_candidates"))


def ranked(corpus: Corpus, queries: DataFrame, limits: Limits | None = None, profile: Profile | None = None, scorer: rerank.Scorer | None = None, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Deduplicated candidates of ``queries(query_id, query[, intent, subqueries, node_types])`` with boosts and ``position``.

    Candidates come from the plan's subqueries, boosts from the query itself.
    """
    limits = (limits or Limits()).checked()
    planned = fusion.plans(queries)
    found = fusion.deduplicated(candidates(corpus, planned, limits, embedder))
    full = found.join(planned.select("query_id", "query", "intent", "node_types"), "query_id")
    order = rerank.ordered(rerank.boosted(full, profile))
    return rerank.cross_encoded(order, scorer, limits.top_n) if scorer else order


def retrieve(corpus: Corpus, queries: DataFrame, limits: Limits | None = None, profile: Profile | None = None, scorer: rerank.Scorer | None = None, embedder: Callable[[Column], Column] | None = None, counter: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """The packed passages of each query in slots from 0, with ``total_tokens`` and ``dropped``."""
    limits = (limits or Limits()).checked()
    order = ranked(corpus, queries, limits, profile, scorer, embedder)
    if corpus.nodes is not None:
        order = cut(order)  # its families are looked up before it is read
    # some hundred rows a query, read twice below
    grown = cut(context.expanded(order, corpus.nodes, counter))
    blank = lambda c: F.col(c) if c in grown.columns else None
    grown = grown.withColumn("packed_key", T.document_key(F.col("packed_text"), F.col("packed_id"), blank("source"), blank("page")))
    slots = context.packed(grown, limits.k, limits.token_budget)
    return slots.join(grown, ["query_id", "position"])
