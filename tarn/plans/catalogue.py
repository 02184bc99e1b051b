"""Registered queries over the driver's tables; ``oracles`` has the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import agent, blockmax, chunk, context, embed, evidence, fusion, history, lexical, parse, profile, render, rerank, research, retrieve, sentences, vecjoin, vector
from tarn.sources import files as scans
from tarn.sources import stores
from tarn.sources.lineage import shared_path, written
from tarn.streaming import session

from .oracles import ORACLES  # noqa: F401
from .samples import PROFILE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that was read in fewer parts than there are cores (a file of one row group) is dealt out, as counting words costs more than moving them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text", "source"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    return lexical.build(corpus(spark, sf_dir)).persist()


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trees: a conversation is a section under its root, a turn a paragraph, the turn number its order."""
    c = read(spark, sf_dir, "conversations")
    conv = F.col("conv_id").cast("string")
    doc, section = F.concat(F.lit("conv:"), conv), F.concat(F.lit("conv:"), conv, F.lit(":section"))
    para = c.select(F.concat_ws(":", doc, F.lit("paragraph"), F.col("turn").cast("string")).alias("node_id"), section.alias("parent_id"), doc.alias("doc_id"), F.lit("paragraph").alias("node_type"), F.lit(None).cast("string").alias("title"), "text", F.col("turn").cast("int").alias("order"), F.lit(2).alias("level"), F.array(doc, section).alias("ancestors"), F.col("role").alias("source"))
    none = F.lit(None).cast("string")
    ids = c.select("conv_id").distinct()
    sections = ids.select(section.alias("node_id"), doc.alias("parent_id"), doc.alias("doc_id"), F.lit("section").alias("node_type"), F.concat(F.lit("Conversation "), conv).alias("title"), F.lit("").alias("text"), F.lit(0).alias("order"), F.lit(1).alias("level"), F.array(doc).alias("ancestors"), none.alias("source"))
    roots = ids.select(doc.alias("node_id"), none.alias("parent_id"), doc.alias("doc_id"), F.lit("document").alias("node_type"), none.alias("title"), F.lit("").alias("text"), F.lit(0).alias("order"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("ancestors"), none.alias("source"))
    return roots.unionByName(sections).unionByName(para)


# scalar functions


@query
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query
def normalize_parser_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


@query
def normalize_pdf_page(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.clean_pdf_page(F.col("text")).alias("normalized"))


@query
def normalize_dedupe_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.dedupe_key(F.col("text")).alias("key"))


@query
def query_terms_distinct(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.terms(F.col("text"))).cast("long").alias("n_terms"))


@query
def document_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.document_key(F.col("text"), source=F.col("source")).alias("key"))


@query
def path_doc_id(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.doc_id_of_path(F.col("url")).alias("id"))


@query
def source_basename(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.basename(F.col("url")).alias("name"), T.suffix(F.col("url")).alias("suffix"))


@query
def token_count_fallback(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"))


@query
def split_paragraphs(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n \n").alias("all"))
    return c.select("conv_id", F.posexplode(T.split_paragraphs(F.col("all"))).alias("place", "paragraph")).select("conv_id", F.col("place").cast("long").alias("place"), "paragraph")


@query
def quote_truncation(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.shortened(F.col("text"), 400).alias("quote"), T.shortened(F.col("text"), 600, one_line=True).alias("snippet"))


@query
def compact_phrase(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.compact(F.col("text")).alias("letters"))


@query
def fake_embedding(spark, sf_dir):
    """All components of the full embedding, as their bytes in one digest."""
    v = read(spark, sf_dir, "documents").select("doc_id", embed.hashed(F.col("text")).alias("v"))
    joined = F.array_join(F.transform("v", lambda x: F.round(x * 255).cast("int").cast("string")), ",")
    return v.select("doc_id", *[F.col("v")[i].alias(f"c{i}") for i in (0, 1, 31, 32, 383)], F.sha1(joined).alias("components"), F.size("v").cast("long").alias("n"))


# lexical search


@query
def lexical_overlap(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("_t", T.terms(F.col("query"))).select("query_id", F.size("_t").alias("_n"), F.explode("_t").alias("term"))
    d = corpus(spark, sf_dir).select("seq", F.explode(T.terms(F.col("text"))).alias("term"))
    hits = q.join(d, "term").groupBy("query_id", "seq").agg(T.rounded(F.count(F.lit(1)) / F.first("_n"), 9).alias("score"))
    return lexical.best(hits, 10, ["query_id"]).select("query_id", F.col("rank").cast("long").alias("rank"), "seq", "score")


@query
def bm25_term_stats(spark, sf_dir):
    return index(spark, sf_dir).terms.select("term", "df", T.rounded(F.col("idf"), 6).alias("idf"))


@query
def bm25_topk(spark, sf_dir):
    hits = lexical.top_k(index(spark, sf_dir), questions(spark, sf_dir), 10)
    return lexical.best(hits.withColumn("score", T.rounded(F.col("score"), 6)).drop("rank"), 10, ["query_id"]).select("query_id", F.col("rank").cast("long").alias("rank"), "seq", "score")


@query
def bm25_pruned_topk(spark, sf_dir):
    """The same list from blocks with stored largest weights, most of which are never read."""
    hits = blockmax.top_k(blockmax.build(corpus(spark, sf_dir)), questions(spark, sf_dir), 10)
    return lexical.best(hits.withColumn("score", T.rounded(F.col("score"), 6)).drop("rank"), 10, ["query_id"]).select("query_id", F.col("rank").cast("long").alias("rank"), "seq", "score")


@query
def bm25_topk_zero_fill(spark, sf_dir):
    q = spark.createDataFrame([(1, "zzzz-nothing"), (2, "blend"), (3, "the zzzz-nothing"), (4, "")], "query_id long, query string")
    hits = lexical.top_k(index(spark, sf_dir), q, 5)
    return lexical.best(hits.withColumn("score", T.rounded(F.col("score"), 6)).drop("rank"), 5, ["query_id"]).select("query_id", F.col("rank").cast("long").alias("rank"), "seq", "score")


@query
def structured_topk(spark, sf_dir):
    nodes = embed.hydrated(turns(spark, sf_dir))
    hits = lexical.structured(nodes, questions(spark, sf_dir), F.array(F.lit("section")), 10, ["query_id"])
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "node_id", T.rounded(F.col("score"), 9).alias("score"))


# vectors


def asked(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query
def vector_topk_l2(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return vector.top_k(v, asked(spark, sf_dir), 10, seq="vec_id", digits=6).select("query_id", F.col("rank").cast("long").alias("rank"), "seq", "dist")


@query
def vector_topk_filtered(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return vector.top_k(v, asked(spark, sf_dir), 10, F.col("label") == 1, seq="vec_id", digits=6).select("query_id", F.col("rank").cast("long").alias("rank"), "seq", "dist")


@query
def vector_join_topk(spark, sf_dir):
    """Every vector as a query against all, as a join of blocks."""
    v = read(spark, sf_dir, "embeddings")
    hits = vecjoin.Blocks.of(v, "vec_id").top_k(v.filter("embedding is not null"), 10, "vec_id", digits=6)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "seq", "dist")


@query
def vector_minmax(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    # one more than is wanted, as a query's own vector is none of its candidates
    hits = vector.top_k(v, asked(spark, sf_dir), 41, seq="vec_id", digits=6).filter("seq <> query_id").drop("rank")
    hits = lexical.best(hits, 40, ["query_id"], "dist", down=False)
    return hits.select("query_id", "seq", T.rounded(vector.scaled(vector.similarity(F.col("dist")), ["query_id"]), 6).alias("scaled"))


@query
def vector_threshold(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return vector.threshold(v, asked(spark, sf_dir), 10, 0.75, seq="vec_id", digits=6).select("query_id", "seq", "dist")


@query
def pool_mean_embedding(spark, sf_dir):
    p = embed.pooled(read(spark, sf_dir, "embeddings"), "label")
    return p.select(F.col("parent").cast("long").alias("label"), F.posexplode("embedding").alias("pos", "x"), "children").select("label", F.col("pos").cast("long").alias("pos"), T.rounded(F.col("x"), 6).alias("mean"), "children")


# fusion, merging, boosts


def pools(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    q = v.join(questions(spark, sf_dir), v["vec_id"] == F.col("query_id")).select("query_id", "embedding", "query")
    near = vector.top_k(v, q, 40, seq="vec_id", digits=6)
    words = lexical.top_k(index(spark, sf_dir), q.select("query_id", "query"), 40)
    words = lexical.best(words.withColumn("score", T.rounded(F.col("score"), 6)).drop("rank"), 40, ["query_id"])
    return near, words


@query
def fusion_full_outer(spark, sf_dir):
    near, words = pools(spark, sf_dir)
    both = fusion.fused(near, words, by=("query_id",))
    r = lambda c: T.rounded(F.col(c), 6).alias(c)
    return both.select("query_id", "seq", r("vector"), r("bm25"), r("score"))


def listed(spark, sf_dir):
    words = lexical.top_k(index(spark, sf_dir), questions(spark, sf_dir), 40).withColumn("score", T.rounded(F.col("score"), 6)).drop("rank")
    words = lexical.best(words, 40, ["query_id"]).withColumn("at", F.col("rank"))
    return words.join(corpus(spark, sf_dir), "seq").withColumn("node_type", F.lit("paragraph"))


@query
def dedupe_candidates(spark, sf_dir):
    return fusion.deduplicated(listed(spark, sf_dir)).select("query_id", "seq", "score", F.col("at").cast("long").alias("at"), "merged")


@query
def dedupe_two_keys(spark, sf_dir):
    """The turns of a conversation as candidates whose id is their role, so that one id comes with several texts, and one text under several ids."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("at"), F.col("role").alias("key"), F.substring(T.dedupe_key(F.coalesce("text", F.lit(""))), 1, 4).alias("text_key"))
    return fusion.claimed(c).select("query_id", F.col("at").cast("long").alias("at"), F.col("first").cast("long").alias("first"))


def boosts(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("node_types", F.array(F.lit("paragraph")))
    return rerank.boosted(fusion.deduplicated(listed(spark, sf_dir)).join(q, "query_id").withColumn("title", F.col("source")), PROFILE)


@query
def profile_boosts(spark, sf_dir):
    return boosts(spark, sf_dir).select("query_id", "seq", "title_boost", "type_boost", "corpus_boost", "keyword_boost", "entity_boost", "penalty", T.rounded(F.col("final_score"), 4).alias("final_score"))


@query
def rerank_topk(spark, sf_dir):
    out = rerank.ordered(boosts(spark, sf_dir).withColumn("final_score", T.rounded(F.col("final_score"), 4)))
    return out.filter("position <= 10").select("query_id", F.col("position").cast("long").alias("position"), "seq", "final_score")


# trees


@query
def tree_nodes(spark, sf_dir):
    return turns(spark, sf_dir).select("node_id", "parent_id", "doc_id", "node_type", "title", "text", F.col("order").cast("long").alias("order"), F.col("level").cast("long").alias("level"))


@query
def tree_children(spark, sf_dir):
    return parse.children(turns(spark, sf_dir)).select("parent_id", F.array_join("children", ",").alias("children"))


@query
def tree_parent_title(spark, sf_dir):
    return parse.with_parent_title(turns(spark, sf_dir)).filter("node_type = 'paragraph'").select("node_id", "parent_title")


@query
def tree_parents(spark, sf_dir):
    return parse.parents(turns(spark, sf_dir)).select("node_id", "parent_node_type", F.col("parent_level").cast("long").alias("parent_level"))


@query
def section_paths(spark, sf_dir):
    return parse.section_paths(turns(spark, sf_dir)).select("node_id", F.array_join("path", " > ").alias("path"))


@query
def derived_ancestors(spark, sf_dir):
    """Ancestors from parent links alone."""
    return parse.chains(turns(spark, sf_dir).select("node_id", "parent_id")).select("node_id", F.array_join("ancestors", ">").alias("ancestors"), "cyclic")


@query
def hydrate_without_ancestors(spark, sf_dir):
    return embed.hydrated(turns(spark, sf_dir).drop("ancestors")).filter("node_type <> 'paragraph'").select("node_id", "text")


@query
def pooled_sections(spark, sf_dir):
    """Vectors of the conversations' sections and roots: the first components, and their number."""
    out = embed.enriched(turns(spark, sf_dir).drop("ancestors"), embed.hashed).filter("node_type <> 'paragraph' and embedding is not null")
    return out.select("node_id", *[T.rounded(F.col("embedding")[i], 6).alias(f"c{i}") for i in (0, 1, 31, 32, 383)], F.size("embedding").cast("long").alias("n"))


@query
def hydrate_text(spark, sf_dir):
    return embed.hydrated(turns(spark, sf_dir)).filter("node_type <> 'paragraph'").select("node_id", "text")


@query
def tree_token_counts(spark, sf_dir):
    out = embed.enriched(turns(spark, sf_dir), lambda t: embed.hashed(t, 32))
    return out.select("node_id", F.col("token_count").cast("long").alias("token_count"), F.coalesce(F.size("embedding"), F.lit(-1)).cast("long").alias("dims"))


@query
def sibling_window_merge(spark, sf_dir):
    w = context.windows(turns(spark, sf_dir).withColumn("token_count", T.token_count(F.col("text"))))
    return w.select("node_id", "merged_text", F.array_join("merged_ids", ",").alias("merged_ids"), F.col("merged_tokens").cast("long").alias("merged_tokens"))


@query
def section_promotion(spark, sf_dir):
    nodes = embed.hydrated(turns(spark, sf_dir)).withColumn("token_count", T.token_count(F.col("text")))
    hits = nodes.filter("node_type = 'paragraph'").withColumns({"query_id": F.lit(1).cast("long"), "intent": F.lit("summary"), "node_types": F.array(F.lit("section"), F.lit("paragraph"))})
    return context.expanded(hits, nodes).select("node_id", "expansion", "packed_id", F.col("packed_tokens").cast("long").alias("packed_tokens"))


@query
def pack_context(spark, sf_dir):
    c = listed(spark, sf_dir).withColumns({"position": F.col("at"), "packed_key": T.document_key(F.col("text")), "packed_tokens": T.token_count(F.col("text"))})
    return context.packed(c, 10, 1800).select("query_id", F.col("slot").cast("long").alias("slot"), F.col("position").cast("long").alias("position"), "total_tokens", F.col("dropped").cast("long").alias("dropped"))


@query
def text_trees(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("1.1 Part "), F.col("lang"), F.lit("\n\n"), "text").alias("text"))
    return parse.plain_text(files).select("node_id", "parent_id", "node_type", "title", "text", "order", "level")


@query
def markdown_trees(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n\n"), x["text"])), "\n\n").alias("body"))
    files = c.select(F.concat(F.lit("/chats/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# Chat\n\n"), "body").alias("text"))
    return parse.markdown(files).select("node_id", "parent_id", "node_type", "title", "text", "order", "level", F.array_join("section_path", " > ").alias("section_path"))


@query
def page_trees(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.concat(F.lit("/books/"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("path"), (F.col("turn") + 1).cast("int").alias("page"), "text")
    return parse.paged(c).select("node_id", "parent_id", "node_type", "title", "text", "order", "level", "page")


@query
def node_upsert_latest(spark, sf_dir):
    nodes = turns(spark, sf_dir).select("node_id", "doc_id", "text").withColumn("v", F.lit(0).cast("long"))
    # conversations that a system message opens come in anew, twice
    opened = read(spark, sf_dir, "conversations").filter("role = 'system'").select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("doc_id")).distinct()
    picked = nodes.join(opened, "doc_id", "left_semi").select(nodes.columns)
    fresh = picked.withColumns({"text": F.concat(F.lit("new "), "text"), "v": F.lit(1).cast("long")}).unionByName(picked.withColumns({"text": F.concat(F.lit("newer "), "text"), "v": F.lit(2).cast("long")}))
    return stores.upserted(nodes, fresh, "v").select("node_id", "doc_id", "text", "v")


# chunkers


@query
def recursive_chunks(spark, sf_dir):
    return chunk.chunked(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "recursive")


@query
def token_chunks(spark, sf_dir):
    return chunk.chunked(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "token", chunk_size=100, chunk_overlap=20)


@query
def sentence_chunks(spark, sf_dir):
    return chunk.chunked(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "sentence", language="english", chunk_size=100)


@query
def sentence_statistics(spark, sf_dir):
    """Words that stand before a period, with the score that tells abbreviations."""
    words = sentences.Boundaries.learnt(spread(read(spark, sf_dir, "documents"))).words.filter("with_period > 0")
    return words.select("word", "with_period", "without", T.rounded(F.col("score"), 4).alias("score"), "abbreviation")


@query
def sentence_starters(spark, sf_dir):
    starters = sentences.Boundaries.learnt(spread(read(spark, sf_dir, "documents"))).starters
    return starters.select("word", "both", T.rounded(F.col("score"), 3).alias("score"))


# scope, plans, agents


def scoped(spark, sf_dir):
    return profile.scoped(questions(spark, sf_dir), PROFILE)


@query
def scope_routing(spark, sf_dir):
    r = evidence.routed(scoped(spark, sf_dir))
    join = lambda c: F.array_join(c, "|").alias(c)
    return r.select("query_id", join("matched_keywords"), join("matched_entities"), join("matched_non_coverage"), join("matched_forbidden"), F.col("coverage_overlap").cast("long").alias("coverage_overlap"), "out_of_scope", "reason", "route")


@query
def plan_prior(spark, sf_dir):
    p = profile.with_prior(fusion.plans(scoped(spark, sf_dir)).withColumn("node_types", F.array(F.lit("section"))))
    return p.select("query_id", F.array_join("subqueries", "|").alias("subqueries"), F.array_join("node_types", "|").alias("node_types"))


@query
def expand_queries(spark, sf_dir):
    q = scoped(spark, sf_dir).withColumn("queries", F.array("query", F.upper("query")))
    return profile.expanded(q).select("query_id", F.array_join("queries", "|").alias("queries"))


@query
def plan_defaults(spark, sf_dir):
    p = fusion.plans(questions(spark, sf_dir))
    return p.select("query_id", "intent", F.array_join("subqueries", "|").alias("subqueries"), F.array_join("node_types", "|").alias("node_types"))


@query
def fan_out_questions(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("queries", F.array("query", F.lit("second"), "query", F.lit("third"), F.lit("fourth")))
    return evidence.fan_out(q.select("query_id", "queries")).withColumn("question_index", F.col("question_index").cast("long"))


@query
def history_window(spark, sf_dir):
    return history.window(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.col("recency").cast("long").alias("recency"))


@query
def history_transcript(spark, sf_dir):
    return history.transcript(history.window(read(spark, sf_dir, "conversations")))


@query
def accumulate_or_reset(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("reset", F.col("role") == "system")
    return history.accumulated(c, "conv_id", "turn").select("conv_id", "turn", "text")


@query
def reduce_keys_and_counts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("n_chars", F.length("text").cast("long"))
    r = history.reduced(c, "conv_id", "role", ["n_chars"])
    return r.select("conv_id", F.array_join("role", ",").alias("roles"), "n_chars")


@query
def last_assistant_answer(spark, sf_dir):
    return evidence.last_answer(read(spark, sf_dir, "conversations"))


def proof(spark, sf_dir):
    hits = listed(spark, sf_dir).filter("at <= 8").withColumns({"subquery": F.concat(F.lit("part "), (F.col("at") % 2).cast("string")), "slot": F.col("at").cast("long")})
    return evidence.items(hits.withColumn("doc_id", F.col("seq").cast("string")).withColumn("node_id", F.concat(F.lit("n"), F.col("seq").cast("string"))))


@query
def evidence_items(spark, sf_dir):
    return proof(spark, sf_dir).select("query_id", "slot", "subquery", "doc_id", "node_id", "source", "quote", "score")


@query
def fanout_fanin_evidence(spark, sf_dir):
    f = evidence.fan_in(proof(spark, sf_dir))
    return f.select("query_id", "n_groups", "n_evidence", "answer", "reasoning_summary", T.rounded(F.col("confidence"), 6).alias("confidence"), "limitations", F.array_join(F.transform("evidence", lambda x: x["node_id"]), ",").alias("evidence"))


@query
def grounded_answer(spark, sf_dir):
    return render.grounded(evidence.fan_in(proof(spark, sf_dir)))


@query
def citations_grouped(spark, sf_dir):
    return render.citations(proof(spark, sf_dir))


@query
def retrieval_answer_snippets(spark, sf_dir):
    hits = listed(spark, sf_dir).filter("at <= 10").withColumnRenamed("at", "slot")
    return render.snippets(hits).withColumn("at", F.col("at").cast("long"))


@query
def retrieval_only_answer(spark, sf_dir):
    hits = listed(spark, sf_dir).filter("at <= 10").withColumnRenamed("at", "slot").withColumn("source", F.concat("source", F.lit(".txt")))
    return render.retrieval_only(questions(spark, sf_dir), hits)


@query
def out_of_scope_answer(spark, sf_dir):
    return render.out_of_scope(scoped(spark, sf_dir).withColumn("boundary", F.lit(PROFILE.coverage)))


# the agent


@query
def search_tool(spark, sf_dir):
    c = listed(spark, sf_dir).withColumns({"position": F.col("at"), "packed_key": T.document_key(F.col("text")), "packed_text": F.col("text"), "packed_tokens": T.token_count(F.col("text"))})
    return agent.search_tool(context.packed(c, 10, 1800).join(c, ["query_id", "position"]))


@query
def guardrails(spark, sf_dir):
    """Branches whose conversation has too many turns, or asks for too many tools (a call for each 400 characters), fall back."""
    c = read(spark, sf_dir, "conversations").withColumn("tool_calls", (F.length("text") / 400).cast("long"))
    answers = evidence.last_answer(c)
    return agent.limited(answers, c, ["conv_id"]).select("conv_id", "answer", F.col("iterations").cast("long").alias("iterations"), F.col("tool_calls").cast("long").alias("tool_calls"), "stopped")


@query
def history_summary(spark, sf_dir):
    return agent.summarised(read(spark, sf_dir, "conversations"), agent.Bounds(max_context_tokens=150))


@query
def task_prompts(spark, sf_dir):
    return agent.prompts(questions(spark, sf_dir), PROFILE)


@query
def research_answers(spark, sf_dir):
    """Every question to its answer: scope, route (one in seven is taken for a direct answer), evidence, fan-in."""
    asked = scoped(spark, sf_dir).withColumns({"boundary": F.lit(PROFILE.coverage), "decision": F.when(F.col("query_id") % 7 == 3, "direct_answer")})
    return agent.answered(evidence.routed(asked, "decision"), evidence.fan_in(proof(spark, sf_dir)))


def rounds(spark, sf_dir):
    asked = questions(spark, sf_dir).select("query_id", F.lit(0).alias("question_index"), F.col("query").alias("question"))
    search = research.lexical_search(index(spark, sf_dir), corpus(spark, sf_dir).select("seq", "source"), 5)
    return research.researched(asked, search, research.narrowing(), agent.Bounds(max_tool_calls=4))


@query
def research_rounds(spark, sf_dir):
    """Every question searched anew by its first half as long as that finds something, four times at most."""
    steps, _ = rounds(spark, sf_dir)
    return steps.select("query_id", F.col("round").cast("long").alias("round"), "found", "new", "ask", "stopped")


@query
def research_evidence(spark, sf_dir):
    _, evidence = rounds(spark, sf_dir)
    return evidence.select("query_id", F.col("round").cast("long").alias("round"), F.col("slot").cast("long").alias("slot"), "seq", "source")


@query
def candidate_counts(spark, sf_dir):
    near, words = pools(spark, sf_dir)
    both = fusion.fused(near, words, by=("query_id",)).select("query_id", F.lit(0).alias("sub"), F.lit(0).alias("stage"))
    nodes = embed.hydrated(turns(spark, sf_dir))
    found = lexical.structured(nodes, questions(spark, sf_dir), F.array(F.lit("section")), 10, ["query_id"]).select("query_id", F.lit(0).alias("sub"), F.lit(1).alias("stage"))
    n = retrieve.counts(both.unionByName(found))
    return n.select("query_id", "raw_candidates", F.col("structured_candidates")[0].alias("structured"))


@query
def debug_top_rows(spark, sf_dir):
    out = rerank.ordered(boosts(spark, sf_dir).withColumn("final_score", T.rounded(F.col("final_score"), 4)))
    return rerank.debug_rows(out).withColumn("position", F.col("position").cast("long"))


@query
def scorer_rerank(spark, sf_dir):
    """A scorer that prefers long texts, on the first ten of each query."""
    out = rerank.ordered(boosts(spark, sf_dir).withColumn("final_score", T.rounded(F.col("final_score"), 4)))
    done = rerank.cross_encoded(out, lambda q, texts: [float(len(t)) for t in texts], 10)
    return done.filter("position <= 20").select("query_id", F.col("position").cast("long").alias("position"), "seq", "scorer_boost")


# stores and scans


@query
def loader_kinds(spark, sf_dir):
    p = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in.box/"), "source", F.element_at(F.array(*map(F.lit, (".md", ".TXT", ".Pdf", ".png", ""))), (F.col("doc_id") % 5 + 1).cast("int"))).alias("path"))
    return p.select("doc_id", T.suffix(F.col("path")).alias("suffix"), scans.kind(F.col("path")).alias("kind"))


@query
def profile_lists(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.profile_list(F.regexp_replace("text", "[.,]", ";")), "|").alias("entries"))


@query
def leaf_passages(spark, sf_dir):
    leaves = parse.leaf_documents(turns(spark, sf_dir))
    return leaves.select("node_id", "doc_id", "parent_title", "text", T.is_blank(F.col("text")).alias("blank"))


@query
def tree_payloads(spark, sf_dir):
    trees = stores.trees(turns(spark, sf_dir))
    return trees.select("doc_id", "root_id", F.size("nodes").cast("long").alias("n"), F.array_join(F.transform("nodes", lambda x: x["node_id"]), ",").alias("ids"))


@query
def vector_store_search(spark, sf_dir):
    """Vectors appended in two parts, then searched where they are stored."""
    store = stores.store("vector", "parquet", spark, shared_path(spark, "vectors"))
    v = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "seq")
    store.append(v.filter("label < 5"))
    store.append(v.filter("label >= 5 or label is null"))
    hits = vector.top_k(store.rows(), asked(spark, sf_dir), 10, digits=6)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "seq", "dist")


@query
def postings_store_search(spark, sf_dir):
    """An index written, read back and asked."""
    store = stores.store("lexical", "bm25", spark, shared_path(spark, "postings"))
    store.rebuild(corpus(spark, sf_dir))
    hits = store.search(questions(spark, sf_dir), 10)
    return lexical.best(hits.withColumn("score", T.rounded(F.col("score"), 6)).drop("rank"), 10, ["query_id"]).select("query_id", F.col("rank").cast("long").alias("rank"), "seq", "score")


@query
def node_store_upsert(spark, sf_dir):
    """Nodes as JSON Lines: stored, replaced document by document, read back."""
    store = stores.store("node", "json", spark, shared_path(spark, "nodes"))
    nodes = turns(spark, sf_dir)
    store.upsert(nodes)
    opened = read(spark, sf_dir, "conversations").filter("role = 'system'").select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("doc_id")).distinct()
    store.upsert(nodes.join(opened, "doc_id", "left_semi").select(nodes.columns).withColumn("text", F.concat(F.lit("new "), "text")))
    return store.nodes().select("node_id", "parent_id", "doc_id", "text", F.col("order").cast("long").alias("order"))


@query
def incremental_postings(spark, sf_dir):
    """Documents that a stream of files brings, indexed as they come."""
    base = shared_path(spark, "stream")
    docs = corpus(spark, sf_dir).select("seq", "text")
    docs.repartition(max(3, docs.rdd.getNumPartitions())).write.parquet(f"{base}/in")
    session.ingest(spark, f"{base}/in", f"{base}/postings", f"{base}/state").awaitTermination()
    return session.index_of(spark, f"{base}/postings").terms.select("term", "df", T.rounded(F.col("idf"), 6).alias("idf"))


# the whole path


@query
def hybrid_retrieve(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's queries against all documents: fused pools, merged, boosted, packed."""
    docs = corpus(spark, sf_dir).withColumn("node_id", F.concat(F.lit("d"), F.col("seq").cast("string"))).withColumn("node_type", F.lit("paragraph"))
    out = retrieve.retrieve(retrieve.Corpus.of(docs), questions(spark, sf_dir), profile=PROFILE)
    return out.select("query_id", "slot", "seq", T.rounded(F.col("final_score"), 6).alias("final_score"), "packed_tokens", "total_tokens", "dropped")


@query
def hybrid_tree_retrieve(spark, sf_dir):
    # the trees are a table, read several times
    nodes = written(embed.hydrated(turns(spark, sf_dir)).withColumn("token_count", T.token_count(F.col("text"))), "trees")
    passages = parse.leaf_documents(nodes).withColumn("source", F.col("doc_id"))
    q = questions(spark, sf_dir).withColumns({"intent": F.lit("summary"), "node_types": F.array(F.lit("section"), F.lit("paragraph"))})
    out = retrieve.retrieve(retrieve.Corpus.of(passages, nodes=nodes.withColumn("source", F.col("doc_id"))), q)
    return out.select("query_id", "slot", "packed_id", "expansion", T.rounded(F.col("final_score"), 6).alias("final_score"), "packed_tokens", "total_tokens")
