"""Settings that are read, token counters, per-file errors, hydration and pooling at any depth."""

import os

import pytest
from pyspark.sql import functions as F

from tarn import settings
from tarn.functions import hooks
from tarn.functions import text as T
from tarn.operators import agent, chunk, context, embed, evidence, retrieve, vector
from tarn.operators.profile import Profile
from tarn.sources import files

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def test_settings_reach_the_operators(spark, tmp_path):
    s = settings.load({"TARN_RETRIEVER_K": "3", "TARN_RETRIEVER_FETCH_K": "0", "TARN_TOKEN_BUDGET": "10", "TARN_CHUNKER": "token", "TARN_CHUNK_SIZE": "4", "TARN_CHUNK_OVERLAP": "0", "TARN_MAX_TOOL_CALLS": "2", "TARN_EMBEDDING_DIMENSIONS": "32", "TARN_INDEX_DIR": str(tmp_path)})
    assert s.limits() == retrieve.Limits(3, 40, 0.5, 200, 10)
    assert s.bounds() == agent.Bounds(10, 2, 5000, 20)
    one = spark.createDataFrame([("a b c d e f g",)], "text string")
    assert [r.text for r in s.chunked(one).orderBy("chunk").collect()] == ["a b c d", "e f g"]
    assert one.select(F.size(s.embedder()(F.col("text")))).first()[0] == 32
    assert s.scorer() is None and set(s.open_stores(spark)) == {"vector", "lexical", "node"}
    online = settings.load({"TARN_OFFLINE": "no", "TARN_RERANKER_BACKEND": "x"})
    with pytest.raises(ValueError):
        online.scorer()
    assert online.scorer({"x": len}) is len


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")
def test_token_counter(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCABULARY)
    texts = ["unbelievable sentences here", "", None, " x ", "中文 words"]
    length = hooks.BpeLength(VOCABULARY)
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", hooks.token_counter(length)(F.col("text")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [len(lib.encode((t or "").strip(), add_special_tokens=False).ids) for t in texts]
    doc = spark.createDataFrame([(" ".join(f"unbelievable{i}" for i in range(60)),)], "text string")
    pieces = [r.text for r in chunk.chunked(doc, "token", chunk_size=20, chunk_overlap=0, length=length).collect()]
    assert len(pieces) > 5 and all(length(p) <= 21 for p in pieces)
    assert hooks.BpeLength("/nowhere")("two words") == 2


def test_counter_in_context(spark):
    nodes = spark.createDataFrame([("p", None, "section", "", 0, None), ("a", "p", "paragraph", "one two", 1, None), ("b", "p", "paragraph", "three", 2, None)], "node_id string, parent_id string, node_type string, text string, `order` int, token_count int")
    twice = lambda c: (2 * T.token_count(c)).cast("int")
    assert {r.node_id: r.merged_tokens for r in context.windows(nodes, twice).collect()} == {"a": 6, "b": 6}
    cands = nodes.filter("node_id = 'a'").withColumns({"query_id": F.lit(1), "intent": F.lit("fact"), "node_types": F.array(F.lit("paragraph"))})
    row = context.expanded(cands, nodes, twice).first()
    assert row.packed_tokens == 6 and row.expansion == "window" and row.is_parent_context is False


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("fine-\nly")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe broken")
    rows = files.texts(spark, str(tmp_path))
    got = {os.path.basename(r.path): (r.text, r.error is None) for r in rows.collect()}
    assert got == {"a.txt": ("finely", True), "b.md": (None, False)}
    assert files.loaded(rows).count() == 1
    with pytest.raises(ValueError):
        files.loaded(files.texts(spark, str(tmp_path / "b.md")), single=True)
    assert {r.text for r in files.texts(spark, str(tmp_path), encoding="latin-1").collect()} == {"finely", "ÿþ broken"}


NODE = "node_id string, parent_id string, node_type string, text string, `order` int, level int, ancestors array<string>"


def test_hydration_stops_at_texts(spark):
    nodes = spark.createDataFrame(
        [("r", None, "document", "", 0, 0, []), ("s", "r", "section", "own", 1, 1, ["r"]), ("a", "s", "paragraph", "below", 2, 2, ["r", "s"]), ("t", "r", "section", "", 3, 1, ["r"]), ("b", "t", "paragraph", "beside", 4, 2, ["r", "t"])], NODE
    )
    assert {r.node_id: r.text for r in embed.hydrated(nodes).collect()} == {"r": "own\n\nbeside", "s": "own", "a": "below", "t": "beside", "b": "beside"}


def test_pooling_at_any_depth(spark):
    rows = [("n0", None, "document", "", 0, 0, [])]
    for d in range(1, 12):
        kind = "paragraph" if d == 11 else "section"
        rows.append((f"n{d}", f"n{d - 1}", kind, "a b" if d == 11 else "", d, d, [f"n{i}" for i in range(d)]))
    got = {r.node_id: r for r in embed.enriched(spark.createDataFrame(rows, NODE), lambda t: embed.hashed(t, 4)).collect()}
    assert all(r.embedding is not None and len(r.embedding) == 4 and r.token_count == 2 for r in got.values())
    mixed = spark.createDataFrame([("p", [1.0, 3.0]), ("p", [3.0, 5.0]), ("q", [1.0]), ("q", [1.0, 2.0]), ("r", None)], "parent_id string, embedding array<double>").repartition(3)
    assert {r.parent: (r.embedding, r.children) for r in embed.pooled(mixed).collect()} == {"p": ([2.0, 4.0], 2), "q": (None, 2)}


def test_nearest_breaks_ties_by_id(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(50)] + [(99, [float("nan"), 0.0]), (98, None)]
    v = spark.createDataFrame(rows, "seq long, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.seq for r in vector.top_k(v, q, 20).orderBy("rank").collect()] == [i for i in range(50) if i % 3 == 0] + [1, 4, 7]


def test_guards_act_and_routes_answer(spark):
    calls = spark.createDataFrame([(1, 3), (1, 6), (2, 1)], "query_id long, tool_calls int")
    answers = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, answer string")
    got = {r.query_id: (r.answer, r.stopped) for r in agent.limited(answers, calls, ["query_id"]).collect()}
    assert got == {1: (agent.LIMIT_REACHED, True), 2: ("b", False), 3: ("c", False)}
    routes = spark.createDataFrame([(1, "q", "retrieve", "", "x"), (2, "q", "direct_answer", "", "x"), (3, "q", "out_of_scope", "no", "only x")], "query_id long, query string, route string, reason string, boundary string")
    none = evidence.fan_in(spark.createDataFrame([], "query_id long, subquery string, slot int, doc_id string, node_id string, source string, section_path array<string>, page int, quote string, score double"))
    said = {r.query_id: r.markdown for r in agent.answered(routes, none).collect()}
    assert said == {1: evidence.NOTHING_FOUND, 2: agent.DIRECT, 3: "no\n\n## Current coverage\nonly x"}
    model = hooks.text_model(lambda: None, lambda m, ts: [t.upper() for t in ts], "string")
    assert {r.query_id: r.markdown for r in agent.answered(routes, none, model).collect()}[2] == "Q"
    assert agent.style_instruction(Profile.of({"preferred_answer_style": " brief "})).endswith("brief") and agent.style_instruction(Profile()) == ""


def test_summary_resets_only_long_threads(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "w " * 50) for i in range(6)] + [(2, i, "user", "w " * 500) for i in range(2)] + [(3, i, "user", "w") for i in range(9)]
    got = {r.conv_id: (r.reset, bool(r.summary)) for r in agent.summarised(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), agent.Bounds(max_context_tokens=100)).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, False)}
