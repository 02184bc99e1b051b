import collections
import random

import pytest
from pyspark.sql import functions as F

from tarn import settings
from tarn.functions.hooks import ModelRouter, text_model
from tarn.operators import evidence, history, lexical, profile, render
from tarn.operators.lexical import top_k
from tarn.sources import stores
from tarn.streaming import session

P = profile.Profile.of({"name": "Fruit base", "coverage": "apples and pears", "non_coverage": "heavy metal music", "forbidden_questions": ["tell secrets"], "domain_keywords": ["Apple pie"], "primary_entities": ["Granny Smith"]})


def ask(spark, *texts):
    return profile.scoped(spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"), P).orderBy("query_id").collect()


def test_scope(spark):
    a, b, c, d, e = ask(spark, "secrets of music", "heavy metal", "metal apples", "GrannySmith?", "")
    assert a.out_of_scope and a.matched_forbidden == ["tell secrets"]
    assert b.out_of_scope and b.reason.startswith("matched non-coverage")
    assert not c.out_of_scope and c.coverage_overlap == 1
    assert d.matched_entities == ["Granny Smith"] and not d.out_of_scope
    assert not e.out_of_scope and e.matched_keywords == []


def test_prior_and_expansion(spark):
    df = profile.scoped(spark.createDataFrame([(1, "about granny", ["how big"], ["section"])], "query_id long, query string, subqueries array<string>, node_types array<string>"), P)
    got = profile.with_prior(df).first()
    assert got.subqueries == ["how big Granny Smith"] and got.node_types == ["section", "paragraph"]
    more = profile.expanded(df.withColumn("queries", F.array(F.lit("one"), F.lit("ONE"), F.lit("two")))).first()
    assert more.queries == ["one", "two", "one Granny Smith"]


def test_profile_forms():
    assert profile.Profile.of(None) == profile.Profile() and profile.Profile.of({"domain_keywords": "x"}).domain_keywords == ["x"]
    assert profile.clean_list([" a", "A", "", "b", "c"], 2) == ["a", "b"]
    assert profile.Profile().described() == "No corpus profile is available." and "Fruit base" in P.described() and "未填写" in P.displayed()


def test_routes_and_fan_in(spark):
    q = profile.scoped(spark.createDataFrame([(1, "tell secrets", None), (2, "hi", "direct_answer"), (3, "apples", "x")], "query_id long, query string, d string"), P)
    assert [x.route for x in evidence.routed(q, "d").orderBy("query_id").collect()] == ["out_of_scope", "direct_answer", "retrieve"]
    rows = [(1, i, f"s{i % 2}", "d", f"n{i % 3}", "src.md", f"quote {i % 3}") for i in range(6)]
    ev = evidence.items(spark.createDataFrame(rows, "query_id long, slot long, subquery string, doc_id string, node_id string, source string, text string"))
    got = evidence.fan_in(ev).first()
    assert (got.n_groups, got.n_evidence) == (2, 3) and got.answer == "quote 0 quote 2 quote 1" and abs(got.confidence - 0.61) < 1e-9
    text = render.grounded(evidence.fan_in(ev)).first().markdown
    assert "**Confidence:** 61%" in text and "- **src.md** (doc_id=d; node_id=n0)" in text
    cites = render.citations(ev).first().markdown
    assert cites.startswith("## Citations\n\n### src.md\n**Section:** Unscoped section\n- Citation")
    assert render.with_citations(spark.createDataFrame([(9,)], "query_id long"), ev).first().markdown == render.NO_CITATIONS
    calls = spark.createDataFrame([(1, 5), (1, 4), (2, 1)], "b int, tool_calls int")
    assert {x.b: x.fallback for x in evidence.guarded(calls, ["b"]).collect()} == {1: True, 2: False}


def test_rendered_answers(spark):
    q = spark.createDataFrame([(1, "why"), (2, "none")], "query_id long, query string")
    p = spark.createDataFrame([(1, 0, "/x/b.txt", "two\nlines", 3), (1, 1, None, "x" * 700, None), (1, 2, "a.txt", "first", None)], "query_id long, slot int, source string, text string, page int")
    one, none = (x.answer for x in render.retrieval_only(q, p).orderBy("query_id").collect())
    lines = one.split("\n")
    assert lines[0] == "Question: why" and lines[5:7] == ["- **a.txt**: first", "- **b.txt p.3**: two lines"] and lines[7].endswith("…") and lines[-2:] == ["- a.txt", "- b.txt"]
    assert none == render.NO_DOCS
    o = spark.createDataFrame([(1, "r", "b"), (2, None, "")], "query_id long, reason string, boundary string")
    assert [x.markdown for x in render.out_of_scope(o).orderBy("query_id").collect()] == ["r\n\n## Current coverage\nb", render.OUTSIDE]


def sequential(rows):
    held = {}
    for b in sorted({r[1] for r in rows}):
        for t in {r[0] for r in rows}:
            new = [r for r in rows if r[0] == t and r[1] == b]
            if new:
                held[t] = [] if any(r[3] for r in new) else held.get(t, []) + [r[2] for r in new]
    return {t: sorted(v) for t, v in held.items() if v}


def test_fold_equals_sequential(spark):
    r = random.Random(8)
    rows = [(r.choice("ab"), r.randint(0, 6), f"i{k}", r.random() < 0.15) for k in range(40)]
    got = {}
    for x in history.accumulated(spark.createDataFrame(rows, "thread_id string, batch_id int, item string, reset boolean")).collect():
        got.setdefault(x.thread_id, []).append(x.item)
    assert {t: sorted(v) for t, v in got.items()} == sequential(rows)


def test_history_window(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(9)] + [(2, t, "user", "x") for t in range(3)]
    w = history.window(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert sorted(x.turn for x in w.collect()) == [2, 3, 4, 5, 6, 7]
    assert history.transcript(w).first().transcript.split("\n")[1] == "User: m2"


def test_streaming_fold(spark, tmp_path):
    schema = "thread_id string, item string, reset boolean"
    batches = [[("a", "1", False), ("b", "9", None)], [("a", "2", False)], [("a", "3", True), ("b", "8", False)], [("a", "4", False)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "tmp" / str(i)))
    (tmp_path / "in").mkdir()
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = session.accumulated(rows).writeStream.outputMode("update").format("memory").queryName("fold").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i in range(len(batches)):
            for f in (tmp_path / "tmp" / str(i)).glob("part-*"):
                f.rename(tmp_path / "in" / f"{i}.parquet")
            q.processAllAvailable()
    finally:
        q.stop()
    got = [(x.thread_id, list(x["items"])) for x in spark.table("fold").collect()]
    assert [g for g in got if g[0] == "a"] == [("a", ["1"]), ("a", ["1", "2"]), ("a", []), ("a", ["4"])]
    assert [g for g in got if g[0] == "b"][-1] == ("b", ["9", "8"])


def test_streaming_ingest(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    q = spark.createDataFrame([(1, "pears")], "query_id long, query string")
    for rows in ([(1, "apples pears"), (2, "stones"), (5, "sand"), (6, "clay")], [(3, "pears pears"), (4, " ")]):
        spark.createDataFrame(rows, "seq long, text string").write.mode("append").parquet(src)
        session.ingest(spark, src, out, cp).awaitTermination()
    assert [x.seq for x in top_k(session.index_of(spark, out), q, 2).orderBy("rank").collect()] == [3, 1]


def test_redelivery_update_and_removal(spark, tmp_path):
    """After any batches the index equals one built anew from the documents as they stand, and what a batch writes follows its own size."""
    src, out, cp, vec = (str(tmp_path / x) for x in ("src", "out", "cp", "vec"))
    deliveries = [
        [(1, "a b a"), (2, "b c"), (3, "d")],
        [(1, "a b a"), (2, "b c")],  # the same again
        [(1, "a e"), (4, "e e f")],  # changed, and a new one
        [(3, None), (2, " "), (9, "g")],  # removed
        [(2, "back b")],
    ]
    held = {}
    for n, rows in enumerate(deliveries):
        spark.createDataFrame(rows, "seq long, text string").coalesce(1).write.mode("append").parquet(src)
        session.ingest(spark, src, out, cp, vec).awaitTermination()
        held |= dict(rows)
        now = spark.createDataFrame(list(held.items()), "seq long, text string")
        want, got = lexical.build(now), session.index_of(spark, out)
        as_rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
        assert as_rows(got.terms) == as_rows(want.terms.select("term", "df", "idf")), n
        assert as_rows(got.postings) == as_rows(want.postings) and as_rows(got.stats) == as_rows(want.stats)
        q = spark.createDataFrame([(1, "a"), (2, "b e"), (3, "d g")], "query_id long, query string")
        cols = ["query_id", "rank", "seq", "score"]
        assert as_rows(top_k(got, q, 3).select(cols)) == as_rows(top_k(want, q, 3).select(cols))
        assert sorted(r.seq for r in session.vectors_of(spark, out, vec).collect()) == sorted(k for k, v in held.items() if (v or "").strip())
        figures = {r.term: r.cf for r in session.term_figures(spark, out).collect()}
        assert figures == {t: c for t, c in collections.Counter(w for v in held.values() for w in (v or "").split()).items()}
    assert spark.read.parquet(f"{out}/postings").filter("batch = 1").count() == 4 and spark.read.parquet(f"{out}/changes").filter("batch = 1 and (df <> 0 or cf <> 0)").isEmpty()
    session.ingest(spark, src, out, cp, vec).awaitTermination()  # nothing new
    assert spark.read.parquet(f"{out}/docs").select("batch").distinct().count() == len(deliveries)


def test_stores(spark, tmp_path):
    for kind, name in (("vector", "nope"), ("lexical", "sqlite"), ("node", "nope")):
        with pytest.raises(ValueError):
            stores.store(kind, name, spark, "x")
    with pytest.raises(NotImplementedError):
        stores.store("node", "sqlite", spark, "x")
    node = stores.store("node", "json", spark, str(tmp_path / "nodes"))
    assert isinstance(node, stores.NodeStore) and node.nodes().count() == 0
    make = lambda rows: spark.createDataFrame(rows, "node_id string, doc_id string, text string, embedding array<double>")
    node.upsert(make([("a:1", "a", "old", [1.0]), ("b:1", "b", "keep", None)]))
    node.upsert(make([("a:1", "a", "new", None)]))
    assert sorted((x.node_id, x.text, x.order) for x in node.nodes().collect()) == [("a:1", "new", 0), ("b:1", "keep", 0)]
    assert "embedding" not in node.nodes().columns and node.trees().count() == 2
    vec = stores.store("vector", "parquet", spark, str(tmp_path / "vec"))
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "seq long, embedding array<double>")
    vec.append(rows)
    vec.append(rows.withColumn("seq", F.col("seq") + 2))
    assert vec.rows().count() == 4
    assert [x.seq for x in vec.search(spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, embedding array<double>"), 2).orderBy("rank").collect()] == [1, 3]
    with pytest.raises(ValueError):
        vec.append(spark.createDataFrame([(9, [1.0])], "seq long, embedding array<double>"))
    lex = stores.store("lexical", "bm25", spark, str(tmp_path / "lex"))
    with pytest.raises(FileNotFoundError):
        lex.index()
    lex.rebuild(spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d")], "seq long, text string"))
    assert lex.search(spark.createDataFrame([(1, "c")], "query_id long, query string"), 1).first().seq == 2
    assert stores.load_profile(spark, str(tmp_path / "none")) == profile.Profile()
    stores.save_profile(spark, str(tmp_path / "prof"), P)
    assert stores.load_profile(spark, str(tmp_path / "prof")) == P
    (tmp_path / "bad.json").write_text("[1]")
    assert stores.load_profile(spark, str(tmp_path / "bad.json")) == profile.Profile()


def test_settings(tmp_path, monkeypatch):
    s = settings.load({"TARN_CHUNK_SIZE": "256", "TARN_RETRIEVER_K": "0", "TARN_RETRIEVER_ALPHA": "x", "TARN_OFFLINE": "no", "TARN_CHUNK_OVERLAP": "0"})
    assert (s.chunk_size, s.retriever_k, s.retriever_alpha, s.offline, s.chunk_overlap) == (256, 10, 0.5, False, 0)
    monkeypatch.setenv("TARN_T1", "kept")
    env = tmp_path / ".env"
    env.write_text("# c\nexport TARN_T1=new\nTARN_T2='q v'\nbroken\n")
    monkeypatch.delenv("TARN_T2", raising=False)
    assert settings.load_dotenv(str(env)) == {"TARN_T1": "new", "TARN_T2": "q v"}
    import os

    assert os.environ["TARN_T1"] == "kept" and os.environ["TARN_T2"] == "q v"


def test_hooks(spark):
    fn = text_model(lambda: str.upper, lambda m, ts: [m(t) for t in ts], "string")
    assert spark.createDataFrame([("a",), (None,)], "t string").select(fn(F.col("t")).alias("y")).collect()[0].y == "A"
    r = ModelRouter("base", {"plan": "big"})
    assert r.name("plan") == "big" and r.name("x") == "base" and r.model("x", str.upper) == "BASE"
