import math
import random

import numpy as np
from pyspark.sql import functions as F

import pytest

from tarn.operators import context, embed, fusion, lexical, profile, rerank, retrieve, vector
from tarn.sources import lineage


def test_bm25_against_formula(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 2) for _ in range(r.randint(1, 12)))) for i in range(40)] + [(40, " "), (41, None)]
    queries = [(1, "aa b b zz"), (2, "zz"), (3, "")]
    index = lexical.build(spark.createDataFrame(docs, "seq long, text string"))
    got = {(x.query_id, x["rank"]): (x.seq, x.score) for x in lexical.top_k(index, spark.createDataFrame(queries, "query_id long, query string"), 7).collect()}
    kept = [(i, t.split()) for i, t in docs if t and t.strip()]
    n, avg = len(kept), sum(len(t) for _, t in kept) / len(kept)
    df = {}
    for _, t in kept:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    for q, text in queries:
        scores = []
        for i, t in kept:
            s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split() if w in t)
            scores.append((-round(s, 9), i))
        for rank, (s, i) in enumerate(sorted(scores)[:7], 1):
            assert got[q, rank][0] == i and math.isclose(got[q, rank][1], -s, abs_tol=1e-8)


def test_empty_lexical(spark):
    index = lexical.build(spark.createDataFrame([], "seq long, text string"))
    assert lexical.top_k(index, spark.createDataFrame([(1, "a")], "query_id long, query string"), 3).collect() == []


def test_vector_search(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(50, 4)).round(1)
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)] + [(50, None, 0), (51, [float("nan")] * 4, 0), (52, [1.0], 0)]
    df = spark.createDataFrame(rows, "seq long, embedding array<double>, label int")
    q = spark.createDataFrame([(7, v[3].tolist())], "query_id long, embedding array<double>")
    want = sorted((round(float(((x - v[3]) ** 2).sum()), 9), i) for i, x in enumerate(v))
    assert [x.seq for x in vector.top_k(df, q, 5).orderBy("rank").collect()] == [i for _, i in want[:5]]
    odd = [i for _, i in want if i % 2][:5]
    assert [x.seq for x in vector.top_k(df, q, 5, F.col("label") == 1).orderBy("rank").collect()] == odd
    assert vector.top_k(df, q.limit(0), 5).collect() == []
    mmr = vector.maximal_marginal(vector.top_k(df, q, 20), df, 4).orderBy("rank").collect()
    assert len(mmr) == 4 and mmr[0].seq == 3


def test_hashed_embedding(spark):
    import hashlib

    text = "naïve 中文"
    raw = b"".join(hashlib.sha256(text.encode() + i.to_bytes(4, "little")).digest() for i in range(2))
    got = spark.createDataFrame([(text,)], "t string").select(embed.hashed(F.col("t"), 40).alias("v")).first()["v"]
    assert got == [b / 255 for b in raw[:40]]


def sequential_merge(rows):
    """rows (text key, score) in order to [(first place, max score)]."""
    out = {}
    for i, (t, s) in enumerate(rows):
        first, best = out.get(t, (i, s))
        out[t] = (first, max(best, s))
    return sorted(out.values())


def test_dedupe_equals_sequential(spark):
    r = random.Random(5)
    rows = [(r.choice(["a b", "A  B", "c", "d "]), round(r.random(), 3)) for _ in range(30)]
    df = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(rows)], "query_id long, at int, text string, score double")
    got = sorted((x["at"], x["score"]) for x in fusion.deduplicated(df).collect())
    assert got == sequential_merge([(" ".join(t.split()).lower(), s) for t, s in rows])


def sequential_two_keys(rows):
    """rows (id, text) in order to the place that each one is merged into."""
    kept, texts, out = {}, {}, []
    for i, (key, text) in enumerate(rows):
        owner = texts.get(text)
        if owner is not None and owner != key:
            out.append(kept[owner])
        elif key in kept:
            out.append(kept[key])
        else:
            kept[key], texts[text] = i, key
            out.append(i)
    return out


def test_two_keys_equal_sequential(spark):
    """Ids that come with several texts, texts that come under several ids, blank ids."""
    r = random.Random(6)
    rows = {q: [(r.choice(["a", "b", "c", "d", "e"]), r.choice(["one", "two", "three", "four"])) for _ in range(r.randint(1, 25))] for q in range(20)}
    df = spark.createDataFrame([(q, i, k, t) for q, x in rows.items() for i, (k, t) in enumerate(x)], "query_id long, at int, key string, text_key string").repartition(3)
    got = {(x.query_id, x.at): x["first"] for x in fusion.claimed(df).collect()}
    assert got == {(q, i): f for q, x in rows.items() for i, f in enumerate(sequential_two_keys(x))}
    named = [(1, 0, "n1", "Same text", 0.5, 0.1, None), (1, 1, "n2", "same  TEXT", 0.9, None, 0.3), (1, 2, "n1", "other", 0.2, 0.7, None), (1, 3, "n3", "other", 0.1, None, None), (1, 4, " ", "alone", 0.3, None, None)]
    out = fusion.deduplicated(spark.createDataFrame(named, "query_id long, at int, node_id string, text string, score double, vector double, bm25 double")).orderBy("at").collect()
    assert [(x["at"], x.node_id, x.text, x.score, x.vector, x.bm25, x.merged) for x in out] == [(0, "n1", "Same text", 0.9, 0.7, 0.3, 3), (3, "n3", "other", 0.1, None, None, 1), (4, " ", "alone", 0.3, None, None, 1)]


def sequential_pack(rows, k, budget):
    taken, keys, total = [], set(), 0
    for pos, key, tokens in rows:
        if key in keys or (taken and total + tokens > budget):
            continue
        taken.append(pos)
        keys.add(key)
        total += tokens
        if len(taken) == k:
            break
    return taken, total


def test_packing_equals_sequential(spark):
    r = random.Random(9)
    cases = {q: [(p, r.choice("abcdefgh"), r.randint(1, 900)) for p in range(1, r.randint(2, 30))] for q in range(40)}
    df = spark.createDataFrame([(q, *x) for q, xs in cases.items() for x in xs], "query_id long, position int, packed_key string, packed_tokens int")
    got = {}
    for x in context.packed(df, 4, 1000).orderBy("query_id", "slot").collect():
        got.setdefault(x.query_id, ([], x.total_tokens))[0].append(x.position)
    for q, xs in cases.items():
        assert got[q] == sequential_pack(xs, 4, 1000)


def tree(spark):
    rows = [("r", None, "document", "Doc", "", 0, 0, []), ("s", "r", "section", "Sect", "one\n\ntwo\n\nthree", 0, 1, ["r"])]
    rows += [(f"p{i}", "s", "paragraph", None, t, i, 2, ["r", "s"]) for i, t in enumerate(["one", "two", "three"])]
    return spark.createDataFrame([(*x, 10) for x in rows], "node_id string, parent_id string, node_type string, title string, text string, `order` int, level int, ancestors array<string>, token_count int")


def test_expansion(spark):
    nodes = tree(spark)
    hit = nodes.filter("node_id = 'p0'").withColumns({"query_id": F.lit(1), "intent": F.lit("fact"), "node_types": F.array(F.lit("paragraph"))})
    got = context.expanded(hit, nodes).first()
    assert (got.expansion, got.packed_text, got.merged_ids, got.packed_tokens) == ("window", "one\n\ntwo", ["p0", "p1"], 20)
    plan = hit.withColumns({"intent": F.lit("summary"), "node_types": F.array(F.lit("section"), F.lit("paragraph"))})
    got = context.expanded(plan, nodes).first()
    assert (got.expansion, got.packed_id) == ("section", "s")


def test_boosts(spark):
    p = profile.Profile.of({"domain_keywords": ["alpha"], "primary_entities": ["Beta"], "non_coverage": "gamma"})
    rows = [(1, 1, "about alpha and beta", 0.2, "query"), (1, 2, "about gamma", 0.2, "query")]
    df = spark.createDataFrame(rows, "query_id long, at int, text string, score double, query string").withColumns({"node_type": F.lit("paragraph"), "node_types": F.array(F.lit("paragraph"))})
    a, b = rerank.ordered(rerank.boosted(df, p)).orderBy("position").collect()
    assert a["at"] == 1 and a.entity_boost > 0 and b.penalty < 0 and a.type_boost == 0.08
    flipped = rerank.cross_encoded(rerank.ordered(rerank.boosted(df, p)), lambda q, ts: [len(q) * i for i in range(len(ts))]).orderBy("position").collect()
    assert [x["at"] for x in flipped] == [2, 1] and flipped[0].scorer_boost == 1.0

    def broken(q, ts):
        raise RuntimeError

    assert [x["at"] for x in rerank.cross_encoded(rerank.ordered(rerank.boosted(df, p)), broken).orderBy("position").collect()] == [1, 2]


def test_retrieve_bounds(spark):
    docs = [(i, f"passage {i} on {w}", f"f{i}.txt") for i, w in enumerate(["apples", "pears", "apples and pears", "stones", "rivers"])]
    corpus = retrieve.Corpus.of(spark.createDataFrame(docs, "seq long, text string, source string"))
    q = spark.createDataFrame([(1, "apples"), (2, "nothing at all")], "query_id long, query string")
    out = retrieve.retrieve(corpus, q, retrieve.Limits(k=2, fetch_k=3)).collect()
    assert {(x.query_id, x.slot) for x in out} == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert retrieve.Limits(k=20, fetch_k=0).checked().fetch_k == 80 and retrieve.Limits(token_budget=1).checked().token_budget == 200


def test_retrieve_sections(spark):
    nodes = tree(spark).withColumn("source", F.lit("x"))
    passages = nodes.filter("node_type = 'paragraph'").withColumn("seq", F.col("order").cast("long"))
    q = spark.createDataFrame([(1, "two three", "summary", ["section"])], "query_id long, query string, intent string, node_types array<string>")
    out = retrieve.retrieve(retrieve.Corpus.of(passages, nodes=nodes), q).orderBy("slot").collect()
    assert out[0].packed_id == "s"


def test_bm25_pairs_stay_in_their_task(spark, tmp_path, monkeypatch):
    """What a task hands on is k rows a query, of a built index and of a stored one; larger batches, repeated and null ids give the same list by a join."""
    rows = [(i, " ".join(["the", f"w{i % 7}", f"x{i % 3}", "of"] * (1 + i % 4))) for i in range(120)] + [(None, "the w1 w1"), (200, None), (201, " ")]
    docs = spark.createDataFrame(rows, "seq long, text string").repartition(3)
    q = spark.createDataFrame([("a", 1, "the w1"), ("a", 2, "of x2 the the"), ("b", 1, "nothing"), ("b", 2, None), (None, 3, "w3")], "name string, part int, query string")
    got = lambda df: sorted(map(tuple, df.collect()), key=str)
    built = lexical.build(docs)
    want = got(lexical.best(lexical.score(built, q, ["name", "part"]), 4, ["name", "part"]).drop("rank"))
    assert len(want) == 12 and got(lexical.scored(built, q, 4, ["name", "part"])) == want
    built.write(str(tmp_path / "index"))
    assert got(lexical.scored(lexical.LexicalIndex.read(spark, str(tmp_path / "index")), q, 4, ["name", "part"])) == want
    monkeypatch.setattr(lexical, "score", lambda *a: pytest.fail("joined"))
    assert got(lexical.scored(built, q, 4, ["name", "part"])) == want
    monkeypatch.undo()
    monkeypatch.setattr(lexical, "TRAVELLING", 3)
    assert got(lexical.scored(built, q, 4, ["name", "part"])) == want
    monkeypatch.undo()
    twice = lexical.build(docs.union(docs.filter("seq < 5")))
    assert got(lexical.scored(twice, q, 4, ["name", "part"])) == got(lexical.best(lexical.score(twice, q, ["name", "part"]), 4, ["name", "part"]).drop("rank"))


def test_structured_nodes_are_found_where_they_lie(spark, monkeypatch):
    """Terms that travel find what the join finds: ties, several kinds, repeated and unknown words, a node without text."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["Élan", "straße", "camelCase"]
    rows = [(f"n{i % 7}-{i}", rng.choice(["section", "document", "table", "paragraph"]), rng.choice([None, "w1 w2", ""]), " ".join(rng.choices(words, k=rng.randrange(12))), rng.choice([None, 0, 1, 2])) for i in range(600)]
    nodes = spark.createDataFrame(rows, "node_id string, node_type string, title string, text string, `order` int").repartition(5)
    asked = [(q, s, " ".join(rng.choices([*words, "nowhere"], k=5)), rng.sample(["section", "document", "table", "none"], 2)) for q in range(12) for s in range(2)]
    q = spark.createDataFrame([*asked, (99, 0, "nowhere", ["section"]), (98, 0, "", ["section"])], "query_id long, sub int, query string, kinds array<string>")

    def run(nodes=nodes, q=q):
        return sorted(map(tuple, lexical.structured(nodes, q, F.col("kinds"), 6, ["query_id", "sub"]).collect()), key=str)

    got = run()
    monkeypatch.setattr(lexical, "PAIRS", 64)
    assert run() == got
    plan = lexical.structured(nodes, q, F.col("kinds"), 6, ["query_id", "sub"])._jdf.queryExecution().toString()
    assert "MapInArrow" in plan  # no pair of query and node is shuffled
    assert run(q=q.filter("query_id > 97")) == [] and run(nodes=nodes.limit(0)) == []
    monkeypatch.setattr(lexical, "TRAVELLING", 3)
    assert run() == got and len(got) > 100


def test_one_id_of_two_nodes_still_adds_up(spark):
    nodes = spark.createDataFrame([("a", "section", None, "x y", 0), ("a", "section", None, "y z", 0)], "node_id string, node_type string, title string, text string, `order` int")
    q = spark.createDataFrame([(1, "x y z v")], "query_id long, query string")
    assert [(r.node_id, r.score) for r in lexical.structured(nodes, q, F.array(F.lit("section")), 3, ["query_id"]).collect()] == [("a", 1.0)]


def test_a_retrieval_reads_each_text_few_times(spark, tmp_path, monkeypatch):
    """Vectors and passages are computed once a retrieval, and a passage's keys once, however many queries it is a candidate of."""
    docs = [(i, f"word{i % 5} other {i}", "s") for i in range(40)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    passages = spark.createDataFrame(docs, "seq long, text string, source string").mapInArrow(seen, "seq long, text string, source string")
    q = spark.createDataFrame([(i, f"word{i % 5}") for i in range(20)], "query_id long, query string")
    corpus = retrieve.Corpus.of(passages)
    assert not corpus.vectors.is_cached
    assert retrieve.retrieve(corpus, q).count() > 20
    assert read.value <= 7 * len(docs)
    corpus.release()


def test_keys_of_passages_do_not_change_what_is_merged(spark):
    rows = [(1, i, 1.0 / i, f" Text  {i % 3}" if i % 2 else f"text {i % 3}", f"n{i % 4}" if i % 5 else None, 0.5, None) for i in range(1, 25)]
    c = spark.createDataFrame(rows, "query_id long, at int, score double, text string, node_id string, vector double, bm25 double")
    got = sorted(map(tuple, fusion.deduplicated(c).collect()))
    assert got == sorted(map(tuple, fusion.deduplicated(fusion.keyed(c)).collect())) and sum(r[5] for r in got) == 24
    assert fusion.deduplicated(fusion.keyed(c)).columns == ["query_id", "text", "node_id", "score", "at", "merged", "vector", "bm25"]


def test_few_keys_travel_and_many_are_joined(spark, monkeypatch):
    table, keys = spark.range(100).withColumnRenamed("id", "k"), spark.createDataFrame([(3,), (3,), (None,), (50,)], "k long")
    few = lineage.among(table, keys, "k")
    assert "BroadcastHashJoin" in few._jdf.queryExecution().toString() and sorted(r.k for r in few.collect()) == [3, 50]
    monkeypatch.setattr(lineage, "KEYS", 1)
    assert sorted(r.k for r in lineage.among(table, keys, "k").collect()) == [3, 50]
