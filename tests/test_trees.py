"""Trees from parent links alone: chains by pointer doubling, cycles, hydration and section paths; pooling in one exchange against level by level."""

import random

import numpy as np
from pyspark.sql import functions as F

from tarn.operators import embed, parse
from tarn.sources import stores

NODE = "node_id string, parent_id string, node_type string, text string, `order` int, title string"


def test_chains(spark):
    deep = [(f"d{i}", f"d{i - 1}" if i else None) for i in range(70)]
    rows = deep + [("x", "gone"), ("y", "x"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("below", "c1"), ("self", "self"), ("lone", None)]
    got = {r.node_id: (list(r.ancestors), r.cyclic) for r in parse.chains(spark.createDataFrame(rows, "node_id string, parent_id string").repartition(3)).collect()}
    for i in range(70):
        assert got[f"d{i}"] == ([f"d{j}" for j in range(i)], False)
    assert got["x"] == ([], False) and got["y"] == (["x"], False) and got["lone"] == ([], False)
    assert all(got[n] == ([], True) for n in ("c1", "c2", "c3", "below", "self")) and len(got) == len(rows)
    assert parse.chains(spark.createDataFrame([], "node_id string, parent_id string")).collect() == []


def made(seed):
    """A random tree: inner nodes are sections with or without text, leaves are paragraphs, some blank."""
    rng = random.Random(seed)
    parent = {0: None} | {i: rng.randrange(max(0, i - 6), i) for i in range(1, 40)}
    inner = {p for p in parent.values() if p is not None}
    rows = []
    for i, p in parent.items():
        kind = "section" if i in inner and i else "document" if i == 0 else "paragraph"
        text = rng.choice(["", " ", f"text {i} a b"]) if kind == "paragraph" else rng.choice(["", "", f"own {i}"])
        rows.append((f"n{i}", None if p is None else f"n{p}", kind, text, i, f"t{i}"))
    return rows


def test_pooling_in_one_exchange(spark):
    for seed in (1, 2):
        rows = made(seed)
        nodes = spark.createDataFrame(rows, NODE)
        out = {r.node_id: r for r in embed.enriched(nodes, lambda t: embed.hashed(t, 32)).collect()}
        kids = {}
        for n, p, *_ in rows:
            kids.setdefault(p, []).append(n)

        def vector(n):
            own = out[n]
            if own.node_type == "paragraph":
                return None if own.embedding is None else np.array(own.embedding)
            below = [v for v in map(vector, kids.get(n, [])) if v is not None]
            return np.mean(below, axis=0) if below else None

        for n, _, kind, text, *_ in rows:
            want = vector(n)
            assert (want is None) == (out[n].embedding is None), n
            if want is not None:
                assert np.abs(want - np.array(out[n].embedding)).max() < 1e-9
            if kind != "paragraph" and want is not None:
                assert out[n].token_count == sum(out[k].token_count for k in kids[n])
        assert len(out) == len(rows)


def test_operators_without_ancestors(spark, tmp_path):
    rows = [("r", None, "document", "", 0, None), ("s", "r", "section", "", 1, "One"), ("p", "s", "paragraph", "hello", 2, None), ("q", "s", "paragraph", "there", 3, None)]
    nodes = spark.createDataFrame(rows, NODE)
    assert {r.node_id: r.text for r in embed.hydrated(nodes).collect()} == {"r": "hello\n\nthere", "s": "hello\n\nthere", "p": "hello", "q": "there"}
    assert {r.node_id: list(r.path) for r in parse.section_paths(nodes).collect()}["p"] == ["One"]
    store = stores.JsonNodeStore(spark, str(tmp_path))
    store.replace(nodes.withColumn("doc_id", F.lit("d")))
    assert {r.node_id: list(r.ancestors) for r in store.nodes().collect()} == {"r": [], "s": ["r"], "p": ["r", "s"], "q": ["r", "s"]}


def test_leaf_numbers_follow_the_documents(spark):
    rows = [(f"{d}:{i}", d, "paragraph", "t", i, None) for d in ("a", "b", "c", "d") for i in range(9)]
    random.Random(4).shuffle(rows)
    nodes = spark.createDataFrame(rows, NODE).withColumn("doc_id", F.col("parent_id")).repartition(3)
    out = parse.leaf_documents(nodes).orderBy("seq").collect()
    assert [(r.doc_id, r.order) for r in out] == [(d, i) for d in "abcd" for i in range(9)] and len({r.seq for r in out}) == 36


def test_node_store_segments(spark, tmp_path):
    """Upserts, removals and compaction leave what a rebuild would; an upsert writes its own documents alone."""
    store = stores.JsonNodeStore(spark, str(tmp_path))
    make = lambda rows: spark.createDataFrame(rows, "node_id string, doc_id string, text string")
    seen = lambda: sorted((r.node_id, r.text) for r in store.nodes().collect())
    store.upsert(make([("a:1", "a", "1"), ("a:2", "a", "2"), ("b:1", "b", "3")]))
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("*.json"))
    first = size()
    store.upsert(make([("a:1", "a", "new")]))
    assert seen() == [("a:1", "new"), ("b:1", "3")] and size() - first < first
    store.remove(make([("", "b", "")]))
    assert seen() == [("a:1", "new")]
    store.upsert(make([("b:7", "b", "back")]))
    assert seen() == [("a:1", "new"), ("b:7", "back")]
    store.compact()
    assert seen() == [("a:1", "new"), ("b:7", "back")] and store.trees().count() == 2
