"""Pruned BM25 against scoring everything: small blocks, frequent terms of negative weight, ties, zero fill, a stored index, and what is read."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import blockmax, lexical
from tarn.sources import stores

DOCS, QUERIES = "seq long, text string", "query_id long, query string"


def made(n, seed=0):
    """Words by a steep law, one of them in every document."""
    rng = random.Random(seed)
    words = [f"w{int(200 * rng.random() ** 3)}" for _ in range(n * 12)]
    return [(i, " ".join(["all", *words[12 * i : 12 * i + rng.randint(1, 12)]])) for i in range(n)]


def rows(df):
    return sorted((r.query_id, r["rank"], r.seq, r.score) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_scoring_everything(spark, monkeypatch, seed):
    monkeypatch.setattr(blockmax, "BLOCK", 4)
    monkeypatch.setattr(blockmax, "CHUNK", 300)
    docs = spark.createDataFrame(made(400, seed) + [(900, ""), (901, None), (902, "all " * 5000)], DOCS).repartition(3)
    rng = random.Random(seed)
    asked = [(i, " ".join(rng.choice(["all", f"w{rng.randint(0, 60)}", f"w{rng.randint(0, 199)}", "unknown"]) for _ in range(rng.randint(1, 12)))) for i in range(25)]
    q = spark.createDataFrame([*asked, (90, ""), (91, None), (92, "unknown"), (93, "all"), (94, "w0 w0 w0")], QUERIES)
    index, whole = blockmax.build(docs), lexical.build(docs)
    for k in (1, 5, 450):
        assert rows(lexical.top_k(index, q, k)) == rows(lexical.top_k(whole, q, k))
    figures = lambda x: sorted((r.term, r.df, round(r.idf, 9)) for r in x.terms.collect())
    assert figures(index) == figures(whole)


def test_few_documents(spark):
    """Half of the terms' weights are negative here; the mean may be, too."""
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a b c d")], DOCS)
    q = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "d a z")], QUERIES)
    for k in (1, 2, 5):
        assert rows(blockmax.top_k(blockmax.build(docs), q, k)) == rows(lexical.top_k(lexical.build(docs), q, k))
    assert blockmax.top_k(blockmax.build(docs.limit(0)), q, 3).collect() == []


def test_most_is_not_read(spark, monkeypatch):
    """A frequent term's list lies in many pieces, and a query with rarer terms leaves it unread."""
    monkeypatch.setattr(blockmax, "CHUNK", 500)
    rng = random.Random(3)
    docs = [(i, "all the of " + " ".join(f"w{rng.randint(0, 400)}" for _ in range(6))) for i in range(3000)]
    index = blockmax.build(spark.createDataFrame(docs, DOCS).repartition(4))
    assert index.blocks.filter("term = 'all'").select("chunk").distinct().count() > 20
    q = spark.createDataFrame([(i, f"all the of w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4}") for i in range(20)], QUERIES)
    read = blockmax.pruning(index, q, 5).agg(*[F.sum(c).alias(c) for c in ("blocks", "blocks_read", "postings", "postings_read")]).first()
    assert read["postings_read"] < read["postings"] / 3


def test_stored(spark, tmp_path):
    docs = spark.createDataFrame(made(60), DOCS)
    q = spark.createDataFrame([(1, "w0 w5 all")], QUERIES)
    store = stores.store("lexical", "blocks", spark, str(tmp_path / "blocks"))
    store.rebuild(docs)
    assert rows(store.search(q, 4)) == rows(lexical.top_k(lexical.build(docs), q, 4))
