"""The llm queries that SQL can express, and the pipeline stage by stage, on the smallest tables."""

import collections
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import queries, quality

from .test_llm import brute_lines, filled, size_of
from .test_neardup import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    pick = lambda rows, cols: sorted(tuple(str(r[cols.index(c)]) for c in names) for r in rows)
    assert pick(df.collect(), df.columns) == pick(want.fetchall(), want.columns)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    as_rows = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    held = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], DATA).write.parquet(str(tmp_path / str(k)))
        held.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(h.columns == docs.columns for h in held[:-1])
    good = {r.doc_id for r in quality.judged(docs).filter("kept").collect()}
    assert {r[0] for r in as_rows(held[1])} == good and held[1].count() == len(good)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    clean = {r.doc_id for r in quality.judged(docs).filter("not base_failed").collect() if labels.get(r.doc_id) == 1}
    assert clean <= good
    assert collections.Counter((r[0], r[1]) for r in as_rows(held[2])) == collections.Counter((x[0], x[3]) for x in brute_lines(as_rows(held[1])))
    texts = {r[0]: r[1] for r in as_rows(held[2])}
    roots, _ = brute(texts.items())  # five words, a similarity of 0.8 or more
    assert sorted(r[0] for r in as_rows(held[3])) == sorted(set(roots.values()))
    sizes, before = collections.Counter(), {}
    for d, t, _, s in as_rows(held[3]):
        sizes[s] += size_of(t)
        before[d] = (t, s)
    taken, copies = collections.Counter(), collections.Counter()
    for d, t, _, s in as_rows(held[4]):
        assert before[d] == (t, s)
        taken[s] += size_of(t)
        copies[d] += 1
    want = filled(dict(sizes))
    longest = {s: max(size_of(t) for t, x in before.values() if x == s) for s in sizes}
    assert max(copies.values()) <= 2 and all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    assert collections.Counter(r.doc_id for r in held[5].collect()) == copies
    whole = corpus_pipeline.run(spark, DATA)
    total = lambda df: df.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    assert total(whole) == total(held[5]) and math.isclose(sum(copies.values()), whole.count())


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, text_ string, _tarn_row long, _tarn_id long, drops long, digest string"


def odd_rows():
    plain = lambda k, n=80: " ".join(f"w{k}x{i % 37}q{i:05d}" for i in range(n))
    rows = [(1, plain(1), "en", "a"), (1, plain(2), "en", "a"), (2, plain(1), "en", "b"), (None, plain(3), None, None), (None, plain(4), "en", None), (3, None, "en", "a"), (4, "", "en", "a"), (5, " \n\t", "en", "a")]
    rows += [(6, plain(6, 30_000), "en", "a"), (7, plain(7), "en", "c"), (7, plain(7), "en", "c"), (8, plain(8) + " end", "de", "c"), (9, plain(8), "de", "c")]
    return [(d, t, la, s, None if t is None else len(t), True, "x", 5, 6, 7, "y") for d, t, la, s in rows]


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, blank and very long texts, repeated rows and ids, clashing columns, empty tables."""
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").collect() == [], name
        out = stage(spark, docs, "")
        assert out.columns == corpus_pipeline.COLUMNS, name
        docs = spark.createDataFrame([(*r, True, "x", 5, 6, 7, "y") for r in out.collect()], ODD)
        got = collections.Counter((r.doc_id, (r.text or "")[:3]) for r in docs.collect())
        if name == "quality rules":
            assert got == {(1, "w1x"): 1, (1, "w2x"): 1, (2, "w1x"): 1, (None, "w3x"): 1, (None, "w4x"): 1, (6, "w6x"): 1, (7, "w7x"): 2, (8, "w8x"): 1, (9, "w8x"): 1}
        if name == "near-dedup":
            assert got == {(1, "w1x"): 1, (1, "w2x"): 1, (None, "w3x"): 1, (None, "w4x"): 1, (6, "w6x"): 1, (7, "w7x"): 1, (8, "w8x"): 1}
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, "").count() == docs.count() and last(spark, empty, "").collect() == []


def test_run_leaves_only_its_stages(spark):
    from tarn.llm import common

    before = set(common._written)
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert set(common._written) == before
