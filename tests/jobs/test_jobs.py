"""The jobs on growing input and twice over the same, and against their SQL on the smallest tables."""

import collections
import json
import os
import subprocess
import sys

import duckdb
import pytest

from jobs import answer_questions, common, index_documents, queries
from tarn.operators import lexical

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def files(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*.parquet"))


@here
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    before = dict(spark.conf.getAll)
    df, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    pick = lambda rows, cols: sorted(tuple(str(r[cols.index(c)]) for c in names) for r in rows)
    assert pick(df.collect(), df.columns) == pick(want.fetchall(), want.columns)
    assert before == dict(spark.conf.getAll)


@here
def test_index_follows_growing_input(spark, tmp_path):
    """The first half of the documents, then the rest with some of the first anew and one emptied: the second run takes that alone."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    src, out = str(tmp_path / "documents"), str(tmp_path / "out")
    docs.filter("doc_id < 100").repartition(2).write.parquet(src)
    config = index_documents.Config(files_per_batch=1, parts=3)
    index_documents.run(spark, src, out, config)
    first = {f for f in files(tmp_path / "out" / "index")}
    figures = lambda: {r.term: (r.df, r.cf) for r in spark.read.parquet(f"{out}/terms").collect()}

    def counted(rows):
        df, cf = collections.Counter(), collections.Counter()
        for text in rows:
            words = (text or "").split()
            cf.update(words)
            df.update(set(words))
        return {t: (df[t], cf[t]) for t in df}

    held = {r.doc_id: r.text for r in docs.filter("doc_id < 100").collect()}
    assert figures() == counted(held.values()) and spark.read.parquet(f"{out}/index/docs").select("batch").distinct().count() == 2
    more = [(r.doc_id, r.text) for r in docs.filter("doc_id >= 100").collect()] + [(3, "quite new words"), (4, None), (5, held[5])]
    spark.createDataFrame(more, "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    index_documents.run(spark, src, out, config)
    held |= dict(more)
    assert figures() == counted(held.values())
    assert first < {f for f in files(tmp_path / "out" / "index")}  # nothing old is rewritten
    assert spark.read.parquet(f"{out}/index/docs").filter("batch = 2").count() == len(more)
    want = {r.term: round(r.idf, 9) for r in lexical.build(spark.createDataFrame(list(held.items()), "seq long, text string")).terms.collect()}
    assert {r.term: round(r.idf, 9) for r in spark.read.parquet(f"{out}/terms").collect()} == want
    index_documents.run(spark, src, out, config)  # nothing new
    assert figures() == counted(held.values()) and spark.read.parquet(f"{out}/index/docs").select("batch").distinct().count() == 3
    assert sorted(p.name for p in (tmp_path / "out" / "terms").glob("part=*")) == ["part=0", "part=1", "part=2"]


def test_answers_rerun_and_layout(spark, tmp_path):
    docs = [(1, "Granny Smith apples are green and sour.", "fruit"), (2, "Apples and pears store well.", "fruit"), (3, "Bolts and nuts.", None), (4, None, "x")]
    asked = [(1, "green apples"), (2, "tell secrets"), (3, None), (4, "zebra")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "q"))
    config = answer_questions.Config(passages=2, profile={"coverage": "apples", "forbidden_questions": ["tell secrets"]})
    seen = []
    for _ in range(2):
        answer_questions.run(spark, str(tmp_path / "d"), str(tmp_path / "q"), str(tmp_path / "out"), config)
        seen.append(sorted((r.query_id, r.route, r.markdown) for r in spark.read.parquet(str(tmp_path / "out" / "answers")).collect()))
    assert seen[0] == seen[1] and [r[0] for r in seen[0]] == [1, 2, 3, 4]
    by = {r[0]: r for r in seen[0]}
    assert "Granny Smith" in by[1][2] and by[2][1] == "out_of_scope" and by[1][1] == "retrieve"
    assert sorted(p.name for p in (tmp_path / "out" / "answers").glob("route=*")) == ["route=out_of_scope", "route=retrieve"]
    evidence = spark.read.parquet(str(tmp_path / "out" / "evidence"))
    assert evidence.filter("query_id = 2").isEmpty() and evidence.filter("query_id = 1").count() == 2


def test_configuration(spark, tmp_path):
    assert common.configured(spark, None, index_documents.Config) == index_documents.Config()
    for kind, name in ((answer_questions.Config, "answer_questions"), (index_documents.Config, "index_documents")):
        assert isinstance(common.configured(spark, f"{ROOT}/jobs/{name}.json", kind), kind)
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"passage": 3}))
    with pytest.raises(ValueError, match="passage"):
        common.configured(spark, str(bad), answer_questions.Config)


def test_command_line(tmp_path):
    """A process of its own makes and stops the session, logs what was read and written, and may be run again."""
    make = f"import sys; sys.path.insert(0, {ROOT!r})\nfrom pyspark.sql import SparkSession\ns = SparkSession.builder.master('local[2]').getOrCreate()\ns.createDataFrame([(1, 'a b'), (2, 'b')], 'doc_id long, text string').write.parquet({str(tmp_path / 'd')!r})"
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    subprocess.run([sys.executable, "-c", make], check=True, env=env, cwd=tmp_path, timeout=300, capture_output=True)
    for n in ("took 2 rows", "took 0 rows"):
        done = subprocess.run([sys.executable, "-m", "jobs.index_documents", "--documents", str(tmp_path / "d"), "--out", str(tmp_path / "o"), "--config", f"{ROOT}/jobs/index_documents.json"], env=env, cwd=ROOT, timeout=300, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr[-2000:]
        assert n in done.stderr and "wrote 2 rows" in done.stderr


def test_jobs_import_no_llm():
    code = f"import sys; sys.path.insert(0, {ROOT!r})\nimport jobs.queries\nassert not any(m.startswith('tarn.llm') or m == 'corpus_pipeline' for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
