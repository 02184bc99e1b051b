"""The research loop: rounds, policies, bounds, evidence."""

from pyspark.sql import functions as F

from tarn.operators import agent, lexical, research

DOCS = [(1, "red apples"), (2, "green apples"), (3, "pears"), (4, "red bricks"), (5, "stone walls")]


def made(spark, asked):
    docs = spark.createDataFrame(DOCS, "seq long, text string")
    q = spark.createDataFrame(asked, "query_id long, question_index int, question string")
    return q, research.lexical_search(lexical.build(docs), docs, 2)


def test_rounds_and_evidence(spark):
    q, search = made(spark, [(1, 0, "red apples pears stone"), (1, 1, "bricks"), (2, 0, " "), (3, 0, "nothing here at all")])
    steps, evidence = research.researched(q, search, research.narrowing(least_words=2))
    got = {(r.query_id, r.branch, r.round): (r.found, r.new, r.ask, r.stopped) for r in steps.collect()}
    assert got[1, 0, 1][2] == "red apples" and got[1, 1, 1] == (1, 1, None, False)
    assert (2, 0, 1) not in got and got[3, 0, 1] == (0, 0, None, False)
    rows = [(r.query_id, r.branch, r.seq) for r in evidence.collect()]
    assert len(rows) == len(set(rows)) and (1, 1, 4) in rows
    last = {(r.query_id, r.branch): (r.iterations, r.stopped, r.fallback) for r in research.outcomes(steps).collect()}
    assert last[1, 1] == (1, False, None)


def test_policy_reads_what_was_found_and_bounds_stop_it(spark):
    """A policy that never ends is stopped; one of its own columns asks by the number of new passages."""
    q, search = made(spark, [(1, 0, "apples"), (2, 0, "walls")])
    endless = lambda state: state.withColumn("ask", F.when(F.col("query_id") == 1, F.col("question")))
    steps, evidence = research.researched(q, search, endless, agent.Bounds(max_iterations=5, max_tool_calls=3))
    assert {(r.query_id, r.iterations, r.stopped) for r in research.outcomes(steps).collect()} == {(1, 3, True), (2, 1, False)}
    assert [r.new for r in steps.filter("query_id = 1").orderBy("round").collect()] == [2, 0, 0]
    assert evidence.filter("query_id = 1").count() == 2
    assert research.outcomes(steps).filter("query_id = 1").first()["fallback"] == agent.LIMIT_REACHED


def test_no_questions(spark):
    q, search = made(spark, [(1, 0, "apples")])
    steps, evidence = research.researched(q.limit(0), search)
    assert steps.collect() == [] and evidence.collect() == []
