"""The pipeline's near-duplicate stage against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import neardup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=5):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    passage = r.choices(words, k=30)
    out = []
    for group in range(12):
        base = r.choices(words, k=r.randrange(60, 160)) + passage * (group % 2)
        for _ in range(30 if group < 3 else 4):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w[: len(w) - r.randrange(0, 8)]))
    out += [out[0].upper(), out[50], "one two", "One  two", "one three", "", " \n", None]
    r.shuffle(out)
    return out


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """doc_id to the smallest doc_id that chains of similar texts reach."""
    sets = [(d, grams(t)) for d, t in sorted(rows)]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    near = []
    for k, (d, a) in enumerate(sets):
        for e, b in sets[:k]:
            both, either = len(a & b), len(a | b)
            if a == b or 5 * both >= 4 * either:
                near.append((both, either))
                x, y = root(d), root(e)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d, _ in sets}, near


@pytest.mark.parametrize("seed", [5, 6])
def test_stage_links_all_similar_texts(spark, seed):
    rows = list(enumerate(texts(seed)))
    want, near = brute(rows)
    assert sum(5 * a < 4.5 * b for a, b in near) > 100
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).repartition(3)
    found = {}
    for r in neardup.similar_documents(docs).collect():
        found.setdefault(r.component, set()).add(r.doc_id)
    wanted = {}
    for d, x in want.items():
        wanted.setdefault(x, set()).add(d)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == sorted(wanted) and left.columns == docs.columns
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").collect() == []
