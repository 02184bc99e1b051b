"""Sentence ends learnt from a corpus: abbreviations that the corpus shows, hand-cut sentences, odd texts."""

import random

from tarn.operators import chunk, sentences

NAMES = ["Smith", "Jones", "Brown", "Miller", "Weber", "Klein", "Moreau", "Silva"]
THINGS = ["fruit", "stone", "paper", "metal", "glass", "cotton"]

HAND = [
    ["Dr. Smith went home.", "He saw many things, e.g. fruit and stone.", "The day was long!"],
    ["Was it Mr. Jones?", "No.", "It was Dr. Klein of Weber and Co. who came."],
    ["They sold paper, metal etc. for little.", "The price fell.", "We know why."],
    ["The house stood empty.", "The garden, i.e. the part behind it, was green.", "Dr. Moreau left."],
]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    say = [
        lambda: f"Dr. {rng.choice(NAMES)} came to the house.",
        lambda: f"Mr. {rng.choice(NAMES)} left the garden.",
        lambda: f"They had things, e.g. {rng.choice(THINGS)} and {rng.choice(THINGS)}.",
        lambda: f"They had one thing, i.e. {rng.choice(THINGS)}, and no more.",
        lambda: f"We bought {rng.choice(THINGS)}, {rng.choice(THINGS)} etc. for the house.",
        lambda: f"The {rng.choice(THINGS)} was old.",
        lambda: f"The work of {rng.choice(NAMES)} and Co. was good.",
        lambda: f"He saw the {rng.choice(THINGS)} and the price.",
        lambda: "We know why it fell.",
        lambda: "It was empty. No day was long.",
        lambda: f"The empty {rng.choice(THINGS)} fell on old {rng.choice(THINGS)} and good {rng.choice(THINGS)} by the garden wall.",
        lambda: "More and more long days fell empty, old and good as they were, and the house stood for long days more in the garden.",
    ]
    return [(i, " ".join(rng.choice(say)() for _ in range(6))) for i in range(n)]


def test_learnt_and_cut(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    found = sentences.Boundaries.learnt(docs)
    short = {r.word for r in found.words.filter("abbreviation").collect()}
    assert {"dr", "mr", "e.g", "i.e", "etc", "co"} <= short and not short & {"house", "garden", "old", "empty", "metal", "why"}
    hand = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(HAND)], "doc_id long, text string")
    got = {}
    for r in found.cut(hand).orderBy("doc_id", "sentence").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    right = sum(len(set(got[i]) & set(s)) for i, s in enumerate(HAND))
    assert right >= 0.95 * sum(map(len, HAND)), got
    packed = chunk.learnt_chunks(hand, found, chunk_size=8, chunk_overlap=0).orderBy("doc_id", "chunk").collect()
    assert packed[0].text.startswith("Dr. Smith went home.") and "".join(r.text for r in packed if r.doc_id == 0) == "".join(HAND[0])


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, " "), (3, "..."), (4, "no end"), (5, "One. Two! Three? (Four.) \"Five.\" six")], "doc_id long, text string")
    found = sentences.Boundaries.learnt(docs)
    rows = [(r.doc_id, r.sentence, r.text) for r in found.cut(docs).orderBy("doc_id", "sentence").collect()]
    assert [r for r in rows if r[0] < 5] == [(3, 0, "..."), (4, 0, "no end")]
    assert [r[1] for r in rows if r[0] == 5] == list(range(len(rows) - 2)) and len(rows) >= 6
    empty = sentences.Boundaries.learnt(docs.limit(0))
    assert empty.words.collect() == [] and empty.cut(docs.limit(0)).collect() == []
