"""Decontamination over positional postings against brute force, phrases and proximity, and on odd rows."""

import hashlib
import random
import re

import pytest

from tarn.llm import positions as P

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for item, it in items:
            iw = words(it)
            n = min(len(iw), window)
            wanted = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for p in range(len(own) - n + 1) if n else ():
                if tuple(own[p : p + n]) in wanted:
                    hit |= set(range(p, p + n))
                    found.add("" if item is None else str(item))
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def brute_near(own, item, window, within):
    """The spans of the places of each window's rarest word that have all its other words near."""
    spans = set()
    n = min(len(item), window)
    for at in range(len(item) - n + 1) if n else ():
        win = item[at : at + n]
        if any(w not in own for w in win):
            continue
        rarest = min(range(n), key=lambda i: (own.count(win[i]), i))
        for p in (i for i, w in enumerate(own) if w == win[rarest]):
            low = high = p
            for w in win:
                near = min((i for i, x in enumerate(own) if x == w), key=lambda i: (abs(i - p), i))
                if abs(near - p) > within:
                    break
                low, high = min(low, near), max(high, near)
            else:
                spans.add((low, high + 1))
    merged = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [tuple(x) for x in merged]


def made(seed, n_docs=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ärger", "naïve", "x1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(20)]
    docs = []
    for d in range(n_docs):
        text = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice([" ", "\n", "--", "; "]) + rng.choice(items)[1].upper() + " " + say(rng.randint(0, 8))
        docs.append((d, text))
    return docs, items


def rows(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, P.contamination(d, spark.createDataFrame(items, "item_id long, text string"), **kw).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, items = made(seed)
    assert rows(spark, docs, items) == sorted(brute(docs, items), key=str)


def test_chunks_blocks_and_pieces(spark, monkeypatch):
    """Chunks of a few words, slices of a few bytes, several blocks and pieces of an item give the same."""
    docs, items = made(3, 20)
    items += [(99, " ".join(t for _, t in items))]
    docs += [(100, items[-1][1])]
    monkeypatch.setattr(P, "CANDIDATES", 64)
    monkeypatch.setattr(P, "BLOCK_BYTES", 400)
    assert rows(spark, docs, items, window=4) == sorted(brute(docs, items, 4), key=str)
    one = list(P.slices(items[-1][1].encode()))
    monkeypatch.setattr(P, "SLICE", 7)
    assert [w for s in P.slices(items[-1][1].encode()) for w in s] == [w for s in one for w in s] == [w.encode() for w in words(items[-1][1])]


def test_odd_rows(spark):
    long_text = "a b c d e f g h i j " + " ".join(f"z{i}" for i in range(150_000)) + " K L M"
    docs = [(1, None), (None, ""), (2, " \n\t"), (3, "a b c d e f g h i j"), (3, "A-B-C d e f g h i"), (None, "x k l m x"), (4, long_text), (4, long_text)]
    items = [(None, "k l m"), (1, "a b c d e f g h i j"), (1, "k l"), (2, ""), (3, None), (4, "...")]
    assert rows(spark, docs, items) == sorted(brute(docs, items), key=str)
    wide = spark.createDataFrame([(1, "k l m", 5, "t", [1])], "doc_id long, text string, chunk int, term string, starts array<int>")
    more = spark.createDataFrame([(1, "k l m", 5, "t")], "item_id long, text string, block int, words string")
    assert [tuple(r)[:4] for r in P.contamination(wide, more).collect()] == [(1, 3, 3, 1)]
    assert P.contamination(wide.limit(0), more).collect() == []
    assert [tuple(r)[:4] for r in P.contamination(wide, more.limit(0)).collect()] == [(1, 3, 0, 0)]


def test_spans_and_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(7, "x a b c x x a b c d"), (8, "c b a")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "a b c d"), ("r", "b c")], "item_id string, text string")
    P.PositionalIndex.build(docs).write(str(tmp_path / "index"))
    index = P.PositionalIndex.read(spark, str(tmp_path / "index"))
    found = {r.doc_id: {i.item_id: [tuple(s) for s in i.spans] for i in r["items"]} for r in index.search(items, window=3).collect()}
    assert found == {7: {"q": [(1, 4), (6, 10)], "r": [(2, 4), (7, 9)]}, 8: {}}


@pytest.mark.parametrize("within", [0, 2, 5])
def test_proximity(spark, within):
    rng = random.Random(within)
    vocabulary = [f"w{i}" for i in range(9)]
    docs = [(d, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for d in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5)))) for i in range(6)]
    # one document a chunk, so that the rarest word of a window is the rarest of its document
    d = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(12, "doc_id")
    found = P.PositionalIndex.build(d).search(spark.createDataFrame(items, "item_id long, text string"), window=3, within=within)
    got = {(r.doc_id, int(i.item_id)): [tuple(s) for s in i.spans] for r in found.collect() for i in r["items"]}
    want = {(d, i): s for d, t in docs for i, it in items if (s := brute_near(t.split(), it.split(), 3, within))}
    assert {k: got.get(k) for k in want if k not in got or got[k] != want[k]} == {} and set(got) == set(want)
