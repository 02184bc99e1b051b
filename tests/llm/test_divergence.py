"""The source divergence audit against brute force in exact arithmetic, and on odd rows."""

import collections
import random
import re

import numpy as np

from tarn.llm import divergence as D

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string, lang string, source string"


def brute(docs, min_docs, terms):
    docs = [(t or "", la or "", s or "") for _, t, la, s in docs]
    out = []
    for lang in {d[1] for d in docs}:
        df, counts = collections.Counter(), collections.defaultdict(collections.Counter)
        for text, la, source in docs:
            if la == lang:
                found = WORD.findall(text.translate(LOWER))
                df.update(set(found))
                counts[source].update(found)
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), collections.Counter()))
        for s in p:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s]
            best = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", best, terms)):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def rows(spark, docs, min_docs, terms):
    return sorted(map(tuple, D.divergence(spark.createDataFrame(docs, KIND).repartition(3), min_docs, terms).collect()))


def made(seed):
    rng = random.Random(seed)
    say = lambda k, n: " ".join(rng.choice([f"t{chr(97 + i)}{chr(97 + k % 3)}" for i in range(9)] + ["Über", "THE", "the", "éa"]) for _ in range(n))
    return [(d, say(d, rng.randint(0, 30)), rng.choice(["en", "de"]), rng.choice(["a", "a", "b", "c", "dé"])) for d in range(150)]


def test_against_brute_force(spark):
    docs = made(1)
    assert rows(spark, docs, 5, 4) == brute(docs, 5, 4)


def test_small_steps(spark, monkeypatch):
    """Chunks and slices of a few entries give the same."""
    docs = made(2)
    monkeypatch.setattr(D, "CELLS", 8)
    assert rows(spark, docs, 12, 50) == brute(docs, 12, 50)
    frames = [(la, s, (t or "").encode()) for _, t, la, s in docs]
    import pyarrow as pa

    class At:
        @staticmethod
        def get():
            return At

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(D, "TaskContext", At)
    monkeypatch.setattr(D, "ENTRIES", 20)
    monkeypatch.setattr(D, "SLICE", 5)
    batch = pa.record_batch([pa.array(x) for x in zip(*frames, strict=True)], ["lang", "source", "text"])
    def entries(row):
        names = [row["names"][i] for i in np.frombuffer(row["sources"], np.int32)]
        return zip(row["terms"].split(" "), names, np.frombuffer(row["docs"], np.int64).tolist(), np.frombuffer(row["counts"], np.int64).tolist(), strict=True)

    packed = [r for b in D._counted(3)(iter([batch])) for r in b.to_pylist()]
    counted, chunks = collections.Counter(), set()
    for r in packed:
        chunks.add(r["chunk"])
        for term, source, n_docs, n in entries(r):
            counted[r["lang"], term, source] += n_docs * 10**6 + n
    want = collections.Counter()
    for lang, source, text in frames:
        found = [t.decode() for t in text.translate(D.FOLD).split()]
        for t in found:
            want[lang, t, source] += 1
        for t in set(found):
            want[lang, t, source] += 10**6
    assert counted == want and len(chunks) > 2
    ordered = sorted(packed, key=lambda r: (r["bucket"], r["lang"], r["chunk"]))
    df, of = collections.Counter(), collections.defaultdict(dict)
    for (la, t, s), v in want.items():
        df[la, t] += v // 10**6
        of[la, t][s] = v % 10**6
    for size in (1, 3, 1000):  # buckets that cross batches
        parts = [pa.RecordBatch.from_pylist(ordered[i : i + size], schema=pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("chunk", pa.int64()), ("terms", pa.string()), ("names", pa.list_(pa.string())), ("sources", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])) for i in range(0, len(ordered), size)]
        got = {(r["lang"], r["term"]): (r["docs"], dict(zip(r["sources"], r["counts"], strict=True))) for b in D._scanned(12)(iter(parts)) for r in b.to_pylist()}
        assert got == {k: (df[k], v) for k, v in of.items() if df[k] >= 12}


def test_odd_rows(spark):
    docs = [(1, None, None, None), (1, None, None, None), (None, "", "en", "a"), (2, "Ab ab", "en", "a"), (2, "ab", "en", "b"), (3, "1 2 3", "xx", "only"), (4, "ab " * 70_000 + "cd", "en", None), (5, "cd cd", "en", ""), (6, "..", "fr", "a"), (7, "", "fr", "b"), (8, None, "fr", "c")]
    for least in (1, 2, 9):
        assert rows(spark, docs, least, 50) == brute(docs, least, 50)
    assert rows(spark, [], 1, 50) == []
    wide = spark.createDataFrame([(1, "a b", "en", "s", "x", 5, 6, 7)], KIND + ", term string, docs long, slice long, kept long")
    assert [tuple(r) for r in D.divergence(wide, 1).collect()] == []  # one source: its shares are its language's


def test_shares_are_exact():
    count = np.array([0, 1, 10**12, 4 * 10**15, 7], np.int64)
    for total, terms in ((9 * 10**12, 10**6), (8 * 10**15, 1), (7, 3)):
        got = D.share(np.minimum(count, total), np.array([total]), terms).tolist()
        assert got == [1 + 10**9 * (min(c, total) + 5) // (total + 5 * terms) for c in count.tolist()]
