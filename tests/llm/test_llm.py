"""Operators against brute-force versions, and the edge cases their docstrings name."""

import collections
import hashlib
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarn.llm import bilstm, blocks, bpe, cuckoo, extract, katz, lines, mixing, quality, rangecoder, simhash, superkmers, tokenfiles, topk, train_html

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int, _id string, fp int, h int, bucket int, term string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def corpus(seed=3, n=60):
    """Random texts with copies, near copies, shared lines and passages, and the odd cases."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeot", k=r.randint(1, 7))) for _ in range(150)]
    words = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared_line = "This Very Common line of text is on many pages " + words(4)
    passage = words(40)
    texts = []
    for i in range(n):
        k = i % 7
        t = "\n".join(words(r.randint(3, 40)) for _ in range(r.randint(1, 5)))
        if k == 1 and texts:
            t = r.choice(texts) or ""
        elif k == 2 and texts:
            w = (r.choice(texts) or "a").split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif k == 3:
            t = t + "\n  " + shared_line.upper() + "\t\n" + words(5)
        elif k == 4:
            t = words(5) + " " + passage + " " + words(6)
        texts.append(t)
    odd = [None, "", " \t\n ", "a", "a b", "ÄÖÜ ß é <|endoftext|> don't 😀 İ", "x" * 3000, "###$$$ " * 30, "a\x0bb\x0cc\x1cd e", "same\nsame\nsame\n\nsame"]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None, "ü"])) for i, t in enumerate(texts + odd)]
    rows += [(None, "no id but words " + passage, "en", "s1"), (5, texts[5], "en", "s1"), (5, "another text under the same id", "en", "s1")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(d, t, la, s, None, 1, "x", 2, 3, 4, "t") for d, t, la, s in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def unique(rows):
    """The rows with one text an id."""
    seen = {}
    for d, t, *_ in rows:
        if d is not None:
            seen.setdefault(d, []).append(t)
    return {d: ts[0] for d, ts in seen.items() if len(set(ts)) == 1}


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_library(docs, rows, library):
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs).collect())
    want = collections.Counter()
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want


def test_bpe_random_strings(library):
    r = random.Random(11)
    ranges = [(32, 127), (160, 591), (768, 880), (0x370, 0x500), (0x4E00, 0x4E50), (0x1F600, 0x1F640), (0x2000, 0x2070), (9, 14)]
    texts = ["".join(chr(r.randrange(*r.choice(ranges))) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(r.choices("aeinorst", k=r.randint(1, 90))) for _ in range(1500)] + ["it's we'll they'd <|startoftext|>x<|endoftext|>"]
    own = bpe.WordBPE(bpe.default_path())
    fed = tokenfiles.LibraryEncoder(None)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(raw)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in fed.encode_batch(raw)] == want


def test_bpe_borders_agree_with_merging():
    own = bpe.WordBPE(bpe.default_path())
    words = [w for w in ("".join(random.Random(i).choices("aeinorstlh", k=2 + i % 9)).encode() for i in range(800))]
    guess = [own.propose(w) for w in words]
    assert own.encode_words(words) == [own.merge(w) for w in words]
    assert any(g != own.merge(w) for g, w in zip(guess, words, strict=True)), "some words must need merging"


# token files


def test_range_coder_round_trip():
    r = np.random.default_rng(1)
    for grid in (r.integers(0, 65536, (7, 200)), np.minimum(r.geometric(0.01, (40, 300)), 65535), np.zeros((3, 50), int), np.full((2, 70), 65535), r.integers(0, 9, (5, 1)), np.zeros((0, 4), int)):
        codes = rangecoder.encode(grid)
        assert (rangecoder.decode(codes, grid.shape[1]) == grid).all()
    text = np.tile(r.integers(0, 5000, 50), 40).reshape(4, 500)
    assert sum(map(len, rangecoder.encode(text))) < text.size / 2, "repeats must be cheap"


def test_token_chunk_checksum():
    docs = [(1, np.array([5, 6, 1], np.uint16)), (None, np.array([1], np.uint16)), (7, np.arange(1000, dtype=np.uint16))]
    blob = tokenfiles.pack(docs)
    back = list(tokenfiles.unpack(blob))
    assert [d for d, _ in back] == [1, None, 7] and all((a == b).all() for (_, a), (_, b) in zip(docs, back, strict=True))
    broken = bytearray(blob)
    broken[-30] ^= 255
    with pytest.raises(ValueError):
        list(tokenfiles.unpack(bytes(broken)))


def test_blocks_share_what_they_learn():
    """A block is too short to learn these ids alone: 8,000 ids from 400 that are new to it take over 1.6 bytes each then."""
    r = np.random.default_rng(4)
    vocabulary = r.integers(0, 50_000, 400)
    grid = vocabulary[np.minimum(r.geometric(0.02, (512, 64)), 400) - 1]
    codes = rangecoder.encode(grid)
    assert (rangecoder.decode(codes, 64) == grid).all()
    assert sum(map(len, codes)) < 1.2 * grid.size


def test_coder_cost():
    """CPU time of coding and decoding an id, by the check tool's measure of a machine's slowness."""

    def spent(f):
        t = time.thread_time()
        f()
        return time.thread_time() - t

    r = np.random.default_rng(8)
    grid = np.minimum(r.zipf(1.3, (8192, 32)), 49_000)
    slow = min(spent(lambda: sum(range(50_000))) for _ in range(9)) * 1000
    assert min(spent(lambda: rangecoder.decode(rangecoder.encode(grid), 32)) for _ in range(3)) < 1.1e-6 * grid.size * slow


def test_memory_of_words(library, monkeypatch):
    """Frequent words are asked for once, however often the memory fills; words that are too long or not UTF-8 come out right."""
    monkeypatch.setattr(tokenfiles, "MEMORY_WORDS", 1500)
    fed = tokenfiles.LibraryEncoder(None)
    asked = collections.Counter()

    class Counting:
        def encode_batch(self, texts, **kw):
            asked.update(w for t in texts for w in t.split())
            return library.encode_batch(texts, **kw)

        def encode_batch_fast(self, texts, **kw):
            asked.update(w for t in texts for w in t.split())
            return library.encode_batch_fast(texts, **kw)

    fed.lib = Counting()
    r = random.Random(6)
    often = ["".join(r.choices("aeinorst", k=9)) for _ in range(50)]
    for i in range(30):
        rare = ["".join(r.choices("aeinorst", k=12)) + r.choice(["", "", ",", "%%%", "'", "!?"]) for _ in range(100)]
        texts = [" ".join(often), "", " \t", " ".join(rare), "x" * 100 + "." + " y" * 3, "Ä1, ß-é " + often[0] + "###", "λόγος."]
        raw = [t.encode() for t in texts] + [b"a\xff\xfe b\xc3, c"]
        texts.append(raw[-1].decode("utf-8", "replace"))
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in fed.encode_batch(raw)] == want
    assert max(asked[w] for w in often) == 1


def test_token_files(docs, rows, library, empty):
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_tokens(tokenfiles.write_tokens(docs)).collect()))
    assert [g[1] is None for g in got] == [True] + [False] * (len(rows) - 1), "nulls first"
    ids = [g[1] for g in got[1:]]
    assert ids == sorted(ids)
    at = 0
    for g in got:
        assert g[0] == at
        at += g[2]
    want = collections.Counter()
    for d, t, *_ in rows:
        x = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want[d, len(x), zlib.crc32(x.tobytes())] += 1
    assert collections.Counter(g[1:] for g in got) == want
    assert tokenfiles.read_tokens(tokenfiles.write_tokens(empty)).collect() == []
    again = tokenfiles.read_tokens(tokenfiles.write_tokens(docs.repartition(7)))
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in again.collect()) == got, "rows that share an id have one order"
    with pytest.raises(ValueError):
        tokenfiles.pack([(1, np.array([70_000], np.uint32))])


# mixing


def size_of(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def filled(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).withColumn("taken", F.col("size") * F.col("copies")).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += size_of(t)
    want = filled(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    largest = max(size_of(t) for _, t, *_ in rows)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    again = mixing.mix(docs.repartition(5)).withColumn("taken", F.col("size") * F.col("copies")).collect()
    key = lambda x: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in x)
    assert key(got) == key(again), "reruns agree"
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []


def test_mixed_documents(docs):
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(once).collect() if r["copies"]}
    out = mixing.mixed_documents(once)
    assert out.columns == once.columns
    assert collections.Counter(r["doc_id"] for r in out.collect()) == copies


def test_mixed_documents_of_repeated_rows(docs, rows):
    """Rows alike in every column take together what ``mix`` gives them; rows alike but for the source are of their own."""
    twice = docs.unionByName(docs.limit(20)).cache()
    want = collections.Counter()
    for r in mixing.mix(twice).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = collections.Counter((r["doc_id"], r["source"], size_of(r["text"])) for r in mixing.mixed_documents(twice).collect())
    assert got == +want


# SimHash


def test_deduplicated_keeps_texts_that_share_an_id(spark):
    words = lambda k: " ".join(f"{k}w{i}" for i in range(80))
    rows = [(1, words("a")), (1, words("b")), (2, words("b")), (None, words("c")), (None, words("d")), (3, words("a")), (1, words("a")), (None, words("c"))]
    left = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text[0]) for r in left.collect()) == [(0, "c"), (0, "d"), (1, "a"), (1, "b")]


def test_trie_join_is_complete():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    close = base[r.integers(0, 40, 400)] ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64))
    v = np.unique(np.concatenate([base, close]))
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= 2}
    got = {(int(i), int(j)) for a, b in simhash.trie_join(v, None, 2) for i, j in zip(a, b, strict=True)}
    assert got == want
    left, right = v[::2].copy(), v[1::2].copy()
    want = {(i, j) for i in range(len(left)) for j in range(len(right)) if int(left[i] ^ right[j]).bit_count() <= 2}
    assert {(int(i), int(j)) for a, b in simhash.trie_join(left, right, 2) for i, j in zip(a, b, strict=True)} == want


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows, empty, unique):
    got = simhash.near_duplicates(docs.filter(F.col("doc_id").isin(list(unique)))).collect()
    fps = {d: brute_fingerprint(t) for d, t in unique.items()}
    want = components(fps)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{fps[d]:016x}", want[d]) for d in unique}
    whole = simhash.near_duplicates(docs)
    assert whole.count() == len(rows)
    assert simhash.near_duplicates(empty).collect() == []
    left = simhash.deduplicated(docs.filter(F.col("doc_id").isin(list(unique))))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values())) and left.columns == docs.columns


@pytest.mark.parametrize("large", [1 << 20, 16])
def test_simhash_dense_and_chained(spark, large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", large)
    if large == 16:  # more top levels than may be broadcast
        monkeypatch.setattr(simhash, "LEVELS", 3)
        monkeypatch.setattr(simhash, "PIECE", 4)
    r = random.Random(2)
    center = r.getrandbits(63)
    fps = {center ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)} | {center ^ ((1 << k) - 1) for k in range(0, 60, 2)}
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from tarn.llm.graph import connected_components

    found = connected_components(simhash.fingerprint_links(classes, 2)).collect()
    assert len(found) == len(fps) - 1 and len({x.root for x in found}) == 1


# extraction


def test_parser_cases():
    page = "<html><head><title>t</title><style>p{}</style></head><body><!-- no --><p>One &amp; <b>two<br>three<p>x < y<script>var a='</p>'</script></div><ul><li>a<li>b</ul>tail &#233;&nbsp;end</body>"
    assert [b.text for b in blocks.parse(page)] == ["One & two three", "x < y", "a", "b", "tail é end"]
    assert blocks.parse("") == [] and blocks.parse("<p") == [] and blocks.parse("<!-- open") == []
    assert [b.text for b in blocks.parse('<p class="a>b">q</p><p title="x>one</p>')][:1] == ["q"]
    deep = "<div>" * 5000 + "in" + "</div>" * 5000
    assert [b.text for b in blocks.parse(deep)] == ["in"]


def test_labeller_held_out():
    right, whole = train_html.accuracy(extract.labeller(), train_html.examples(200, 12345))
    assert right > 0.995 and whole > 0.95


def test_gradients():
    net = bilstm.BiLSTM.fresh(5, 3, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, mask = bilstm.padded([r.normal(size=(4, 5)), r.normal(size=(2, 5))])
    y = (r.random(mask.shape) > 0.5).astype(float)
    _, g = net.gradients(x, mask, y)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        k = int(r.integers(len(flat)))
        old = flat[k]
        flat[k] = old + 1e-3
        up = net.gradients(x, mask, y)[0]
        flat[k] = old - 1e-3
        down = net.gradients(x, mask, y)[0]
        flat[k] = old
        assert math.isclose((up - down) / 2e-3, g[name].reshape(-1)[k], rel_tol=2e-2, abs_tol=2e-4)


def test_extraction(spark):
    main = "<article><h1>Title here</h1><p>First paragraph of the story, with words.</p><p>Second one follows here.</p></article>"
    page = f"<html><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul></nav><div class='cookie-notice'><p>We use cookies, accept them.</p></div>{main}<section class='comments'><h3>Comments</h3><div class='comment'><p>I liked it a lot.</p></div></section><footer>&copy; someone 2020</footer></body></html>"
    rows = [(1, "u", page, 0), (2, None, None, 0), (3, "u", "", 0), (1, "u", page, 0), (4, "u", "<p>" + LONG, 0)]
    got = {(r.page_id, r.text, r.n_chars) for r in extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    want = "Title here\nFirst paragraph of the story, with words.\nSecond one follows here."
    assert (1, want, len(want)) in got and (2, "", 0) in got and (3, "", 0) in got
    assert extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# substring dedup


def brute_repeats(rows, k=13):
    least = {}
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in split:
        for i in range(len(w) - k + 1):
            if d is not None:
                key = tuple(w[i : i + k])
                least[key] = min(least.get(key, d), d)
    out = collections.Counter()
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if d is not None and least[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out[d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode("utf-8", "replace")] += 1
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_substrings(docs, rows, empty, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(superkmers, "HOT_LEAST", 1)
        monkeypatch.setattr(superkmers, "HOT_PART", 1 << 40)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in superkmers.without_repeats(docs.select("doc_id", "text", "term")).collect())
    want = brute_repeats(rows)
    assert got == want and sum(k[2] for k in want) > 0
    assert superkmers.without_repeats(empty).collect() == []


def test_substrings_of_a_hot_passage(spark, monkeypatch):
    """One passage in 30,000 documents: no bucket gets more than its share of the ranges, all but the first document lose it."""
    monkeypatch.setattr(superkmers, "FLUSH_BYTES", 1 << 16)
    passage = " ".join(f"p{i}" for i in range(14))
    docs = spark.range(30_000).repartition(8).selectExpr("id as doc_id", f"concat('x', id, ' {passage} y', id) as text")
    left = superkmers.without_repeats(docs).groupBy("n_removed").count().collect()
    assert {(r.n_removed, r["count"]) for r in left} == {(0, 1), (14, 29_999)}


def test_super_k_mer_hash_collisions_are_settled(monkeypatch):
    entries = lambda doc, text: superkmers._pack([(text.encode(), [doc, 0, 0])], [])
    a, b = " ".join(f"a{i}" for i in range(13)), " ".join(f"b{i}" for i in range(13))
    monkeypatch.setattr(superkmers.Words, "windows", lambda self, k, at: np.zeros(len(at), np.uint64))
    found = superkmers.decide([entries(1, a), entries(2, b), entries(3, b)], 13)
    assert found.tolist() == [[3, 0, 0, 13]]


# quality


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = collections.Counter(grams)
    covered = [False] * len(w)
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered[i : i + 3] = [True] * 3
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), sum(covered)


def test_quality_counts(docs, rows, empty):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judged(docs).collect())
    want = collections.Counter()
    for d, t, *_ in rows:
        c = brute_counts(t)
        want[d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]] += 1
    assert got == want
    assert quality.judged(empty).collect() == [] and quality.kept_documents(empty).collect() == []
    assert quality.kept_documents(docs).columns == docs.columns


def test_quality_outliers(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        w = ["".join(r.choices("abcdefghij", k=max(1, int(r.gauss(5, 2))))) for _ in range(r.randint(60, 300))]
        junk = i % 5 == 0
        rows.append((i, " ".join(x + "###" if junk else x for x in w), "en", "a" if i % 3 else "b"))
    kept = {x.doc_id: x.kept for x in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] == (i % 5 != 0) for i in kept)


def test_quality_judges_every_count(spark):
    """Texts whose only oddity is repeated lines, or repeated words; one repeated line in a short text is none."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghij", k=max(1, int(r.gauss(5, 2)))))
    line = lambda k: " ".join(word() for _ in range(k))
    rows = [(i, "\n".join(line(30) for _ in range(8)), "en", "a") for i in range(300)]
    short = line(2)  # too short for a window of its own
    odd = [(1000, "\n".join([line(12) for _ in range(20)] + [short] * 39), "en", "a")]
    phrase = line(12)
    odd.append((1001, " ".join([line(13) + " " + phrase for _ in range(20)]), "en", "a"))
    lines = [line(30) for _ in range(7)]
    fine = [(2000, "\n".join([*lines, lines[0]]), "en", "a"), (2001, "\n".join(lines + [short] * 2), "en", "a")]
    got = {x.doc_id: x for x in quality.judged(spark.createDataFrame(rows + odd + fine, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[d].base_failed for d in got)
    assert got[1000].n_dup_lines == 38 and not got[1000].kept and not got[1001].kept
    assert all(got[d].kept for d in got if d < 1000 or d >= 2000)


def test_quality_scatter_decides(spark):
    """One and the same text is odd where word lengths hardly vary and none where they vary more; a constant rule would judge both alike."""
    r = random.Random(12)
    line = lambda k, n: " ".join("".join(r.choices("abcdefghij", k=n if r.random() < 0.5 else n + 2)) for _ in range(k))
    rows = [(i, line(120, 6), "en", "even") for i in range(200)]
    rows += [(1000 + i, line(120, r.choice([4, 5, 6, 6, 7, 7, 8, 9])), "en", "wide") for i in range(200)]
    one = line(120, 9)
    rows += [(2000, one, "en", "even"), (2001, one, "en", "wide")]
    got = {x.doc_id: x for x in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[2000].kept and got[2001].kept
    assert all(got[i].kept for i in got if i < 2000)


def test_consistency_is_that_of_a_trimmed_normal():
    z = np.random.default_rng(2).normal(size=400_000)
    core = np.sort(np.abs(z))[: int(quality.SHARE * len(z))]
    assert math.isclose(quality.CONSISTENCY * np.mean(core**2), 1, rel_tol=0.02)


def test_distance_is_mahalanobis(spark):
    r = np.random.default_rng(1)
    a = r.normal(size=(4, 4))
    cov, mean, x = a @ a.T + np.eye(4), r.normal(size=4), r.integers(-9, 9, 4)
    est = spark.createDataFrame([("l", "s", *mean.tolist(), *[float(cov[i, j]) for i in range(4) for j in range(i + 1)])], "lang string, source string, " + ", ".join([f"m{i} double" for i in range(4)] + [f"s{i}{j} double" for i in range(4) for j in range(i + 1)]))
    row = spark.createDataFrame([("l", "s", *map(int, x))], "lang string, source string, f0 long, f1 long, f2 long, f3 long")
    assert math.isclose(quality._distance(row, est).first()["d2"], float((x - mean) @ np.linalg.solve(cov, x - mean)), rel_tol=1e-9)


# lines


def brute_lines(rows, least=40, docs=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(d)
    out = collections.Counter()
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < least or len(held[key(x)]) < docs or d == max((y for y in held[key(x)] if y is not None), default=None)]
        out[d, len(ls), len(ls) - len(kept), "\n".join(kept)] += 1
    return out


def as_counter(df):
    return collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect())


def test_lines(docs, rows, empty, monkeypatch):
    index = lines.LineIndex.build(docs)
    want = brute_lines(rows)
    assert as_counter(index.cleaned(docs)) == want and sum(k[2] for k in want) > 0
    monkeypatch.setattr(lines, "FILTER_BYTES", -1)
    monkeypatch.setattr(lines, "PACK_DIGESTS", 20)
    assert as_counter(index.cleaned(docs)) == want, "the same with filters that come by a join"
    monkeypatch.setattr(lines, "SHARD_DIGESTS", 1)
    many = lines.LineIndex.build(docs)
    assert as_counter(many.cleaned(docs)) == want
    assert lines.LineIndex.build(empty).cleaned(empty).collect() == []


def test_lines_can_be_undone(spark, rows):
    base = [(d, t, None, None) for d, t, *_ in rows if d is not None and d != 5]
    first, second = base[:35], base[35:]
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string, a string, b string")
    index = lines.LineIndex.build(make(first))
    both = index.insert(make(second))
    assert as_counter(both.cleaned(make(base))) == brute_lines(base)
    back = both.delete(make(second).select("doc_id"))
    assert as_counter(back.cleaned(make(first))) == brute_lines(first)
    state = lambda x: sorted((bytes(r.digest), r.n_docs, r.last_doc) for r in x.counts.collect())
    assert state(back) == state(index)


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    f = cuckoo.CuckooFilter.of(keys)
    arr = lambda ks: np.frombuffer(b"".join(ks), np.uint8).reshape(-1, 16)
    assert f.contains(arr(keys)).all()
    assert f.contains(arr([hashlib.md5(f"n{i}".encode()).digest() for i in range(5000)])).mean() < 0.01
    assert all(f.delete(k) for k in keys[:2500])
    again = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
    assert again.contains(arr(keys[2500:])).all() and again.contains(arr(keys[:2500])).mean() < 0.02


# language model


def brute_katz(rows, order):
    toks = [(d, (t or "").encode().lower().split() + ["</s>"], d is not None and zlib.crc32(str(d).encode()) % 5 == 1) for d, t, *_ in rows]
    count = [collections.Counter() for _ in range(order)]
    ctx = collections.Counter()
    for _, t, held in toks:
        if not held:
            for n in range(1, order + 1):
                padded = ["<s>"] * (n - 1) + t
                own = [tuple(padded[i : i + n]) for i in range(len(t))]
                count[n - 1].update(own)
                ctx.update(g[:-1] for g in own if n > 1)
    words = count[0]
    n, v = sum(words.values()), len(words)
    hist = lambda c: [sum(1 for x in c.values() if x == r) for r in range(1, katz.K + 2)]
    d = [katz.discounts(hist(c)) for c in count]
    kept = lambda c, d: c * d[c] if c <= katz.K else c - katz.REST
    left = sum(c - kept(c, d[0]) for c in words.values()) / n
    unseen = max(left, 1 / (n + 1))
    a, b = collections.Counter(), collections.Counter()

    def p(g):
        if len(g) == 1:
            return kept(words[g], d[0]) * (1 - unseen) / (1 - left) / n if words[g] else unseen
        c, x = count[len(g) - 1][g], g[:-1]
        if c:
            return kept(c, d[len(g) - 1]) / ctx[x]
        return p(g[1:]) * (a[x] / ctx[x] / (1 - b[x]) if ctx[x] else 1)

    for m in range(2, order + 1):
        for g, c in count[m - 1].items():
            a[g[:-1]] += c - kept(c, d[m - 1])
            b[g[:-1]] += p(g[1:])
    out = []
    for doc, t, held in toks:
        padded = ["<s>"] * (order - 1) + t
        base = sum(math.log10((words[(w,)] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = sum(math.log10(p(tuple(padded[i : i + order]))) for i in range(len(t)))
        out.append((doc, held, len(t), sum(words[(w,)] > 0 for w in t), n, base, score))
    return out, p, count


def close(got, want):
    key = lambda x: (x[0] is None, x[0] or 0, *x[2:4], round(x[6], 4))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == tuple(w[:5]) and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz(docs, rows, empty, order):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 1
    model, scores = katz.KatzModel.fit_and_score(docs, ~held, order)
    want, p, count = brute_katz(rows, order)
    close([tuple(r) for r in scores.collect()], want)
    for context in [("<s>",) * (order - 1), next(iter(count[order - 2])), ("</s>",) * (order - 1)]:
        assert math.isclose(sum(p((*context, *w)) for w in count[0]) + p((*context, "never seen")), 1, rel_tol=1e-9)
    fresh = model.score(docs)
    close([(*tuple(r)[:1], True, *tuple(r)[2:]) for r in fresh.collect()], [(w[0], True, *w[2:]) for w in want])
    assert katz.KatzModel.fit_and_score(empty, F.lit(True), order)[1].collect() == []
    assert katz.KatzModel.fit_and_score(docs, F.lit(False), order)[1].count() == len(rows), "nothing to learn from"


# top-k


def brute_topk(vectors, k=20):
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(64 * x) for x in v]
    out = set()
    for q in whole:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=False)), c) for c in whole if c != q)
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("n", [3, 700])
def test_topk(spark, n, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    r = np.random.default_rng(3)
    base = r.normal(size=(n, 8))
    base[n // 3 : 2 * n // 3] = base[0]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(None, [1.0] * 8), (9001, None), (9002, [None] + [1.0] * 7), (9003, [float("nan")] * 8), (9004, [float("inf")] * 8), (9020, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {tuple(x) for x in topk.top_k(df, df.filter("vec_id % 20 = 0")).collect()}
    assert got == brute_topk(rows)


def test_topk_large_components(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=6) * 10.0 ** (i % 8)).astype(np.float32).tolist()) for i in range(120)]
    got = {tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), spark.createDataFrame(rows[::20], "vec_id long, embedding array<float>")).collect()}
    assert got == brute_topk(rows)
    huge = spark.createDataFrame([(i, [1e300 * (i - 1), 1e3]) for i in range(40)], "vec_id long, embedding array<double>")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.top_k(huge, huge.filter("vec_id = 20")).collect()}
    assert len(got) == 20, "scores beyond 64 bits have no defined order"


def test_topk_parts_beyond_64_bits(spark):
    """Scores near 2**63, and parts far beyond it whose sums fit."""
    rows = [(20, [2.0**25, 0.0]), (21, [2.0**25, 0.0]), (22, [2.0**24, 0.0]), (23, [2.0**26 - 64, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(x.rank, x.vec_id, x.score) for x in topk.top_k(df, df.filter("vec_id = 20")).orderBy("rank").collect()] == [(1, 23, 2**63 - 2**43), (2, 21, 2**62), (3, 22, 2**61)]
    r = np.random.default_rng(6)
    rows = []
    for i in range(100):
        a, small = float(r.integers(1, 1 << 40)), r.integers(-(1 << 20), 1 << 20, 2)
        # the two lists' products with another such row nearly cancel out
        rows.append((i, [a, float(small[0]), a if i % 20 else -a, float(small[1])]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = {x for x in brute_topk([(i, v) for i, v in rows if i % 20 or i == 20]) if x[0] == 20}
    assert all(abs(x[3]) < 1 << 63 for x in want)
    got = {tuple(x) for x in topk.top_k(df.filter("vec_id % 20 <> 0 or vec_id = 20"), df.filter("vec_id = 20")).collect()}
    assert got == want


def test_topk_scores_few_pairs_of_clustered_vectors(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(30, 32))
    rows = [(i, (centres[i % 30] + 0.2 * r.normal(size=32)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    search = topk.Search(df, df.filter("vec_id % 20 = 0"), 20, 64)
    got = {tuple(x) for x in search.run().collect()}
    assert got == brute_topk(rows)
    pairs = 300 * 5999
    print(search.counts, pairs)
    assert search.counts["second"] + search.counts["named"] < 0.1 * pairs


def test_topk_sends_rows_of_tiles(spark, monkeypatch):
    """Tables between the phases have a row for a tile, not for an entry, and a unit's vectors go to one task once."""
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    written, save = {}, topk.saved
    monkeypatch.setattr(topk, "saved", lambda df, name, *a: written.setdefault(name, save(df, name, *a)))
    r = np.random.default_rng(11)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(700, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert {tuple(x) for x in topk.top_k(df, df.filter("vec_id % 20 = 0")).collect()} == brute_topk(rows)
    blocks, queries = (written[n].filter("list = 0").count() for n in ("topk-blocks", "topk-query-blocks"))
    assert blocks > 5 and queries > 2
    assert 0 < written["topk-first"].count() <= 2 * blocks * queries
    assert written["topk-limits"].count() == 2 * queries
    # a list has four components that two bytes hold
    assert written["topk-blocks"].agg(F.max(F.length("part") / (F.length("alone") / 8))).first()[0] < 4 * 2 + 1


@pytest.mark.parametrize(("lists", "dims"), [(2, 1), (3, 7)])
def test_topk_other_lists(spark, monkeypatch, lists, dims):
    """One list has no entries to complete, three have two steps of it; nearly all scores are ties."""
    for name, value in (("BLOCK", 64), ("QUERY_BLOCK", 8), ("LISTS", lists), ("STEP", 3), ("SENT", 5), ("WAITING", 50)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(12)
    rows = [(i, (r.integers(-2, 3, dims) / 64).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert {tuple(x) for x in topk.top_k(df, df.filter("vec_id % 20 = 0")).collect()} == brute_topk(rows)


@pytest.mark.parametrize("kind", [np.float32, np.float64, np.int64])
def test_topk_best_places(kind):
    r = np.random.default_rng(13)
    for size, n in [(5, 5), (40, 7), (2048, 30), (5000, 30), (5000, 1)]:
        near = r.integers(-50, 50 if n == 7 else 5000, (9, size)).astype(kind)
        near[3] = 7  # ties
        near[4, 1:] = topk.LEAST
        near[5] = topk.LEAST
        high, rows, cols = topk._best_places(near, n)
        assert high.tolist() == near.max(1).tolist() and (np.diff(rows) >= 0).all()
        for i in range(9):
            got, want = sorted(near[i, cols[rows == i]].tolist()), sorted(near[i].tolist())[size - n :]
            assert got == [x for x in want if x > topk.LEAST] and len(set(cols[rows == i].tolist())) == len(got)


def test_topk_thresholds_are_rounded_down():
    for x in [0, 1, -1, (1 << 24) + 1, -(1 << 24) - 1, (1 << 53) - 1, -(1 << 53) + 1, topk.MOST_PART, topk.LEAST]:
        for kind in (np.float32, np.float64, np.int64):
            assert int(topk._below(np.array([x]), np.dtype(kind))[0]) <= x


def test_topk_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none).collect() == [] and topk.top_k(one, one).collect() == [] and topk.top_k(one, none).collect() == []


# columns of the caller


def test_helper_names_of_the_caller(spark):
    """Columns that are called as the operators' own helpers stay as they are."""
    names = ["_tarn_id", "__tarn_id", "_tarn_m", "_tarn_mark", "_tarn_spans", "_tarn_drops", "drops", "mark", "d2"]
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text, "en", "s", *[f"{c}{i}" for c in names]) for i in range(6)], ["doc_id", "text", "lang", "source", *names])
    for out, n in ((superkmers.without_repeats(docs), 6), (lines.LineIndex.build(docs, min_docs=5).cleaned(docs), 6), (quality.kept_documents(docs), 6)):
        assert set(docs.columns) <= set(out.columns)
        got = out.collect()
        assert len(got) == n and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)
    assert sorted(r.n_removed for r in superkmers.without_repeats(docs).collect()) == [0] + [60] * 5
    assert sorted(r.n_dropped for r in lines.LineIndex.build(docs, min_docs=5).cleaned(docs).collect()) == [0] + [1] * 5


# very long texts


def test_long_text(spark):
    docs = spark.createDataFrame([(1, LONG, "en", "s"), (2, LONG + " end", "en", "s")], "doc_id long, text string, lang string, source string")
    assert bpe.encode_documents(docs).count() == 2
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {1}
    assert {(r.doc_id, r.n_removed) for r in superkmers.without_repeats(docs).collect()} == {(1, 0), (2, 30_000)}
    assert quality.judged(docs).count() == 2
    assert {r.n_tokens > 30_000 for r in tokenfiles.read_tokens(tokenfiles.write_tokens(docs)).collect()} == {True}
    assert {r["size"] for r in mixing.mix(docs).collect()} == {30_000, 30_001}
    assert {r.n_dropped for r in lines.LineIndex.build(docs, min_docs=1).cleaned(docs).collect()} == {0}
    assert {r.n_tokens for r in katz.KatzModel.fit_and_score(docs, F.lit(True))[1].collect()} == {30_001, 30_002}


def test_discounts_have_bounds():
    assert all(0 < d <= 1 for h in ([0] * 6, [5, 0, 0, 0, 0, 0], [100, 40, 20, 10, 8, 5], [1, 50, 2, 9, 9, 9]) for d in katz.discounts(h))
    assert json.dumps(katz.discounts([100, 40, 20, 10, 8, 5]).tolist())
