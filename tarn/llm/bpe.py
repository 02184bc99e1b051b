"""BPE encoding by speculation and verification, and decoding.

A word is first cut greedily into the longest vocabulary entries. That guess is the exact result if and
only if every entry encodes to itself and every adjacent pair is compatible: merging the pair's bytes
alone would give the same two tokens, so no merge ever crosses the border. Compatibility is tested for
all pairs of a batch at once in numpy, by undoing both tokens' merges along the border, last merge first.
Only words with a failing pair are merged exactly, pair by pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

NEVER = 1 << 30
#: Texts are split and looked up in slices of this many bytes, and so many encoded words are remembered.
SLICE_BYTES = 4 << 20
MEMORY_WORDS = 400_000
MEMORY_BYTES = 48
#: Texts of letters below this one are cut by the file's pattern here.
PLAIN = "\u0250"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordBPE:
    """The encoder of a tokenizer file with byte-level words and a word-end suffix, and its decoder."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        end = model["end_of_word_suffix"]
        letters = {c: b for b, c in byte_letters().items()}
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.mid: dict[bytes, int] = {}
        self.end: dict[bytes, int] = {}
        for token, i in vocab.items():
            last = token.endswith(end) and token != end
            raw = bytes(letters[c] for c in (token[: -len(end)] if last else token))
            (self.end if last else self.mid)[raw] = i
        n = max([*vocab.values(), *self.specials.values()]) + 1
        self.n = n
        self.longest = max(map(len, self.end))
        self.reach: dict[bytes, int] = {}  # by the first three bytes, the longest entry inside a word
        for raw in self.mid:
            self.reach[raw[:3]] = max(len(raw), self.reach.get(raw[:3], 0))
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        keys = []
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges[x, y] = r, z
            self.rank[z], self.left[z], self.right[z] = r, x, y
            keys.append(x * n + y)
        self._rank_of = {k: r for r, k in enumerate(keys)}
        self._made = [z for _, z in self.merges.values()]
        order = np.argsort(np.array(keys))
        self._keys, self._ranks = np.array(keys)[order], order.astype(np.int64)
        made = np.flatnonzero(self.rank >= 0)
        # a token encodes to itself if both its parts do and nothing merges across their border before they do
        alone = np.ones(n, bool)
        calm = np.ones(n, bool)
        calm[made] = self._border(self.left[made], self.right[made], first=False)
        calm[made] &= (self.rank[self.left[made]] < self.rank[made]) & (self.rank[self.right[made]] < self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            alone[t] = calm[t] and alone[self.left[t]] and alone[self.right[t]]
        self.alone = alone
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._find = regex.compile(pattern).findall
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        texts = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self._texts = [texts.get(i, "").encode() for i in range(n)]
        self._memory: dict[bytes, bytes] = {}
        self._words: dict[bytes, bytes] = {}
        self._path, self._lib, self._bytes = path, None, letters

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NEVER)

    def _border(self, a: np.ndarray, b: np.ndarray, first: bool = True) -> np.ndarray:
        """Whether no merge crosses the border of a | b. first=False leaves out the merge of a and b themselves."""
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        until_a, until_b = np.full(len(a), NEVER), np.full(len(a), NEVER)  # when each piece is merged away
        while len(at):
            if first:
                r = self._merge_rank(a, b)
                # on a tie the left pair goes first
                bad = (r < until_a) & (r <= until_b)
                ok[at[bad]] = False
            else:
                bad = np.zeros(len(at), bool)
                first = True
            ra, rb = self.rank[a], self.rank[b]
            on = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, until_a, until_b, ra, rb = at[on], a[on], b[on], until_a[on], until_b[on], ra[on], rb[on]
            undo = ra > rb
            until_a = np.where(undo, ra, until_a)
            until_b = np.where(undo, until_b, rb)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.alone[a] & self.alone[b] & self._border(a, b)

    def propose(self, word: bytes) -> list[int] | None:
        """Greedy longest match; None if a piece has no entry (then only merging tells)."""
        n, i, out = len(word), 0, []
        mid, end, longest, reach = self.mid, self.end, self.longest, self.reach
        while i < n:
            if n - i <= longest and (t := end.get(word[i:])) is not None:
                out.append(t)
                return out
            for j in range(min(n - 1, i + reach.get(word[i : i + 3], 2)), i, -1):
                if (t := mid.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return None
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of the lowest rank, the leftmost on a tie."""
        ids = [self.mid[word[i : i + 1]] for i in range(len(word) - 1)] + [self.end[word[-1:]]]
        if len(ids) > 64:
            return self._merge_long(ids)
        n, get, made = self.n, self._rank_of.get, self._made
        ranks = [get(x * n + y, NEVER) for x, y in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) < NEVER:
            i = ranks.index(r)
            ids[i : i + 2] = [made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * n + ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] * n + ids[i + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        nxt, prev = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(*m, i, x, y) for i, (x, y) in enumerate(zip(ids, ids[1:], strict=False)) if (m := self.merges.get((x, y)))]
        heap = [(r, i, z, x, y) for r, z, i, x, y in heap]
        heapq.heapify(heap)
        while heap:
            _, i, z, x, y = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j], nxt[i] = z, -1, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for p, q in ((prev[i], i), (i, nxt[i])):
                if p >= 0 and q >= 0 and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, m[1], ids[p], ids[q]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Words of the pre-tokenizer, as bytes, to ids: propose, verify all borders at once, merge what fails."""
        guess = [self.propose(w) for w in words]
        sizes = np.array([len(g) if g else 0 for g in guess], np.int64)
        flat = np.array([t for g in guess if g for t in g], np.int64)
        ok = sizes > 0
        if len(flat):
            owner = np.repeat(np.arange(len(words)), sizes)
            inner = owner[1:] == owner[:-1]
            bad = owner[~self.alone[flat]]
            a, b, own = flat[:-1][inner], flat[1:][inner], owner[1:][inner]
            pair, back = np.unique(a * self.n + b, return_inverse=True)
            fits = self._border(pair // self.n, pair % self.n)[back]
            ok[bad] = False
            ok[own[~fits]] = False
        return [g if good else self.merge(w) for w, g, good in zip(words, guess, ok.tolist(), strict=True)]

    def _pieces(self, part: str) -> list[bytes]:
        if part.isalpha() and part.isascii():
            return [part.lower().encode()]
        if part[:-1].isalpha() and part.isascii() and not part[-1].isalnum():
            return [part[:-1].lower().encode(), part[-1].encode()]
        if max(part, default="") < PLAIN:
            return [p.encode() for p in self._find(unicodedata.normalize("NFC", part).lower())]
        # beyond Latin letters Unicode versions differ in what a letter is: the tokenizer's own steps decide
        lib = self._library()
        found = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(part))
        return [bytes(self._bytes[c] for c in p) for p, _ in found]

    def _library(self):
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self._path)
        return self._lib

    def learn(self, parts: list[bytes]) -> None:
        """Encode texts without ASCII white space and remember their ids as little-endian bytes."""
        plans = []
        for raw in parts:
            text = raw.decode("utf-8", "replace")
            if "<" not in text or not self._special:
                plans.append(self._pieces(text))
                continue
            plan: list[int | bytes] = []
            at = 0
            for m in self._special.finditer(text):
                plan += self._pieces(text[at : m.start()])
                plan.append(self.specials[m.group()])
                at = m.end()
            plan += self._pieces(text[at:])
            plans.append(plan)
        words = {p for plan in plans for p in plan if isinstance(p, bytes)}
        new = list(words - self._words.keys())
        if len(self._words) + len(new) > MEMORY_WORDS:
            self._words.clear()
            new = list(words)
        found = self.encode_words(new)
        flat, ends = np.array([t for x in found for t in x], "<u4").tobytes(), np.cumsum([4 * len(x) for x in found]).tolist()
        self._words.update(zip(new, [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        for raw, plan in zip(parts, plans, strict=True):
            self._memory[raw] = b"".join(self._words[p] if isinstance(p, bytes) else p.to_bytes(4, "little") for p in plan)
        for w in new:
            if len(w) > MEMORY_BYTES:
                del self._words[w]

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Whole texts to their ids, as little-endian unsigned 32-bit integers.

        Normalisation and word rules never reach across ASCII white space, so what stands between is encoded once and remembered.
        """
        split = [folded(t).split() for t in texts]
        new = set().union(*split) - self._memory.keys()
        if len(self._memory) + len(new) > MEMORY_WORDS:
            self._memory.clear()
            new = set().union(*split)
        self.learn(list(new))
        out = [b"".join(map(self._memory.__getitem__, parts)) for parts in split]
        for w in new:
            if len(w) > MEMORY_BYTES:
                del self._memory[w]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """As the tokenizer file says (it names no decoder): the tokens with a space between, special ones included."""
        return b" ".join(map(self._texts.__getitem__, ids.tolist()))


def folded(raw: bytes) -> bytes:
    """Lower case beforehand where that is all that normalisation does, so that fewer words are new: Latin-1 without special tokens."""
    if b"<|" in raw:
        return raw
    if raw.isascii():
        return raw.lower()
    text = raw.decode("utf-8", "replace")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return raw
    return text.lower().encode()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(2)
def encoder(path: str | None) -> WordBPE:
    """One a worker; the path is looked up there when none is given."""
    return WordBPE(path or default_path())


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a binary column in runs of about ``limit`` bytes; null as empty."""
    start, run, size = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t.as_py() or b"")
        size += len(run[-1])
        if size >= limit:
            yield start, run
            start, run, size = i + 1, [], 0
    if run:
        yield start, run


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 (and ids, as little-endian bytes) to the doc_id of each row.

    Null and empty texts have no tokens and decode to an empty text. Nothing is shuffled: each row is
    encoded where it is read, in slices, so memory follows the slice and the longest text. Repeated rows
    repeat in the result; other columns don't matter; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                n, ids_sha, text_sha, kept = [], [], [], []
                for ids in bpe.encode_batch(texts):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4"))).hexdigest())
                    kept.append(ids)
                cols = [batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                yield pa.record_batch([*cols, *([pa.array(kept, pa.binary())] if with_ids else [])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
