"""A context-mixing range coder for 16-bit token ids: many blocks side by side, one numpy lane each.

All blocks of a call share one model, which learns from every lane at each step; they decode together. For each id
the model offers the id last seen after the two ids before (order 2), after the one before (order 1), and the counts of the
ids that neither foresaw (order 0). One symbol says which of them was right, or that the id is new. Each order predicts
that symbol: order 2 by how sure its candidate is, order 1 by how sure its own is, both by whether the candidates agree and which order
was right last, order 0 by the latter alone. The three are mixed by weights that are learnt for each context of all
these (expectation and maximisation: a weight is the share of what came that its order answers for). As the contexts are few,
predictions are mixed for all of them at once, every few steps. A place in order 0 or the plain bits follow, in the same step of the
coder (all of the range if an order was right). All arithmetic is integer.
"""

from __future__ import annotations

import numpy as np

FAR_BITS = 18
SYMBOLS, NEW = 4, 3
#: How sure each order is, whether they agree, which was right last.
CONTEXTS = (4, 4, 2, SYMBOLS)
FLAG_BITS, COUNT_BITS, SHARE_BITS = 15, 17, 14
#: Predictions and counts are made anew after 1, 2, 4 steps and so on, then after so many.
MIX_EVERY, COUNT_EVERY = 16, 64
DECAY = 5
IDS = 1 << 16
ONE_SURE, ID_MASK = np.int32(1 << 16), np.int32(IDS - 1)
U32, LEAST = np.uint64(32), np.uint64(1 << 32)
BY_FLAG, BY_COUNT = np.uint64(FLAG_BITS), np.uint64(COUNT_BITS)
WORD = np.uint64((1 << 32) - 1)


def _shares(counts: np.ndarray) -> np.ndarray:
    return ((counts + 1) << SHARE_BITS) // (counts.sum(-1, keepdims=True) + SYMBOLS)


class _Model:
    """What n lanes share. ``look`` gives the candidates and the context, ``learn`` takes the ids that came."""

    def __init__(self, n: int):
        # an entry is an id with how sure it is above
        self.near, self.far = np.zeros(IDS, np.int32), np.zeros(1 << FAR_BITS, np.int32)
        self.prev1, self.prev2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.last = np.full(n, 2, np.uint8)
        self.step = 0
        self.seen, self.fresh = np.zeros((*CONTEXTS, SYMBOLS), np.int64), np.zeros(np.prod(CONTEXTS) * SYMBOLS, np.int64)
        self.credit = np.full((3, *CONTEXTS), 64, np.int64)
        self._mix()
        # order 0: the counts; each id known at the last count has a place, a new one its plain bits and the same range as all
        self.counts = np.zeros(IDS, np.int64)
        self.missed: list[np.ndarray] = []
        self.kind = np.full(IDS, NEW, np.uint8)
        self.plain = np.arange(IDS, dtype=np.uint64) << np.uint64(1)
        self.start0, self.size0 = self.plain, np.full(IDS, 2, np.uint64)
        self.place = np.zeros(1 << COUNT_BITS, np.uint16)

    def _mix(self) -> None:
        by2, by1, by0 = self.seen.sum(1), self.seen.sum(0), self.seen.sum((0, 1, 2))
        self.predicted = [np.broadcast_to(p, (*CONTEXTS, SYMBOLS)) for p in (_shares(by2)[:, None], _shares(by1)[None], _shares(by0)[None, None, None])]
        whole = self.credit.sum(0)
        self.weights = [(c << SHARE_BITS) // whole for c in self.credit]
        self.mixed = 1 + (sum(w[..., None] * p for w, p in zip(self.weights, self.predicted, strict=True)) >> SHARE_BITS)
        cum = np.zeros((self.mixed.size // SYMBOLS, SYMBOLS + 1), np.int64)
        np.cumsum(self.mixed.reshape(-1, SYMBOLS), 1, out=cum[:, 1:])
        cum = cum * ((1 << FLAG_BITS) - SYMBOLS) // cum[:, -1:] + np.arange(SYMBOLS + 1)
        self.start, self.size = cum[:, :-1].ravel().astype(np.uint64), np.diff(cum).ravel().astype(np.uint64)
        self.bounds = [np.ascontiguousarray(cum[:, k]).astype(np.int16) for k in range(1, SYMBOLS)]

    def _mix_again(self) -> None:
        new = self.fresh.reshape(self.seen.shape) << 4
        for k, (w, p) in enumerate(zip(self.weights, self.predicted, strict=True)):
            own = (new * (w[..., None] * p // self.mixed) >> SHARE_BITS).sum(-1)
            self.credit[k] += own - (self.credit[k] - 64 >> DECAY)
        self.seen += new - (self.seen >> DECAY)
        self.fresh[:] = 0
        self._mix()

    def _count_again(self) -> None:
        self.counts += np.bincount(np.concatenate(self.missed), minlength=IDS)
        self.missed.clear()
        known = self.counts > 0
        cum = np.zeros(IDS + 1, np.int64)
        np.cumsum(self.counts, out=cum[1:])
        if not cum[-1]:
            return
        places = np.concatenate([[0], np.cumsum(known)])
        cum = cum * ((1 << COUNT_BITS) - int(places[-1])) // cum[-1] + places
        size = np.diff(cum)
        self.kind = np.where(known, 2, NEW).astype(np.uint8)
        self.start0, self.size0 = np.where(known, cum[:-1].astype(np.uint64), self.plain), np.where(known, size, 2).astype(np.uint64)
        self.place = np.repeat(np.arange(IDS, dtype=np.uint16), size)

    def look(self) -> None:
        self.h2 = (self.prev1 * 40503 + self.prev2 * 60493 >> 3) & ((1 << FAR_BITS) - 1)
        self.e1, self.e2 = self.near[self.prev1], self.far[self.h2]
        self.c1, self.c2 = self.e1 & ID_MASK, self.e2 & ID_MASK
        # how sure they are is below 4
        sure = (self.e2 >> 16).astype(np.uint8) << 5 | (self.e1 >> 16).astype(np.uint8) << 3
        self.context = (sure | (self.c1 == self.c2).view(np.uint8) << 2 | self.last).astype(np.int64)

    def symbol_of(self, ids: np.ndarray) -> np.ndarray:
        sym = self.kind[ids]
        np.copyto(sym, 1, where=self.c1 == ids)
        np.copyto(sym, 0, where=self.c2 == ids)
        return sym

    def rest(self, ids: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What follows the symbol: where in order 0 or in the plain bits the ids are, or all of it."""
        start, size, right = self.start0[ids], self.size0[ids], sym < 2
        np.copyto(start, np.uint64(0), where=right)
        np.copyto(size, np.uint64(1 << COUNT_BITS), where=right)
        return start, size

    def learn(self, ids: np.ndarray, sym: np.ndarray, row: np.ndarray) -> None:
        own = ids.astype(np.int32)
        for table, at, had, candidate in ((self.near, self.prev1, self.e1, self.c1), (self.far, self.h2, self.e2, self.c2)):
            surer = np.minimum(had + ONE_SURE, candidate + 3 * ONE_SURE)
            table[at] = np.where(candidate == own, surer, np.where(had >= 2 * ONE_SURE, had - ONE_SURE, own + ONE_SURE))
        self.fresh += np.bincount(row, minlength=len(self.fresh))
        self.missed.append(ids[sym >= 2])
        self.last, self.prev2, self.prev1 = sym, self.prev1, ids
        self.step += 1
        doubled = not self.step & (self.step - 1)
        if doubled or not self.step % MIX_EVERY:
            self._mix_again()
        if (doubled and self.step < COUNT_EVERY) or not self.step % COUNT_EVERY:
            self._count_again()


class _Writer:
    """The codes of n lanes. Whole words of 32 bits leave at the top; what overflows is carried into those that have left."""

    def __init__(self, n: int, length: int):
        self.low, self.width = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0))
        self.out, self.fill = np.zeros((n, length + 2), "<u4"), np.zeros(n, np.int64)

    def _carry(self, lanes: np.ndarray) -> None:
        at = self.fill[lanes] - 1
        while len(lanes):
            self.out[lanes, at] += np.uint32(1)
            on = self.out[lanes, at] == 0
            lanes, at = lanes[on], at[on] - 1

    def put(self, start: np.ndarray, size: np.ndarray, start2: np.ndarray, size2: np.ndarray) -> None:
        part = self.width >> BY_FLAG
        part2 = part * size >> BY_COUNT
        low, width = self.low + part * start + part2 * start2, part2 * size2
        self._carry(np.flatnonzero(low < self.low))
        short = np.flatnonzero(width < LEAST)
        x = low[short]
        self.out[short, self.fill[short]] = x >> U32
        self.fill[short] += 1
        low[short], width[short] = x << U32, width[short] << U32
        self.low, self.width = low, width

    def codes(self) -> list[bytes]:
        """The shortest end: a word that every value of the last range shares, zeros behind."""
        last = self.low + WORD
        self._carry(np.flatnonzero(last < self.low))
        self.out[np.arange(len(last)), self.fill] = last >> U32
        return [row[: f + 1].tobytes() for row, f in zip(self.out, self.fill.tolist(), strict=True)]


class _Reader:
    """The way back: how far each lane's code lies into its range."""

    def __init__(self, codes: list[bytes]):
        # a word of zeros stands behind each code; what is asked for beyond, as by a damaged code, is that one
        self.words = np.frombuffer(b"\0\0\0\0".join([*codes, b""]), "<u4").astype(np.uint64)
        sizes = np.array([len(c) // 4 for c in codes])
        self.end = np.cumsum(sizes + 1) - 1
        self.at = self.end - sizes
        self.width = np.full(len(codes), ~np.uint64(0))
        self.code = self._next(np.arange(len(codes))) << U32 | self._next(np.arange(len(codes)))

    def _next(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        self.at[lanes] = at + 1
        return self.words[np.minimum(at, self.end[lanes])]

    def flag(self) -> np.ndarray:
        self.part = self.width >> BY_FLAG
        return np.minimum(self.code // self.part, np.uint64((1 << FLAG_BITS) - 1))

    def count(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        self.code -= self.part * start
        self.part = self.part * size >> BY_COUNT
        return np.minimum(self.code // self.part, np.uint64((1 << COUNT_BITS) - 1))

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        self.code -= self.part * start
        width = self.part * size
        short = np.flatnonzero(width < LEAST)
        self.code[short] = self.code[short] << U32 | self._next(short)
        width[short] <<= U32
        self.width = width


def encode(ids: np.ndarray) -> list[bytes]:
    """ids: shape (blocks, length), below 65,536. The code of each block."""
    n, length = ids.shape
    if not n or not length:
        return [b""] * n
    m, out = _Model(n), _Writer(n, length)
    for now in np.ascontiguousarray(ids.astype(np.uint16).T):
        now = now.astype(np.int64)
        m.look()
        sym = m.symbol_of(now)
        row = m.context * SYMBOLS + sym
        out.put(m.start[row], m.size[row], *m.rest(now, sym))
        m.learn(now, sym, row)
    return out.codes()


def decode(codes: list[bytes], length: int) -> np.ndarray:
    """The ids of blocks that were coded together, all of one length, shape (blocks, length)."""
    n = len(codes)
    ids = np.zeros((length, n), np.uint16)
    if not n or not length:
        return ids.T
    m, code = _Model(n), _Reader(codes)
    for t in range(length):
        m.look()
        want = code.flag().astype(np.int16)
        sym = sum((want >= b[m.context]).view(np.uint8) for b in m.bounds)
        row = m.context * SYMBOLS + sym
        want = code.count(m.start[row], m.size[row]).astype(np.int64)
        now = m.place[want].astype(np.int64)
        for k, other in ((0, m.c2), (1, m.c1), (NEW, want >> 1)):
            np.copyto(now, other, where=sym == k)
        code.take(*m.rest(now, sym))
        m.learn(now, sym, row)
        ids[t] = now
    return ids.T
