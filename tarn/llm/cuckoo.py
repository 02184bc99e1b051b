"""A cuckoo filter over 16-byte digests: membership with insertion and deletion, probed in numpy arrays."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
FILL = 0.85


class CuckooFilter:
    """Buckets of four 16-bit fingerprints. No false negatives; about 8 / 65,536 false positives.

    The digest's first eight bytes choose the bucket, the next two the fingerprint; the other bucket
    is the first one xor a hash of the fingerprint, so entries can move and be deleted without their key.
    """

    def __init__(self, buckets: int):
        self.table = np.zeros((1 << max(0, (buckets - 1).bit_length()), SLOTS), np.uint16)

    @classmethod
    def of(cls, digests: list[bytes]) -> CuckooFilter:
        size = max(1, int(len(digests) / (SLOTS * FILL)) + 1)
        while True:
            out = cls(size)
            if all(out.insert(d) for d in digests):
                return out
            size = 2 * len(out.table)

    @staticmethod
    def _parts(digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:8], "little"), (int.from_bytes(digest[8:10], "little") % 65535) + 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (len(self.table) - 1)

    def insert(self, digest: bytes) -> bool:
        """False if no room was found; the filter must then be built larger."""
        h, mark = self._parts(digest)
        at = h & (len(self.table) - 1)
        for b in (at, self._other(at, mark)):
            if len(free := np.flatnonzero(self.table[b] == 0)):
                self.table[b, free[0]] = mark
                return True
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = self._other(at, mark)
            if len(free := np.flatnonzero(self.table[at] == 0)):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Removes one entry of a digest that was inserted before."""
        h, mark = self._parts(digest)
        at = h & (len(self.table) - 1)
        for b in (at, self._other(at, mark)):
            if len(found := np.flatnonzero(self.table[b] == mark)):
                self.table[b, found[0]] = 0
                return True
        return False

    def contains(self, digests: np.ndarray) -> np.ndarray:
        """digests: shape (n, 16), uint8."""
        if not len(digests):
            return np.zeros(0, bool)
        low = np.uint64(len(self.table) - 1)
        at = np.ascontiguousarray(digests[:, :8]).view("<u8").ravel() & low
        mark = (np.ascontiguousarray(digests[:, 8:10]).view("<u2").ravel().astype(np.uint64) % np.uint64(65535)) + np.uint64(1)
        other = (at ^ (mark * np.uint64(0x5BD1E995))) & low
        m = mark.astype(np.uint16)[:, None]
        return (self.table[at] == m).any(1) | (self.table[other] == m).any(1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return out
