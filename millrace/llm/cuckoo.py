"""A cuckoo filter in numpy: insertions, deletions and vectorised look-ups of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import mix64

_SLOTS = 4
_KICKS = 500
_HEAD = 2


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; no false negatives.

    A hash that finds no place after 500 kicks goes to an exact stash, so an insertion
    never fails and never loses another's entry. One entry is kept for each insertion;
    delete() takes one away, and must only be called for hashes that were inserted.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None, stash: list[int] | None = None):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.buckets = buckets
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if table is None else table
        self.stash = list(stash or [])

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        """Room for n hashes at a load of at most 80 %."""
        need = max(1, -(-n * 5 // (4 * _SLOTS)))
        return cls(1 << (need - 1).bit_length())

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        made = cls.sized(len(hashes))
        made.insert(hashes)
        return made

    def room(self) -> int:
        """How many hashes it takes at a load of 80 %."""
        return self.buckets * _SLOTS * 4 // 5

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = mix64(np.asarray(hashes).astype(np.uint64))
        prints = (m >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (m & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, one, one ^ self._step(prints)

    def _step(self, prints: np.ndarray) -> np.ndarray:
        return (mix64(np.asarray(prints).astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, hashes: np.ndarray) -> None:
        prints, one, two = self._places(hashes)
        table, rng = self.table, np.random.default_rng(7)
        for h, p, i, j in zip(np.asarray(hashes).tolist(), prints.tolist(), one.tolist(), two.tolist(), strict=True):
            for at in (i, j):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = p
                    break
            else:
                self._kick(h, p, j, rng)

    def _kick(self, h: int, p: int, at: int, rng) -> None:
        undo = []
        for _ in range(_KICKS):
            slot = int(rng.integers(_SLOTS))
            undo.append((at, slot, int(self.table[at, slot])))
            p, self.table[at, slot] = int(self.table[at, slot]), p
            at ^= int(self._step(np.array([p], np.uint16))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return
        for at, slot, p in reversed(undo):
            self.table[at, slot] = p
        self.stash.append(h)

    def delete(self, hashes: np.ndarray) -> None:
        prints, one, two = self._places(hashes)
        for h, p, i, j in zip(np.asarray(hashes).tolist(), prints.tolist(), one.tolist(), two.tolist(), strict=True):
            if h in self.stash:
                self.stash.remove(h)
                continue
            for at in (i, j):
                found = np.flatnonzero(self.table[at] == p)
                if len(found):
                    self.table[at, found[0]] = 0
                    break

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(hashes)
        want = prints[:, None]
        found = (self.table[one] == want).any(axis=1) | (self.table[two] == want).any(axis=1)
        if self.stash:
            found |= np.isin(np.asarray(hashes).astype(np.int64), np.array(self.stash, np.int64))
        return found

    def to_bytes(self) -> bytes:
        head = np.array([self.buckets, len(self.stash)], np.int64)
        return head.tobytes() + np.array(self.stash, np.int64).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, n = (int(x) for x in np.frombuffer(data, np.int64, _HEAD))
        stash = np.frombuffer(data, np.int64, n, offset=8 * _HEAD).tolist()
        table = np.frombuffer(data, np.uint16, offset=8 * (_HEAD + n)).reshape(buckets, _SLOTS).copy()
        return cls(buckets, table, stash)
