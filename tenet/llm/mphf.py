"""A minimal perfect hash over distinct 64-bit keys, in levels of collision-free bit arrays, with stored fingerprints.

Each level hashes the keys that are left into twice as many bits; a key that has its bit alone ends there, and its slot is
the rank of that bit among all levels' bits. Lookup costs a constant number of reads, about 1.6 levels on average.
"""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS = 2, 48
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), salted."""
    x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """slots(keys): for the keys it was built on, 0 to n-1, each once; for others -1 or any slot (fingerprints tell)."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes.astype(np.int64), words.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, bits = keys.astype(np.uint64), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, -(-len(left) * GAMMA // 64) * 64)
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys of a perfect hash must be distinct")
        packed = np.packbits(np.concatenate(bits), bitorder="little").view("<u8") if bits else np.zeros(0, "<u8")
        return cls(np.array(sizes, dtype=np.int64), packed)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys, out = keys.astype(np.uint64), np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts[:-1], self.sizes, strict=True)):
            if not len(open_):
                break
            at = start + (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            w, b, k = word[hit], bit[hit], open_[hit]
            out[k] = self.ranks[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        """Numbers of levels and words, the levels' sizes, the words, and the rank of each word's first bit (8 bytes each)."""
        head = np.array([len(self.sizes), len(self.words)], "<i8").tobytes() + self.sizes.astype("<i8").tobytes()
        return head + self.words.astype("<u8").tobytes() + self.ranks[:-1].astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        n, m = np.frombuffer(raw, "<i8", 2)
        sizes = np.frombuffer(raw, "<i8", n, 16)
        return cls(sizes, np.frombuffer(raw, "<u8", m, 16 + 8 * n)), int(16 + 8 * (n + 2 * m))


def slot_by_reads(key: np.uint64, sizes: np.ndarray, read) -> int:
    """The slot of one key, -1 if it has none, by reads of 8 bytes: read(i, unsigned) is the i-th word, or rank, of the index.

    Each level costs one read, and keys end on about 1.6 levels, so the number of reads does not grow with the index."""
    start = 0
    for level, size in enumerate(sizes.tolist()):
        at = start + int(mix(np.array([key], np.uint64), level)[0] % np.uint64(size))
        word, bit = read(at >> 6, True), at & 63
        if word >> bit & 1:
            return read(at >> 6, False) + (word & (1 << bit) - 1).bit_count()
        start += size
    return -1


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits a key, independent of the hash's levels."""
    return (mix(keys, 0x5EED) >> np.uint64(32)).astype(np.uint32)
