"""Words by byte classes: splitting on bytes agrees with splitting on code points, as every byte of a non-ASCII letter is above 0x7F."""

from __future__ import annotations

import numpy as np


def folded(separators: bytes) -> bytes:
    """A translation table: A-Z to lower case, `separators` to a space."""
    table = bytearray(range(256))
    for i in range(0x41, 0x5B):
        table[i] = i + 32
    for i in separators:
        table[i] = 0x20
    return bytes(table)


# Everything in ASCII but 0-9, A-Z and a-z separates.
ALPHANUMERIC = folded(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
# White space 0x20 and 0x09-0x0D separates; that is what bytes.split() does by itself.
SPACED = folded(b"")


class Hashes(dict):
    """word -> 64-bit hash; emptied when it holds `limit` words, as hashes can be made again."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit
        from xxhash import xxh3_64_intdigest

        self.digest = xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.digest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: every input bit reaches every output bit."""
    x = (x ^ (x >> S33)) * M1
    x = (x ^ (x >> S33)) * M2
    return x ^ (x >> S33)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of the whole sequence where there are fewer words; none without words."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    run = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        run = mixed(run * M2 + hashes[i : n - size + 1 + i])
    return np.unique(run)
