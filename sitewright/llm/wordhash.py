"""Words of whole texts as 64-bit hashes, and hashes of runs of words, by array operations.

Words are runs of characters other than U+0020 and U+0009 to U+000D. A word's hash is a polynomial over its UTF-8
bytes, a run's hash a polynomial over its words' hashes; both come from running sums, so each costs the same whatever
its length. Multiplication is modulo 2 ** 64 with odd bases, which have inverses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CHUNK = 512 << 10  # bytes of text at once; arrays over them take some fifty times as much


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Powers:
    """Powers of a base and of its inverse, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size)
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.size - 1, b, np.uint64))]).astype(np.uint64) for b in (self.base, self.inverse))
        return self.up, self.down


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts in UTF-8, about `most` bytes together, with the number of the first."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        run.append(data)
        size += len(data)
        if size >= most:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run


class Words:
    """The words of some texts: `hash`, `doc` (number of the text), byte bounds `start` and `end` in `data`."""

    def __init__(self, texts: list[bytes], byte_powers: Powers) -> None:
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        blank = IS_BLANK[raw]
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        up, down = byte_powers.upto(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(texts) else sizes
        self.doc = np.searchsorted(self.text_start, self.start, "right") - 1
        self.first_word = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def sums(self, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        up, down = powers.upto(len(self.hash) + 1)
        total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[: len(self.hash)], out=total[1:])
        return total, down

    def runs(self, n: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of n words of one text start, and the hash of each."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total, down = self.sums(powers)
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1])
        return at, mix((total[at + n] - total[at]) * down[at])
