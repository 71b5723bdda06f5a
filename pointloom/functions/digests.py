"""``uniform`` of many pairs at once: the first word of the MD5 of a hand's text and a point's, in numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Pairs that are digested at once: many for each call of numpy, few enough for their words to stay in the cache.
AT_ONCE = 1 << 15
_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURN = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in row]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first(words: list, n: int) -> np.ndarray:
    """First word of the MD5 of n blocks; words: 16 of them, None for those that are 0. The last three steps don't change it."""
    a, b, c, d = (np.full(n, s, np.uint32) for s in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for t in range(61):
        if t < 16:
            at = t
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f), d, out=f)
        elif t < 32:
            at = (5 * t + 1) % 16
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f), c, out=f)
        elif t < 48:
            at = (3 * t + 5) % 16
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            at = 7 * t % 16
            np.bitwise_xor(np.bitwise_or(np.invert(d, out=f), b, out=f), c, out=f)
        np.add(np.add(f, a, out=f), _K[t], out=f)
        if words[at] is not None:
            np.add(f, words[at], out=f)
        np.left_shift(f, _TURN[t], out=g)
        np.right_shift(f, 32 - _TURN[t], out=f)
        np.add(np.bitwise_or(f, g, out=f), b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(_START[0])).byteswap()


class Draws:
    """Draws of pairs of a prefix and an ending (both bytes): the first eight hexadecimal digits of the MD5 of both, as a number."""

    def __init__(self, prefixes: list[bytes], endings: list[bytes]):
        self.prefixes, self.endings = prefixes, endings
        self.long = np.array([len(p) for p in prefixes], np.int64)
        self.size = np.array([len(e) for e in endings], np.int64)
        self.width = int(self.size.max(initial=0))
        self.bytes = np.frombuffer(b"".join(e.ljust(self.width, b"\0") for e in endings), np.uint8).reshape(len(endings), self.width)
        self.shifted: dict[int, np.ndarray] = {}
        self.heads: dict[int, tuple] = {}

    def _words(self, r: int) -> np.ndarray:
        """Words of the endings, with the bit that ends a text, after r bytes."""
        if r not in self.shifted:
            out = np.zeros((len(self.endings), -(-(r + self.width + 1) // 4) * 4), np.uint8)
            out[:, r : r + self.width] = self.bytes
            out[np.arange(len(out)), r + self.size] = 0x80
            self.shifted[r] = np.ascontiguousarray(out.view("<u4").T)
        return self.shifted[r]

    def _head(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of the prefixes of one length, and each prefix's place among them."""
        if size not in self.heads:
            some = np.flatnonzero(self.long == size)
            wide = (size // 4 + 1) * 4
            words = np.frombuffer(b"".join(self.prefixes[i].ljust(wide, b"\0") for i in some), "<u4").reshape(len(some), -1)
            place = np.zeros(len(self.long), np.int64)
            place[some] = np.arange(len(some))
            self.heads[size] = np.ascontiguousarray(words.T), place
        return self.heads[size]

    def __call__(self, prefix: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = np.empty(len(prefix), np.uint32)
        long = self.long[prefix]
        for size in np.unique(long):
            mine = np.flatnonzero(long == size)
            if size + self.width > 55:  # more than one block
                out[mine] = [int.from_bytes(hashlib.md5(self.prefixes[p] + self.endings[e]).digest()[:4], "big") for p, e in zip(prefix[mine], ending[mine], strict=True)]
                continue
            (head, place), tail, at = self._head(int(size)), self._words(int(size) % 4), int(size) // 4
            for k in range(0, len(mine), AT_ONCE):
                some = mine[k : k + AT_ONCE]
                p, e = place[prefix[some]], ending[some]
                words: list = [None] * 16
                for i in range(len(tail)):
                    words[at + i] = tail[i][e]
                for i in range(at):
                    words[i] = head[i][p]
                words[at] = words[at] | head[at][p]
                words[14] = ((size + self.size[e]) * 8).astype(np.uint32)
                out[some] = _first(words, len(some))
        return out
