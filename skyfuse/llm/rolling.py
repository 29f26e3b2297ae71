"""Rabin-Karp hashing of word ranges, vectorised.

Texts are joined into one byte buffer, words parted by one space and texts by a
newline. With H the running sum of value[byte] * B**position modulo 2**64, the
range s:e has the hash (H[e] - H[s]) / B**s, whatever its place: B is odd and
so has an inverse. A last mixing step spreads the low bits."""

from __future__ import annotations

import hashlib

import numpy as np

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LONG_WORD = 32  # bytes
HELD = 3 << 20  # powers that a process holds at most
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order, not linear in either."""
    x = a * np.uint64(0xA24BAED4963EE407) + (b << np.uint64(23) | b >> np.uint64(41)) * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD1342543DE82EF95)
    x ^= x >> np.uint64(32)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_B))


def _grown(n: int) -> list[np.ndarray]:
    """Powers of B and of its inverse, n at least; those of very long texts are not held on to."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    size = max(n, 1 << 16)
    found = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_B, _B_INV)]
    if size <= HELD:
        _powers[:] = found
    return found


def normal(text: bytes, lower: bool = False) -> bytes:
    """Words (runs without ASCII white space) parted by one space."""
    return b" ".join((text.translate(LOWER) if lower else text).split())


class Words:
    """Words of several normal texts: byte offsets start, end; doc: the text each is from."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        newline = self.buf == 10
        ends = np.flatnonzero(newline | (self.buf == 32))
        starts = np.empty_like(ends)
        starts[:1], starts[1:] = 0, ends[:-1] + 1
        line = np.cumsum(newline[ends])
        line -= newline[ends]
        full = ends > starts
        self.start, self.end, self.doc = starts[full], ends[full], line[full]
        self.n_docs = len(texts)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def prefix(self, power: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_VALUE[self.buf] * power[: len(self.buf)], out=sums[1:])
        return sums

    def hashes(self, window: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The first word's index and the hash of each run of `window` words in one text."""
        first = np.arange(max(0, len(self.doc) - window + 1))
        first = first[self.doc[first] == self.doc[first + window - 1]]
        power, back = _grown(len(self.buf) + 1)
        s, e, sums = self.start[first], self.end[first + window - 1], self.prefix(power)
        h = (sums[e] - sums[s]) * back[s]
        return first, mix(h ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def apart(self) -> np.ndarray:
        """A hash of each word. Those modulo 2**64 are alike for some long words that are not: these have a digest."""
        h = self.hashes()[1]
        buf = None
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            buf = buf or self.buf.tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(buf[self.start[i] : self.end[i]], digest_size=8).digest(), "little")
        return h

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes, 128 bits together, of each run of `window` words in one text: the
        rolling one, mixed with one that joins the words' own hashes pair by pair."""
        first, rolled = self.hashes(window)
        level, held, size = self.apart(), None, 1
        while size <= window:  # level: of runs of `size` words, from each word on
            if window & size:  # runs of the smaller sizes come after those of the larger
                held = level if held is None else _joined(level[: len(held[size:])], held[size:]) if len(held) > size else level[:0]
            level = _joined(level[:-size], level[size:]) if len(level) > size else level[:0]
            size *= 2
        own = held[first] if len(first) else np.zeros(0, np.uint64)
        return mix(rolled ^ mix(own)), mix(rolled * np.uint64(0x9FB21C651E98DF25) + own)
