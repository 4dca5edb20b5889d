"""Whole-batch text arithmetic in numpy: words, word hashes and shingle hashes without a Python loop per word.

All hashes are 64 bits wide. Words are hashed through prefix sums modulo 2**64: byte ``t`` at place
``i`` adds ``T[t] * B**-i``, so the sum over a word times ``B**start`` depends on its bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters and digits of ASCII, and every byte of a longer character.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; kept for the ordinary chunk size."""
    if "b" not in _powers or len(_powers["b"]) < n:
        with np.errstate(over="ignore"):
            made = {}
            for key, base in (("b", BASE), ("i", INVERSE)):
                a = np.full(max(n, 2 * CHUNK), base, np.uint64)
                a[0] = 1
                made[key] = np.cumprod(a, dtype=np.uint64)
        if n > 8 * CHUNK:
            return made["b"][:n], made["i"][:n]
        _powers.update(made)
    return _powers["b"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def chunks(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text is a range of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n + 1
    if start < len(sizes):
        yield start, len(sizes)


class Words:
    """The words of several texts: ``doc`` index, ``start``/``end`` byte places in ``buf``, ``hash``."""

    def __init__(self, texts: list[bytes], inside: np.ndarray = ~SPACE):
        self.n = len(texts)
        self.buf = buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.first = np.zeros(self.n + 1, np.int64)
        np.cumsum(lengths + 1, out=self.first[1:])
        word = np.zeros(len(buf) + 1, bool)
        word[1:] = inside[buf]
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):  # words in blocks of bytes, so that a very long text needs no more memory than an ordinary one
            lo = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, lo + 2 * CHUNK, "right")))
            hi = int(self.end[j - 1])
            bp, ip = powers(hi - lo + 1)
            with np.errstate(over="ignore"):
                s = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(BYTE[buf[lo:hi]] * ip[: hi - lo], out=s[1:])
                h = (s[self.end[i:j] - lo] - s[self.start[i:j] - lo]) * bp[self.start[i:j] - lo]
            self.hash[i:j] = mix(h)
            i = j
        at = np.searchsorted(self.start, self.first)
        self.at, self.count = at[:-1], np.diff(at)
        self.doc = np.repeat(np.arange(self.n), self.count)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every distinct k-word shingle, sorted; a shorter text is one shingle."""
    total = len(words.hash)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    padded = np.concatenate([words.hash, np.zeros(k, np.uint64)])
    left = words.at[words.doc] + words.count[words.doc] - np.arange(total)
    h = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * BASE + np.where(left > j, padded[j : j + total], np.uint64(0))
    keep = (left >= k) | ((words.count[words.doc] < k) & (left == words.count[words.doc]))
    doc, h = words.doc[keep], mix(h[keep])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]
