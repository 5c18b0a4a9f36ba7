"""Numpy helpers shared by the operators: whole texts as code arrays, hashes of any slice."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are worked on together up to so many characters; a longer text is worked on alone.
CHUNK_CHARS = 1 << 20

_powers: dict[int, np.ndarray] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of splitmix64)."""
    x = values.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_table(base: int, size: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; the table of a worker grows to its longest text."""
    known = _powers.get(base)
    if known is None or len(known) < size:
        steps = np.full(max(size, 2 * CHUNK_CHARS), base, U64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:size]


class SliceHasher:
    """Content hashes of arbitrary slices of one sequence of 64-bit values.

    Prefix sums of ``value * base^i`` modulo 2^64: the hash of a slice is the difference of two
    sums, moved to position 0 by the inverse power.
    """

    def __init__(self, values: np.ndarray) -> None:
        terms = values * _power_table(_BASE, len(values))
        self.sums = np.concatenate((np.zeros(1, U64), np.cumsum(terms, dtype=U64)))
        self.back = _power_table(_INVERSE, len(values) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(texts: Sequence[str | None], limit: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of consecutive texts that hold at most ``limit`` characters or one text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        length = len(text or "")
        if i > start and size + length > limit:
            yield slice(start, i)
            start, size = i, 0
        size += length
    if len(texts) > start:
        yield slice(start, len(texts))


def unused(name: str, columns: Sequence[str]) -> str:
    """A column name that is not taken."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of several texts, as slices of their joined UTF-8 bytes.

    ``starts`` and ``ends`` are byte positions, ``counts`` the number of words of each text.
    """

    def __init__(self, texts: Sequence[str | None], lower: bool = False) -> None:
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b" ".join(encoded) + b" "
        # bytes.lower() changes A-Z only.
        self.data = joined.lower() if lower else joined
        self.bytes = np.frombuffer(self.data, np.uint8)
        inside = ~_SPACES[self.bytes]
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        self.starts, self.ends = edges[0::2], edges[1::2]
        limits = np.cumsum([len(e) + 1 for e in encoded])
        self.counts = np.diff(np.searchsorted(self.starts, limits), prepend=0)
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each word."""
        lengths = (self.ends - self.starts).astype(U64)
        return mix(SliceHasher(mix(self.bytes.astype(U64) + U64(1)))(self.starts, self.ends) ^ lengths)
