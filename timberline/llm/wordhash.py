"""Words and window hashes of whole Arrow batches, computed with numpy on the UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D; no byte of a multi-byte code point is one of those. A word's
hash is the sum of its 8-byte parts, each mixed with a seed of its place: no two places add up alike, as they do in
polynomials modulo 2**64 for some pairs of long strings. A window's hash is a polynomial over the hashes of its few
words, so that it comes from two prefix sums. Constants come from a fixed SplitMix64 stream: every worker computes the
same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64


def _splitmix(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(U(seed) + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64; a bijection."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of an odd base and of its inverse, extended as longer texts come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, b in (("up", self.base), ("down", self.inverse)):
                out = np.full(size, b, U)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
        return self.up[:n], self.down[:n]


_WORDS = (_Powers(0x9FB21C651E98DF25), _Powers(0xA0761D6478BD642F))


class Words:
    """Words of some texts. starts, ends: byte positions in data; first[d]: number of the first word of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; those of another `which` are independent."""
        n = len(self)
        if not n:
            return np.zeros(0, U)
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eights = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        sizes = self.ends - self.starts
        parts = (sizes + 7) >> 3
        if parts.max() == 1:
            begin, left, seed, first = self.starts, sizes, self._seeds(which, 1), None
        else:
            first = np.cumsum(parts) - parts
            place = np.arange(first[-1] + parts[-1]) - np.repeat(first, parts)
            begin = np.repeat(self.starts, parts) + 8 * place
            left = np.repeat(sizes, parts) - 8 * place
            seed = self._seeds(which, int(parts.max()))[place]
        value = eights[begin] & (~U(0) >> (U(8) * (U(8) - np.minimum(left, 8).astype(U))))
        with np.errstate(over="ignore"):
            mixed = mix(value ^ seed)
            total = mixed if first is None else np.add.reduceat(mixed, first)
            return mix(total + sizes.astype(U))

    @staticmethod
    def _seeds(which: int, n: int) -> np.ndarray:
        return _splitmix(11 + 89 * which, n)

    def keys(self) -> list[np.ndarray]:
        """Two hashes of each text's whole word sequence, of any length: each word is mixed with its place."""
        out, place = [], np.arange(len(self)) - np.repeat(self.first[:-1], self.counts)
        for which in (0, 1):
            with np.errstate(over="ignore"):
                mixed = mix(self.hashes(which) ^ mix(place.astype(U) * U(0x9E3779B97F4A7C15) + U(which + 1)))
                sums = np.zeros(len(self) + 1, U)
                np.cumsum(mixed, out=sums[1:])
                out.append(mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.counts.astype(U)).view(np.int64))
        return out

    def room(self) -> np.ndarray:
        """For each word, how many words of its text begin there or later."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))


def windows(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 are of no use."""
    n = len(hashes)
    up, down = _WORDS[which].get(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    out = np.zeros(n, U)
    if n >= k:
        out[: n - k + 1] = mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts (null: empty) and len + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(first row, end row) of slices of about most bytes; a longer text is a slice of its own."""
    offsets = text_bytes(texts)[1]
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def pieces(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, their words) of slices()."""
    data, offsets = text_bytes(texts)
    for a, b in slices(texts, most):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def planes(x: np.ndarray) -> bytes:
    """The bytes of x, those of equal weight together, so that compression of shuffled blocks finds the zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)
