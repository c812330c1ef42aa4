"""Words and word shingles of a batch of texts, found with numpy on the UTF-8 buffer.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the
lower-cased text.  A shingle is ``width`` consecutive words; a text with fewer words, but at
least one, is a single shingle of all its words; a null or empty text has none.

Words hash to 64 bits by a polynomial over their bytes, shingles by a polynomial over the word
hashes; both are mixed by a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
# Bytes of text that are worked on at once; numpy needs about 40 bytes for each.
SLICE_BYTES = 512 << 10

_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _span in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz"):
    _WORD[list(_span)] = True

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n; the largest table so far is kept."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        factors = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        factors[0] = 1
        table = np.cumprod(factors, dtype=np.uint64)
        if n <= 2 * SLICE_BYTES:
            _powers[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    start = 0
    while start < len(text):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
        yield start, stop
        start = stop


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; nulls are empty."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_hash(data: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` takes differences of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(base, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of the bytes from each start to its end, whatever their place in the buffer."""
    back = _power_table(pow(base, -1, 1 << 64), len(prefix))
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of several texts: byte spans, hashes, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def words(text: pa.Array) -> Words:
    data, offsets = utf8(pc.utf8_lower(text))
    inside = _WORD[data]
    full = offsets[:-1] < offsets[1:]
    before = np.concatenate([[False], inside[:-1]])[: len(data)]
    before[offsets[:-1][full]] = False
    after = np.concatenate([inside[1:], [False]])[: len(data)]
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = span_hash(prefix_hash(data), starts, ends)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


@dataclass
class Shingles:
    """Shingle hashes of several texts, the first shingle of each text, and each one's first word."""

    hashes: np.ndarray
    first: np.ndarray
    word: np.ndarray


def shingles(found: Words, width: int = WIDTH) -> Shingles:
    counts = np.diff(found.first)
    h = found.hashes
    n = max(0, len(h) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(width):
        rolled = rolled * _STEP + h[i : i + n]
    long = counts >= width
    # A position counts if the text that holds its first word holds the last one, too.
    ok = np.zeros(n, bool)
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, found.first[:-1][long], 1)
    np.add.at(edge, found.first[1:][long] - width + 1, -1)
    ok[:] = np.cumsum(edge)[:n] > 0
    at, values = np.flatnonzero(ok), rolled[ok]
    short = np.flatnonzero((counts > 0) & ~long)
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k, i in enumerate(short):
            for j in range(found.first[i], found.first[i + 1]):
                extra[k : k + 1] = extra[k : k + 1] * _STEP + h[j : j + 1]
        extra ^= counts[short].astype(np.uint64)
        at = np.concatenate([at, found.first[short]])
        order = np.argsort(at, kind="stable")
        at, values = at[order], np.concatenate([values, extra])[order]
    return Shingles(mix(values), np.searchsorted(at, found.first), at)


def distinct_sets(found: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every text, one after the other, and where each text begins."""
    owner = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    order = np.lexsort((found.hashes, owner))
    h, owner = found.hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(found.first)))
