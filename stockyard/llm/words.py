"""Words, shingles and their hashes, computed over whole Arrow batches at once.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Texts of a batch lie in one byte
buffer, so finding and hashing words is array arithmetic on that buffer: the hash of
any byte range is a difference of prefix sums modulo 2**64, and the hash of any run
of words is a difference of prefix sums over word hashes. All constants come from fixed
seeds, so every executor gets the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once: arrays of eight bytes per byte of text stay small.
SLICE_BYTES = 1 << 21

_U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one, so that each output bit hangs on all input bits."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    first = (seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64)
    return mix(np.arange(1, n + 1, dtype=_U64) * _U64(0xD1342543DE82EF95) + _U64(first))


@lru_cache(maxsize=4)
def _base(seed: int) -> tuple[int, int]:
    odd = int(seeded(seed + 77, 1)[0]) | 1
    return odd, pow(odd, -1, 1 << 64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of ``seed`` and of its inverse, from exponent 0 on."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        have = []
        for base in _base(seed):
            column = np.full(size, base, _U64)
            column[0] = 1
            have.append(np.multiply.accumulate(column))
        _POWERS[seed] = have = (have[0], have[1])
    return have


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of ``values[start:end]`` for each pair of bounds; equal ranges hash alike."""
    up, down = _powers(seed, len(values) + 1)
    sums = np.zeros(len(values) + 1, _U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Words:
    """The words of some texts: byte bounds, and the first word of each text."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # words of text i are first[i]:first[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word."""
        return range_hashes(seeded(seed + 1000, 256)[self.data], self.starts, self.ends, seed)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def find_words(texts: pa.Array) -> Words:
    """The words of each text; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, bounds, buffer = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64, len(texts) + 1, texts.offset * 8)
    whole = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    data = whole[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = ~_SPACE[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begin)
    return Words(data, offsets, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


@dataclass
class Shingles:
    """Windows of ``size`` words that lie within one text."""

    hashes: np.ndarray
    at: np.ndarray  # index of the first word
    first: np.ndarray  # windows of text i are first[i]:first[i + 1]


def shingles(words: Words, hashes: np.ndarray, size: int, seed: int = 1, whole: bool = False) -> Shingles:
    """All windows of ``size`` consecutive words of each text.

    With ``whole`` a text of fewer words, but at least one, gives one window: all of it.
    """
    counts = words.counts()
    many = np.maximum(counts - size + 1, ((counts > 0) & whole).astype(np.int64))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(many, out=first[1:])
    text = np.repeat(np.arange(len(counts)), many)
    at = words.first[text] + (np.arange(first[-1]) - first[text])
    ends = np.minimum(at + size, words.first[text + 1])
    return Shingles(range_hashes(hashes, at, ends, seed), at, first)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``most`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    row = 0
    while row < batch.num_rows:
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(row, stop - row)
        row = stop
