"""Elias-Fano coding of sorted integers, with select."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IQB")
# Ones between two sampled positions of the upper bits.
SAMPLE = 256


class EliasFano:
    """``n`` sorted integers below ``universe`` in about ``2 + log2(universe / n)`` bits each.

    The low bits of each value are stored as they are; the rest is a bit per value and a
    bit per step of the high part. Every ``SAMPLE``-th one of those bits has its position
    sampled in 32 bits, so ``select`` reads a few hundred bits, whatever ``n``.
    """

    def __init__(self, count: int, universe: int, width: int, upper: bytes, lower: bytes, samples: bytes):
        self.count, self.universe, self.width = count, universe, width
        self.upper = np.frombuffer(upper, np.uint8)
        self.lower = np.frombuffer(lower, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        count = len(values)
        universe = int(values[-1]) + 1 if count else 0
        width = max(0, (universe // count).bit_length() - 1) if count else 0
        places = (values >> width) + np.arange(count)
        bits = np.zeros(int(places[-1]) + 1 if count else 0, np.uint8)
        bits[places] = 1
        low = (values[:, None] >> np.arange(width)) & 1
        upper = np.packbits(bits, bitorder="little").tobytes()
        lower = np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(count, universe, width, upper, lower, places[::SAMPLE].astype("<u4").tobytes())

    def _low(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), np.int64)
        for bit in range(self.width):
            place = index * self.width + bit
            out |= ((self.lower[place >> 3] >> (place & 7)) & 1).astype(np.int64) << bit
        return out

    def select(self, i: int) -> int:
        """The ``i``-th value, found from the nearest sample on."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        ones = np.unpackbits(self.upper[byte : byte + 1], bitorder="little")[place & 7 :]
        while left >= (found := int(ones.sum())):
            left -= found
            byte += 1
            place = byte << 3
            ones = np.unpackbits(self.upper[byte : byte + 1], bitorder="little")
        place += int(np.flatnonzero(ones)[left])
        return ((place - i) << self.width) | int(self._low(np.array([i]))[0])

    def values(self) -> np.ndarray:
        """All values, in order."""
        index = np.arange(self.count)
        places = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.count]
        return ((places - index) << self.width) | self._low(index)

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.count, self.universe, self.width)
        sizes = struct.pack("<II", len(self.upper), len(self.lower))
        return head + sizes + self.upper.tobytes() + self.lower.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        count, universe, width = _HEAD.unpack_from(data)
        upper, lower = struct.unpack_from("<II", data, _HEAD.size)
        at = _HEAD.size + 8
        parts = data[at : at + upper], data[at + upper : at + upper + lower], data[at + upper + lower :]
        return cls(count, universe, width, *parts)
