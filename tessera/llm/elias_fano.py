"""Ascending numbers in near-minimal space (Elias-Fano), with select structures that return one number at a time.

Of n numbers below u each keeps its low floor(log2(u / n)) bits as they are; the high parts stand in one bit vector of at most
3n bits, where the i-th set bit, at position p, says that the i-th number's high part is p - i. The positions of every 256th
set bit let select start close by. No number takes 64 bits.
"""

from __future__ import annotations

import struct

import numpy as np

#: Set bits between two positions that are kept.
STEP = 256
_HEAD = struct.Struct("<QQBI")  # numbers, the first one's distance from zero, low bits, bytes of high parts


class EliasFano:
    def __init__(self, n: int, base: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.width, self.low, self.high, self.samples = n, base, width, low, high, samples

    @classmethod
    def encode(cls, numbers: np.ndarray) -> EliasFano:
        """numbers: ascending uint64, repeats allowed."""
        n, base = len(numbers), int(numbers[0]) if len(numbers) else 0
        if n and (numbers[1:] < numbers[:-1]).any():
            raise ValueError("numbers are not in ascending order")
        rest = numbers.astype(np.uint64) - np.uint64(base)
        width = max(0, (int(rest[-1]) // n).bit_length() - 1) if n else 0
        at = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        low = (rest[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
        return cls(n, base, width, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), at[::STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.base, self.width, len(self.high)) + self.samples.astype("<u4").tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, base, width, n_high = _HEAD.unpack_from(raw)
        k, at = -(-n // STEP), _HEAD.size
        samples = np.frombuffer(raw, "<u4", k, at)
        high = np.frombuffer(raw, np.uint8, n_high, at + 4 * k)
        low = np.frombuffer(raw, np.uint8, -(-n * width // 8), at + 4 * k + n_high)
        return cls(n, base, width, low, high, samples)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The i-th number: select of the i-th set bit, and its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = i // STEP
        start = int(self.samples[k])
        stop = int(self.samples[k + 1]) + 1 if k + 1 < len(self.samples) else 8 * len(self.high)
        near = np.unpackbits(self.high[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :]
        high = start + int(np.flatnonzero(near)[i % STEP]) - i
        first = i * self.width
        bits = np.unpackbits(self.low[first // 8 : -(-(first + self.width) // 8)], bitorder="little")[first % 8 : first % 8 + self.width]
        return self.base + (high << self.width) + sum(1 << b for b in np.flatnonzero(bits).tolist())

    def all(self) -> np.ndarray:
        """All numbers, as uint64."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        out = (high.astype(np.uint64) << np.uint64(self.width)) + np.uint64(self.base)
        if self.width:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.width).reshape(self.n, self.width)
            for b in range(self.width):
                out += bits[:, b].astype(np.uint64) << np.uint64(b)
        return out
