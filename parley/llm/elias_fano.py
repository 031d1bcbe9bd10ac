"""Elias-Fano sequences over numpy buffers.

A non-decreasing sequence of n numbers below u keeps the low ``l`` bits of each
number side by side and the high parts as a bit vector with one 1 per number and
one 0 per step of the high part. Everything lies in one buffer that can be
memory-mapped; ``find`` reads the high part once into the first index of each
bucket, and then looks for successors bucket by bucket.
"""

from __future__ import annotations

import numpy as np


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, buckets: int):
        self.n, self.low_bits, self.low, self.high, self.buckets = n, low_bits, low, high, buckets
        self._first: np.ndarray | None = None

    @staticmethod
    def build(values: np.ndarray, universe: int) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        bits = min(57, max(0, (universe // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(bits)).astype(np.int64)
        buckets = (max(universe - 1, 0) >> bits) + 1
        marks = np.zeros(n + buckets, np.uint8)
        marks[high + np.arange(n)] = 1
        low = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
        if bits and n:
            part = (values & np.uint64((1 << bits) - 1)).astype("<u8")
            spread = np.unpackbits(part.view(np.uint8).reshape(n, 8), axis=1, count=bits, bitorder="little") if n * bits < 1 << 26 else None
            if spread is not None:
                packed = np.packbits(spread.reshape(-1), bitorder="little")
            else:
                step = 1 << 18                            # a multiple of 8 numbers ends on a byte
                packed = np.concatenate([np.packbits(np.unpackbits(part[k:k + step].view(np.uint8).reshape(-1, 8), axis=1, count=bits, bitorder="little").reshape(-1), bitorder="little") for k in range(0, n, step)])
            low[:len(packed)] = packed
        head = np.array([n, bits, buckets, len(low)], "<u8")
        return head.tobytes() + low.tobytes() + np.packbits(marks, bitorder="little").tobytes()

    @classmethod
    def open(cls, buf: np.ndarray) -> EliasFano:
        n, bits, buckets, size = np.frombuffer(buf[:32].tobytes(), "<u8").tolist()
        return cls(n, bits, buf[32:32 + size], buf[32 + size:], buckets)

    def first(self) -> np.ndarray:
        """Index of each bucket's first number; one more at the end."""
        if self._first is None:
            marks = np.unpackbits(self.high, count=self.n + self.buckets, bitorder="little")
            zeros = np.flatnonzero(marks == 0)
            self._first = np.concatenate([[0], zeros - np.arange(self.buckets)])
        return self._first

    def low_of(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.int64) * self.low_bits
        word = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))[bit >> 3]
        return (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.first(), at, "right") - 1
        return high.astype(np.uint64) << np.uint64(self.low_bits) | self.low_of(at)

    def find(self, values: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Index of each value, by its successor in its bucket, from ``start`` to before
        ``stop`` where these are given; -1 where it is not there."""
        values = values.astype(np.uint64)
        out = np.full(len(values), -1, np.int64)
        bucket = (values >> np.uint64(self.low_bits)).astype(np.int64)
        inside = bucket < self.buckets
        first = self.first()
        at = np.where(inside, first[np.minimum(bucket, self.buckets - 1)], 0)
        end = np.where(inside, first[np.minimum(bucket, self.buckets - 1) + 1], 0)
        if start is not None:
            at, end = np.maximum(at, start), np.minimum(end, stop)
        want = values & np.uint64((1 << self.low_bits) - 1)
        todo = np.flatnonzero(at < end)
        at, end, want = at[todo], end[todo], want[todo]
        while len(todo):
            got = self.low_of(at)
            hit = got == want
            out[todo[hit]] = at[hit]
            more = (got < want) & (at + 1 < end)
            todo, at, end, want = todo[more], at[more] + 1, end[more], want[more]
        return out
