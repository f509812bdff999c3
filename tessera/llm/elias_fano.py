"""Elias-Fano sequences and n-gram tries over them, in memory-mapped files, searched many keys at a time."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

import numpy as np

U = np.uint64


class MappedFile:
    """Arrays of one trie, appended to a file in the task's temporary folder and read through a memory map."""

    def __init__(self):
        self._folder = tempfile.TemporaryDirectory()
        self._path = os.path.join(self._folder.name, "levels")
        self._size = 0

    def __enter__(self) -> MappedFile:
        return self

    def __exit__(self, *_) -> None:
        self._folder.cleanup()

    def keep(self, array: np.ndarray) -> np.ndarray:
        if not array.nbytes:
            return array
        with open(self._path, "ab") as file:
            file.write(bytes(-self._size % 8))
            at = self._size + -self._size % 8
            file.write(np.ascontiguousarray(array).data)
        self._size = at + array.nbytes
        return np.memmap(self._path, array.dtype, "r", offset=at, shape=array.shape)


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the one of a given rank in each 64-bit word."""
    word, rank, at = word.copy(), rank.astype(np.int64), np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = word & U((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        above = rank >= ones
        rank -= np.where(above, ones, 0)
        word = np.where(above, word >> U(width), low)
        at += np.where(above, width, 0)
    return at


class EliasFano:
    """A non-decreasing sequence of integers under ``universe``: low bits verbatim, high bits in unary."""

    def __init__(self, values: np.ndarray, universe: int, file: MappedFile):
        values = values.astype(np.uint64)
        self.size = len(values)
        self.low_bits = max(0, (universe // max(1, self.size)).bit_length() - 1)
        high = (values >> U(self.low_bits)).astype(np.int64) if self.low_bits < 64 else np.zeros(self.size, np.int64)
        buckets = (universe - 1 >> self.low_bits) + 1 if universe else 1
        bits = np.zeros(self.size + buckets, np.uint8)
        bits[high + np.arange(self.size)] = 1
        self.high = file.keep(_words(bits))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])
        self.ones = file.keep(ones)
        self.zeros = file.keep(np.arange(len(ones), dtype=np.int64) * 64 - ones)
        low = np.empty(0, np.uint8)
        if self.low_bits:
            low = (values[:, None] >> np.arange(self.low_bits, dtype=np.uint64) & U(1)).astype(np.uint8).ravel()
        self.low = file.keep(_words(low))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * U(self.low_bits)
        word, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
        value = self.low[word] >> shift
        spilled = self.low[word + 1] << (U(63) - shift) << U(1)
        return (value | spilled) & U((1 << self.low_bits) - 1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at given positions."""
        word = np.searchsorted(self.ones, at, "right") - 1
        position = word * 64 + _select_in_word(self.high[word], at - self.ones[word])
        return (position - at).astype(np.uint64) << U(self.low_bits) | self._low(at)

    def _before_bucket(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have high bits under ``bucket``."""
        zero = np.maximum(bucket - 1, 0)
        word = np.searchsorted(self.zeros, zero, "right") - 1
        position = word * 64 + _select_in_word(~self.high[word], zero - self.zeros[word])
        return np.where(bucket > 0, position - zero, 0)

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key under the universe, the position of the first value not under it among those of its bucket, and whether it is the key."""
        bucket = (keys >> U(self.low_bits)).astype(np.int64)
        begin, end = self._before_bucket(bucket), self._before_bucket(bucket + 1)
        low, stop = keys & U((1 << self.low_bits) - 1), end.copy()
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            middle = begin[open_] + end[open_] >> 1
            under = self._low(middle) < low[open_]
            begin[open_[under]] = middle[under] + 1
            end[open_[~under]] = middle[~under]
            open_ = open_[begin[open_] < end[open_]]
        inside = begin < stop
        found = np.zeros(len(keys), bool)
        found[inside] = self._low(begin[inside]) == low[inside]
        return begin, found


@dataclass
class Quantised:
    """Values as 16-bit codes between their least and greatest."""

    codes: np.ndarray
    least: float
    step: float

    @classmethod
    def of(cls, values: np.ndarray, file: MappedFile) -> Quantised:
        least, most = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        step = (most - least) / 65535 or 1.0
        return cls(file.keep(np.rint((values - least) / step).astype(np.uint16)), least, step)

    def at(self, where: np.ndarray) -> np.ndarray:
        return self.codes[where] * self.step + self.least


class TrieLevel:
    """Nodes of one level: children of a node stand together, in the order of their labels.

    A label is made relative to its context by adding the context's index in the level above, shifted by the label's bits, which makes the
    level one monotone sequence; monotone pointers give where each context's children begin.
    """

    def __init__(self, parents: np.ndarray, labels: np.ndarray, contexts: int, label_bits: int, file: MappedFile):
        self.label_bits = label_bits
        keys = parents.astype(np.uint64) << U(label_bits) | labels.astype(np.uint64) if label_bits < 64 else labels.astype(np.uint64)
        self.keys = EliasFano(keys, max(1, contexts) << label_bits, file)
        starts = np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=contexts))])
        self.pointers = EliasFano(starts, len(keys) + 1, file)

    def find(self, parents: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Index of each (context, label), -1 where it is not in the trie."""
        out = np.full(len(labels), -1, np.int64)
        known = np.flatnonzero(parents >= 0)
        if not len(known) or not self.keys.size:
            return out
        context = parents[known]
        keys = labels[known].astype(np.uint64)
        if self.label_bits < 64:
            keys |= context.astype(np.uint64) << U(self.label_bits)
        at, found = self.keys.successor(keys)
        found &= at < self.pointers.access(context + 1).astype(np.int64)
        out[known[found]] = at[found]
        return out
