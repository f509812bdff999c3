"""Batches of texts as bytes: words, their hashes and slices of bounded size, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PRIME = np.uint64(0x9E3779B97F4A7C15)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins (one more entry than texts); a null has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or not bounds[-1]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text, a row at least."""
    bounds, at = raw(texts)[1], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, end
        at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


FIELD = (1 << 61) - 1  # hashes of spans are polynomials over this prime field
BASE = 0x0D1342543DE82EF9
_P = np.uint64(FIELD)
_LOW = np.uint64((1 << 32) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2 ** 64 modulo the field's prime."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _shifted(x: np.ndarray, bits: int) -> np.ndarray:
    """``x * 2 ** bits`` in the field, for ``x`` below the prime: a rotation of 61 bits."""
    return ((x << np.uint64(bits)) & _P) | (x >> np.uint64(61 - bits))


def multiplied(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products in the field, from halves of 32 bits."""
    a, b, c, d = x >> np.uint64(32), x & _LOW, y >> np.uint64(32), y & _LOW
    middle = _reduced(a * d + b * c)  # each product lies below 2 ** 61
    return _reduced(_shifted(_reduced(a * c), 3) + _shifted(middle, 32) + _reduced(b * d))  # 2 ** 64 is 2 ** 3 here


_POWERS: list[np.ndarray] = []


def _powers(size: int) -> list[np.ndarray]:
    """High and low halves of powers of the base, and powers of its inverse, ``size`` at least; one table serves all smaller sizes."""
    if not _POWERS or len(_POWERS[0]) < size:
        tables = []
        for b in (BASE, pow(BASE, -1, FIELD)):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate([table, multiplied(table, np.uint64(pow(b, len(table), FIELD)))])
            tables.append(table)
        _POWERS[:] = [(tables[0] >> np.uint64(32)).astype(np.uint32), tables[0].astype(np.uint32), tables[1]]
    return _POWERS


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    values = np.arange(1, 257, dtype=np.uint64)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


SPAN = 1 << 22  # bytes whose running sums stay below 2 ** 63: a byte counts at most 2 ** 8 times 2 ** 32


def _running(terms: np.ndarray) -> np.ndarray:
    """Running sums in the field, with a zero in front; plain sums run over ``SPAN`` bytes at a time."""
    sums = np.zeros(len(terms) + 1, np.uint64)
    for at in range(0, len(terms), SPAN):
        part = sums[at + 1 : at + SPAN + 1]
        np.cumsum(terms[at : at + SPAN], out=part)
        part += sums[at]
        part[:] = _reduced(part)
    return sums


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand and in every process.

    Spans are polynomials over the field of 2 ** 61 - 1.  Modulo a power of two, long periodic spans would collide whatever the base is.
    """
    if not len(begin):
        return np.empty(0, np.uint64)
    high, low, inverses = _powers(max(1 << 16, len(data) + 1))
    values = _byte_values(lower)[data]
    sums = _running(values * high[: len(data)])
    found = _shifted(_reduced(sums[end] + (_P - sums[begin])), 32)
    sums = _running(values * low[: len(data)])
    found = _reduced(found + sums[end] + (_P - sums[begin]))
    return mixed(multiplied(found, inverses[begin]) + (end - begin).astype(np.uint64) * PRIME)


@dataclass
class Words:
    """Words of a slice of texts: hashes in order, where they stand, and where each text's words begin."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def documents(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> Words:
    """Runs of bytes other than ASCII white space; ``lower`` folds A-Z."""
    inside = ~SPACE[data]
    after = np.zeros(len(data) + 1, bool)
    after[1:] = inside
    after[bounds] = False  # a text's first byte begins a word even if the text before ends in one
    begin = np.flatnonzero(inside & ~after[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[:-1] = inside
    before[bounds] = False
    end = np.flatnonzero(inside & ~before[1:]) + 1
    return Words(span_hashes(data, begin, end, lower), begin, end, np.searchsorted(begin, bounds))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive values (none if there are fewer)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= PRIME
        out += hashes[k : k + n]
    return mixed(out)
