"""Integer vectors and exact inner products of any size, in numpy."""

from __future__ import annotations

import numpy as np

LONG = (1 << 63) - 1


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of finite values: float64 where that is exact, else Python integers (``scale`` is a power of two)."""
    with np.errstate(over="ignore"):
        out = np.floor(values * scale)
    if np.isfinite(out).all():
        return out  # a power of two moves the exponent only, so the product is exact
    whole = np.vectorize(lambda x: int(x) * scale if abs(x) > 2.0**53 else int(np.floor(x * scale)), otypes=[object])
    return whole(values)


def packed(matrix: np.ndarray) -> tuple[str, bytes]:
    """Type and bytes of a matrix of integers, in the smallest type that holds them."""
    if matrix.dtype == object:
        return "o", "\n".join(map(str, matrix.ravel())).encode()
    most = np.abs(matrix).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, matrix.astype(kind).tobytes()


def unpacked(kind: str, data: bytes, dim: int) -> np.ndarray:
    if kind == "o":
        return np.array([int(x) for x in data.decode().split("\n")], dtype=object).reshape(-1, dim)
    return np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices: as float64 below 2 ** 53, as int64 below 2 ** 62, else as Python integers."""
    bound = max(1, a.shape[1]) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2.0**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    whole = lambda m: m if m.dtype == object else np.array([int(x) for x in m.ravel()], dtype=object).reshape(m.shape)
    if bound < 2.0**62:
        return whole(a).astype(np.int64) @ whole(b).astype(np.int64).T
    return whole(a) @ whole(b).T


def clipped(score: int) -> int:
    """The score, held to the range of a long."""
    return max(-LONG - 1, min(LONG, int(score)))


def beyond(score: int) -> str | None:
    """A string that orders scores outside the range of a long as their values; none for others, which stand at "1" among those of the same clipped score."""
    score = int(score)
    if -LONG - 1 <= score <= LONG:
        return None
    digits = str(abs(score))
    key = f"{len(digits):04d}{digits}"
    return "1" + key if score > 0 else "0" + key.translate(str.maketrans("0123456789", "9876543210"))


def restored(score: int, key: str | None) -> int:
    """The integer that ``clipped`` and ``beyond`` stand for."""
    if key is None:
        return int(score)
    if key[0] == "1":
        return int(key[5:])
    return -int(key.translate(str.maketrans("0123456789", "9876543210"))[5:])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores (all, if fewer), best first, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    if len(scores) > k:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]
