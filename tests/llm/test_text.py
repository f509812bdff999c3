import numpy as np
import pytest

from tessera.llm import text as T


def plain(span: bytes, lower: bool = False) -> int:
    """The polynomial in Python integers, before its bits are mixed."""
    span = span.lower() if lower else span
    return sum((b + 1) * pow(T.BASE, i, T.FIELD) for i, b in enumerate(span)) % T.FIELD


def hashed(parts: list[bytes], lower: bool = False) -> np.ndarray:
    ends = np.cumsum([len(p) for p in parts])
    return T.span_hashes(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends, lower)


def test_products_in_the_field():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, T.FIELD, 500), [0, 1, T.FIELD - 1, T.FIELD - 1, 1 << 32, (1 << 32) - 1]]).astype(np.uint64)
    y = np.concatenate([rng.integers(0, T.FIELD, 500), [T.FIELD - 1, T.FIELD - 1, T.FIELD - 1, 2, 1 << 32, 1 << 60]]).astype(np.uint64)
    assert T.multiplied(x, y).tolist() == [int(a) * int(b) % T.FIELD for a, b in zip(x, y)]


@pytest.mark.parametrize("lower", [False, True])
def test_hashes_are_those_of_plain_polynomials_wherever_spans_stand(lower, monkeypatch):
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in rng.integers(0, 40, 60)] + [b"", b"\xff" * 500, b"Ab", b"aB"]
    if lower:  # only A-Z fold
        parts = [bytes(b if b < 128 else 120 for b in p) for p in parts]
    want = T.mixed(np.array([plain(p, lower) for p in parts], np.uint64) + np.array([len(p) for p in parts], np.uint64) * T.PRIME)
    assert hashed(parts, lower).tolist() == want.tolist()
    monkeypatch.setattr(T, "SPAN", 64)  # sums run over several stretches
    assert hashed(parts, lower).tolist() == want.tolist()
    assert hashed(parts[::-1], lower).tolist() == want[::-1].tolist()


@pytest.mark.parametrize("power", range(4, 14))
@pytest.mark.parametrize("block", [1, 3, 16])
def test_complementary_binary_patterns_differ(power, block):
    # the two patterns of 2 ** k blocks that collide modulo 2 ** 64 whatever the base, from 1,024 blocks on
    signs = np.array([bin(i).count("1") & 1 for i in range(1 << power)], bool)
    one, other = (b"".join(b"a" * block if s else b"b" * block for s in x) for x in (signs, ~signs))
    first, second = hashed([one, other])
    assert first != second
