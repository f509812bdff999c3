import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm.elias_fano import EliasFano, MappedFile, Quantised, TrieLevel


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(1, 64), st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20))
def test_access_and_successor(values, bits, keys):
    values = sorted({v >> (64 - bits) for v in values})
    keys = np.array([k >> (64 - bits) for k in keys] + values, np.uint64)
    with MappedFile() as file:
        ef = EliasFano(np.array(values, np.uint64), 1 << bits, file)
        assert ef.access(np.arange(len(values))).tolist() == values
        at, found = ef.successor(keys)
        assert found.tolist() == [int(k) in set(values) for k in keys]
        assert all(values[a] == k for a, k, f in zip(at, keys.tolist(), found) if f)


def test_dense_and_repeated_values():
    values = np.repeat(np.arange(50), 7)
    with MappedFile() as file:
        ef = EliasFano(values, 50, file)
        assert ef.access(np.arange(len(values))).tolist() == values.tolist()


@pytest.mark.parametrize("bits", [5, 32])
def test_trie_level(bits):
    rng = np.random.default_rng(bits)
    keys = np.unique(rng.integers(0, 20 << bits, 300))
    parents, labels = keys >> bits, keys & ((1 << bits) - 1)
    with MappedFile() as file:
        level = TrieLevel(parents, labels, 20, bits, file)
        assert level.find(parents, labels).tolist() == list(range(len(keys)))
        probe = rng.integers(0, 20 << bits, 500)
        got = level.find(probe >> bits, probe & ((1 << bits) - 1))
        where = {k: i for i, k in enumerate(keys.tolist())}
        assert got.tolist() == [where.get(k, -1) for k in probe.tolist()]
        assert level.find(np.array([-1]), np.array([0])).tolist() == [-1]


def test_quantised():
    with MappedFile() as file:
        values = np.random.default_rng(1).normal(size=1000)
        assert np.abs(Quantised.of(values, file).at(np.arange(1000)) - values).max() < 1e-4
