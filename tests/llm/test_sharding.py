import hashlib
import random
import zlib
from collections import defaultdict
from itertools import accumulate

import pytest

from tessera.llm import sharding
from tessera.llm.sharding import greedy_cuts, minimax_cuts, shard_by_bytes


def best_largest(sizes, shards):
    """Least largest segment over all contiguous partitions, by dynamic programming."""
    prefix = [0, *accumulate(sizes)]
    best = [prefix[i] for i in range(len(prefix))]
    for _ in range(shards - 1):
        best = [min(max(best[j], prefix[i] - prefix[j]) for j in range(i + 1)) for i in range(len(prefix))]
    return best[-1]


@pytest.mark.parametrize("seed", range(20))
def test_minimax_is_optimal(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50, rng.randrange(1, 400)]) for _ in range(rng.randrange(1, 30))]
    shards = rng.randrange(1, 8)
    cuts = minimax_cuts(sizes, shards)
    assert len(cuts) == shards and cuts[-1] == len(sizes) and cuts == sorted(cuts)
    assert max(sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts)) == best_largest(sizes, shards)


def test_greedy_stops_before_a_unit_over_the_capacity():
    assert greedy_cuts([0, 3, 8], 4) == [1, 1]
    assert minimax_cuts([], 3) == []


def test_no_shard_is_left_with_a_remainder():
    sizes = [10] * 1000
    cuts = minimax_cuts(sizes, 24)
    filled = [b - a for a, b in zip([0, *cuts], cuts)]
    assert max(filled) - min(filled) <= 1


def test_rows_slots_and_groups(spark):
    rng = random.Random(1)
    texts = [None, "", "é", "same", "long " * 4000] + [f"text {rng.randrange(150)}" * rng.randrange(1, 9) for _ in range(400)] + ["same"] * 150
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, "x")]
    df = spark.createDataFrame([(i, t, 5, "a") for i, t in rows], "doc_id long, text string, size int, shard string")
    out = shard_by_bytes(df, shards=5)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = out.collect()
    raw = lambda t: (t or "").encode()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(((i, len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t in rows), key=key)
    slots, sizes, homes = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert set(slots) <= set(range(5)) and all(r.law == "bytes" and r.grown_shard is None for r in got)
    assert max(sizes.values()) <= sum(sizes.values()) / 5 + 20008


@pytest.mark.parametrize("digits, shards, hot", [(1, 3, 0), (1, 7, 0), (2, 5, 4000), (1, 24, 0), (4, 24, 0)])
def test_the_largest_shard_is_as_small_as_groups_allow(spark, monkeypatch, digits, shards, hot):
    monkeypatch.setattr(sharding, "UNIT_DIGITS", digits)  # few digits put many groups in a unit
    rng = random.Random(digits * 100 + shards)
    texts = [f"{rng.randrange(260)} " * rng.randrange(1, 60) for _ in range(500)] + ["hot text"] * hot
    groups = defaultdict(int)
    for t in texts:
        groups[hashlib.md5(t.encode()).hexdigest()] += len(t) + 8
    sizes = [groups[k] for k in sorted(groups)]
    out = shard_by_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=shards).groupBy("shard").sum("size").collect()
    assert max(r[1] for r in out) == best_largest(sizes, shards) and sum(r[1] for r in out) == sum(sizes)


def test_empty_and_fewer_rows_than_shards(spark):
    schema = "doc_id long, text string"
    assert shard_by_bytes(spark.createDataFrame([], schema)).count() == 0
    got = shard_by_bytes(spark.createDataFrame([(1, "a"), (2, "bb")], schema)).collect()
    assert sorted(r.slot for r in got) == [0, 0] and len({r.shard for r in got}) == 2
