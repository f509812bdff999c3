import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import PartTokenizer, best_fill, pack_windows, plan_windows

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a b", "a  b", "a \n b\n\nc ", "x\xa0 y", "\x85 x", "a　 b", "é a È! b", "don't  we'll\t go 123 4", "\n\n a", " ", " \n", "x <|endoftext|> y"]


def whole(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_parts_give_the_ids_of_whole_texts():
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(" \n\tab.É’1") for _ in range(rng.randrange(60))) for _ in range(300)]
    assert [list(array("I", x)) for x in PartTokenizer(PATH).encode(texts)] == whole(texts)


def test_added_tokens_have_their_own_ids(spark):
    end = "<|endoftext|>"
    texts = [*ODD, end, end + end, f" {end} ", f"a{end}b  c", f"a  {end}\n\n b", "<|endoftext|", f"<{end}>", f"é {end} 　{end}x"]
    expected = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert 50256 in expected[ODD.index("x <|endoftext|> y")]
    assert [list(array("I", x)) for x in PartTokenizer(PATH, added=True).encode(texts)] == expected
    out = pack_windows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    assert {r.doc_id: r.ids_crc32 for r in out} == {i: zlib.crc32(array("I", [*ids, 1]).tobytes()) for i, ids in enumerate(expected)}


@pytest.mark.parametrize("seed", range(5))
def test_best_fill_leaves_the_least_slack(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(6)}
    used = best_fill(counts, 40)
    assert all(counts[n] >= k for n, k in used.items())
    sums = {max(counts)}
    for n, c in counts.items():
        for _ in range(c - (n == max(counts))):
            sums |= {s + n for s in sums if s + n <= 40}
    assert sum(n * k for n, k in used.items()) == max(sums)


def test_plan_places_every_length_once():
    histogram = {7: 5, 13: 2, 20: 9, 1: 3}
    plan = plan_windows(histogram, 32)
    for length, count in histogram.items():
        firsts = sorted(r[1] for r in plan.tolist() if r[0] == length)
        assert firsts[0] == 0 and max(firsts) < count


def test_pieces_cover_documents_and_windows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "house", "größer", "x1"]) for _ in range(rng.randrange(1, 90)))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "a b"), (5, rows[5][1]), (62, "word " * 700)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int")
    out = pack_windows(df, PATH, window=64).collect()
    assert [f for f in pack_windows(df, PATH, window=64).columns] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    expected = []
    for (i, _), ids in zip(rows, whole([t or "" for _, t in rows])):
        ids = ids + [1]
        expected += [(i, s, len(ids[s : s + 64]), zlib.crc32(array("I", ids[s : s + 64]).tobytes()), len(ids)) for s in range(0, len(ids), 64)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[:5]) for r in out), key=key) == sorted(expected, key=key)
    windows = {}
    for r in out:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    filled = sum(r.length for r in out)
    assert filled > 0.95 * 64 * len(windows)


def test_empty_table(spark):
    assert pack_windows(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
