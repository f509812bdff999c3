import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa

from tessera.llm import collocations as module
from tessera.llm.collocations import codes_of, collocations, from_planes, planes, split_words, squeezed
from tessera.llm.scratch import root
from tessera.llm.text import raw

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "lang string, text string, name long, batch string"


def brute(rows, least, most=5, percent=100, top=2000):
    f = {}
    for lang, text in rows:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts.update(tuple(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        candidates = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        inside = Counter()
        for g, c in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], c)
        kept = []
        for g, a in candidates.items():
            if not inside[g] or 100 * inside[g] < percent * a:
                score, k = min((1000 * a * n // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def run(spark, rows, least, parts=3, **more):
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in collocations(df, least=least, **more).collect())


def corpus(seed=1, texts=300):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "new", "york", "Äpfel", "été", "𝒳𝒴", "a-b", "no.", "x,", "#", "end!\n", "tab\tbed"]
    made = []
    for _ in range(texts):
        words = []
        while len(words) < rng.randrange(1, 60):
            words += rng.choice([["New", "York", "City", "hall"], ["new york"], rng.choices(vocabulary, k=3), ["la", "la", "la", "la", "la", "la"]])
        made.append((rng.choice(["en", "de", None, "und"]), " ".join(words)))
    return made + [("en", None), ("en", ""), ("fr", " \t . ! "), (None, "\r\n"), ("en", "new york " * 3000), *[made[0]] * 20]


def test_matches_brute_force(spark):
    rows = corpus()
    for more in ({}, {"batch_bytes": 500, "bucket_words": 400}, {"top": 7}, {"subsumed_percent": 60}, {"most_words": 3}):
        expected = brute(rows, 12, most=more.get("most_words", 5), percent=more.get("subsumed_percent", 100), top=more.get("top", 2000))
        assert len(expected) > 15
        assert run(spark, rows, 12, **more) == expected


def test_no_rows_and_no_phrases(spark):
    assert run(spark, [], 1) == []
    assert run(spark, [("en", None), ("en", " . ")], 1) == []
    assert run(spark, [("en", "one two three")], 2) == []
    assert run(spark, [("en", "one, two")], 1) == []
    assert run(spark, [("en", "b a")], 1) == [("en", 1, "b a", 1, 1, 1, 2, 2000)]


def test_score_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 3 * 10**12
    df = spark.createDataFrame([(big, big, big - 1, big - 2)], "a long, n long, l long, r long")
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    got = df.select(F.expr(f"CAST({wide(1000)} * a * n DIV ({wide('l')} * r) AS BIGINT)")).first()[0]
    assert got == 1000 * big * big // ((big - 1) * (big - 2))


def test_words_and_pieces():
    texts = pa.array(["A b,c", None, " d\te ", "f"])
    words, text, follows = split_words(*raw(texts))
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "f"] and text.tolist() == [0, 0, 0, 2, 2, 3] and follows.tolist() == [False, True, False, False, True, False]


def test_codes_round_trip():
    for codes in (np.empty(0, np.int32), np.array([-1, 5, 7], np.int32)):
        assert codes_of(squeezed(codes), 4 * len(codes)).tolist() == codes.tolist()
    for values in (np.array([0, 1, -1, 2**62, -(2**62)]), np.arange(1000)):
        assert from_planes(planes(values), len(values)).tolist() == values.tolist()


def test_tables_of_a_level_are_deleted_when_the_next_is_written(spark):
    folder = Path(root(spark).removeprefix("file://"))
    before = {*folder.glob("phrases-*")}
    df = spark.createDataFrame([("a b c d e a b c d e", "x"), ("a b c, d e", None)] * 3, "text string, lang string")
    assert module.collocations(df, least=2).count()
    left = {path.name.rpartition("-")[0] for path in {*folder.glob("phrases-*")} - before}
    assert left == {"phrases-grams", "phrases-totals"}


def test_names_of_words_go_back_in_one_row_for_each_batch_of_a_task(spark):
    rows = [(batch, code, "x", f"w{(7 * code + batch) % 40}", 1 + code) for batch in (3, 5 << 12, 9) for code in range(30)]
    words = module.named(spark.createDataFrame(rows, "batch long, code long, lang string, word string, n long"), ["lang", "word"], 20).persist()
    expected = [tuple(r) for r in words.select("batch", "code", "name").collect()]
    found = module.packed(words.coalesce(1)).collect()
    back = [r for r in found if r.batch is not None]
    assert len(back) == len({r[0] for r in expected}) and 0 < len(expected) < len(rows)
    unpacked = [(r.batch, *x) for r in back for x in zip(np.cumsum(module.from_planes(r.codes, r.size)).tolist(), module.from_planes(r.names, r.size).tolist())]
    assert sorted(unpacked) == sorted(expected)
    assert sorted(tuple(r)[:4] for r in found if r.batch is None) == sorted(tuple(r) for r in words.filter("own").select("name", "lang", "word", "f").collect())
