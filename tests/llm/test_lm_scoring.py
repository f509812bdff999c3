import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_scoring as lm
from tessera.llm.language import in_fold
from tessera.llm.queries import op10_lm_scoring


def split(text):
    return [*(text or "").encode().lower().split(), b"</s>"]


def brute(rows, order):
    learnt = [split(t) for i, t in rows if i % 7 != 2]
    padded = lambda words: [b"<s>"] * (order - 1) + words
    counts, contexts = Counter(), Counter()
    for words in learnt:
        words = padded(words)
        for i in range(order - 1, len(words)):
            for k in range(order):
                counts[tuple(words[i - k : i + 1])] += 1
                if k:
                    contexts[tuple(words[i - k : i])] += 1
    total = sum(map(len, learnt))
    distinct = len({w for words in learnt for w in words})
    weight = lambda k: 1.0 if k == 1 else lm.HIGHER

    def mass(gram):
        if len(gram) == 1:
            return lm.PRIOR * (counts[gram] + 1) / (total + distinct + 1)
        return counts[gram] + weight(len(gram) - 1) * mass(gram[1:])

    def context_mass(context):
        return contexts[context] + weight(len(context)) * context_mass(context[1:]) if context else lm.PRIOR

    out = []
    for i, text in rows:
        words = padded(split(text))
        grams = [tuple(words[k - order + 1 : k + 1]) for k in range(order - 1, len(words))]
        score = sum(math.log10(mass(g)) - math.log10(context_mass(g[:-1])) for g in grams)
        base = sum(math.log10((counts[g[-1:]] + 1) / (total + distinct + 1)) for g in grams)
        out.append((i, len(grams), sum(counts[g[-1:]] > 0 for g in grams), total, base, score))
    return sorted(out)


@pytest.mark.parametrize("order, shard_tokens", [(2, 10**6), (2, 300), (3, 10**6), (3, 300)])
def test_scores_match_brute_force(spark, monkeypatch, order, shard_tokens):
    monkeypatch.setattr(lm, "SLICE_BYTES", 1500)
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard_tokens)  # small shards deal frequent words out in parts
    rng = random.Random(order)
    texts = [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(1, 50))) for _ in range(150)]
    texts += [None, "", " \n", "ONE One one", "new words only here", "w1 " * 3000]
    rows = list(enumerate(texts)) + [(4, texts[4])]
    frame = lambda r: spark.createDataFrame([(i, t, 1) for i, t in r], "doc_id long, text string, shard int")
    df = frame(rows).repartition(3).unionByName(frame([(3, "twice w1 w2")]).coalesce(1)).unionByName(frame([(3, "twice w1 w2")]).coalesce(1))  # two batches of one content
    rows += [(3, "twice w1 w2")] * 2
    got = sorted(tuple(r) for r in lm.score_texts(df, F.col("doc_id") % 7 != 2, order).collect())
    expected = brute(rows, order)
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    for g, e in zip(got, expected):
        assert g[4] == pytest.approx(e[4], rel=1e-9)
        assert g[5] == pytest.approx(e[5], rel=1e-4)


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert lm.score_texts(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    r = lm.score_texts(spark.createDataFrame([(2, "a b")], schema), F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in (None, 0, 5, 123456789)], "doc_id long").withColumn("f", in_fold(F.col("doc_id"), 7, 2)).collect()
    assert [r.f for r in rows] == [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2 for r in rows]


def test_the_registered_query_looks_two_words_back(spark, tmp_path):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, "a b c" if i % 2 else "x b d") for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2] + list(zip(held, ("a b c", "a b d")))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in op10_lm_scoring(spark, str(tmp_path)).collect()}
    assert score[held[0]] > score[held[1]] + 1
