import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm.language import BUCKETS, SMOOTHING, _folded, features, identify_language, train_language_model

WORDS = {"aa": ["bada", "bido", "dabi"], "zz": ["xuvy", "vyxe", "éxuv"]}


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(1, 12))), lang))
    return out


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus(200, 1) + [(None, "bada", None), (500, None, "aa"), (501, "", "aa"), (502, "12 !?", "zz"), (503, "bada " * 50000, None), (7, corpus(200, 1)[7][1], corpus(200, 1)[7][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = train_language_model(df.filter("doc_id % 2 = 0"))
    out = identify_language(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.lang and r.doc_id % 2 and r.text and r.text.strip("12 !?")]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (500, 501, 502))
    assert by_id[503].lang_pred == "aa" and by_id[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = train_language_model(empty)
    assert identify_language(empty, model).count() == 0
    some = spark.createDataFrame([(1, "bada", "aa")], empty.schema)
    assert identify_language(some, model).first().lang_pred == "und"


def test_features_do_not_cross_texts():
    buckets, rows, letters = features(pa.array(["ab", None, "é!b", "", "C"]))
    assert list(letters) == [2, 0, 2, 0, 1] and list(rows).count(0) == 1 and set(rows) <= {0, 2}
    assert (buckets < BUCKETS).all()
    same, _, _ = features(pa.array(["AB"]))
    assert same[0] == buckets[0]


def slow_features(text):
    """Buckets of all runs of two and three characters with a letter, one character at a time."""
    points = [(ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0 for c in text or ""]
    out = []
    for n in (2, 3):
        for i in range(len(points) - n + 1):
            if any(points[i : i + n]):
                key = n
                for p in points[i : i + n]:
                    key = (key ^ p) * 0x9E3779B1 % 2**32
                    key ^= key >> 15
                out.append(key % BUCKETS)
    return out


def test_predictions_match_slow_naive_bayes(spark):
    rng = random.Random(5)
    alphabets = {"aa": "abcdeé ", "bb": "abfgh. ", "cc": "αβγδΕ ", "dd": "\u3400\U00032100\U00020001 1"}
    rows = [(i, "".join(rng.choice(alphabets[x]) for _ in range(rng.randrange(30))), x) for i in range(150) for x in [rng.choice([*alphabets])]]
    rows += [(900, "a", None), (901, "", "aa"), (902, None, "bb"), (903, "\U00032100", None), (904, "A", "aa"), (905, "12", None), (906, "abc", None)]
    counts, texts = {}, Counter()
    for _, text, lang in rows:
        if lang and text is not None:
            texts[lang] += 1
            counts.setdefault(lang, Counter()).update(slow_features(text))
    known = [x for x in sorted(texts) if counts[x] or texts[x]]

    def slow(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        logs = {}
        for x in known:
            total = sum(counts[x].values()) + SMOOTHING * BUCKETS
            logs[x] = math.log(texts[x] / texts.total()) + sum(math.log((counts[x][f] + SMOOTHING) / total) for f in slow_features(text))
        best = max(known, key=lambda x: (logs[x], [-ord(c) for c in x]))
        return best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = train_language_model(df)
    assert model.languages == known
    for i, x in enumerate(known):
        found = np.exp(model.log_probability[:, i].astype(float)) * (sum(counts[x].values()) + SMOOTHING * BUCKETS) - SMOOTHING
        assert np.allclose(found, [counts[x][b] for b in range(BUCKETS)], atol=1e-2)
    for r in identify_language(df, model).collect():
        lang, score = slow(r.text)
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, abs=1e-4))


def test_every_letter_is_a_letter():
    assert [p for p in range(0x110000) if chr(p).isalpha() != bool(_folded()[p])] == []
