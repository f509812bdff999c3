import hashlib
import random
import re

from tessera.llm import decontamination
from tessera.llm.decontamination import decontaminate, item_windows, postings, proximity_matches
from tessera.llm.scratch import stage

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def windows(items, size):
    out = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            out.setdefault(tuple(w[i : i + size]), set()).add(item)
    return out


def brute(docs, items, size):
    found, out = windows(items, size), []
    for doc, text in docs:
        w, hit, seen = words(text), set(), set()
        for run, owners in found.items():
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i : i + len(run)]) == run:
                    hit |= set(range(i, i + len(run)))
                    seen |= owners - {None}
        ids = sorted(map(str, seen))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, term string, _window int"),
        spark.createDataFrame([(t, i, "y") for i, t in items], "text string, item_id long, doc_id string"),
    )


def run(spark, docs, items, size=4):
    return sorted((tuple(r) for r in decontaminate(*tables(spark, docs, items), window=size).collect()), key=repr)


def made(seed=4):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Äpfel", "a1", "no", "xylo", "quartz", "İx", "brown", "fox", "ÉTÉ", "b"]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=range(12, 0, -1), k=n))
    items = [(i, text(rng.choice([2, 4, 6, 12]))) for i in range(12)]
    items += [(50, items[0][1].upper()), (51, "only"), (52, "never seen before words here"), (53, None), (54, "... !"), (None, "rare phrase without id"), (7, "quartz quartz quartz quartz quartz")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    docs += [(100 + i, f"{text(5)}, {items[i][1]}; {text(5)}") for i in range(12)]
    docs += [(i, "The OF the of\tthe-of the_of, rare phrase. WITHOUT id only") for i in (200, 200, None, None)]
    docs += [(None, "other text only"), (201, None), (202, ""), (203, "quartz " * 500), (204, "...")]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = made()
    expected = brute(docs, items, 4)
    assert sum(r[5] for r in expected) > 20
    assert run(spark, docs, items) == expected


def test_no_rows_and_no_items(spark):
    assert run(spark, [], [(1, "a b c d")]) == []
    assert run(spark, [(1, "a b c d"), (2, None)], []) == brute([(1, "a b c d"), (2, None)], [], 4)


def test_the_index_holds_every_occurrence_of_its_terms(spark):
    docs = spark.createDataFrame([(1, 9, "A b a, c"), (2, 8, None)], "_id long, _hash long, _text string")
    terms = spark.createDataFrame([("a",), ("zzz",)], "term string")
    assert sorted(tuple(r) for r in postings(docs, terms).collect()) == [("", 1, 9, 4), ("", 2, 8, 0), ("a", 1, 9, 0), ("a", 1, 9, 2)]


def test_equal_windows_are_one(spark):
    items = spark.createDataFrame([(1, "a b a b a b"), (2, "A b")], "item_id long, text string")
    rows = sorted(tuple(r) for r in item_windows(items, 2, "item_id", "text").collect())
    assert rows == [(1, "a b", 2), (1, "b a", 2), (2, "a b", 2)]


def test_proximity_matches_brute_force(spark):
    docs, items = made(9)
    got = proximity_matches(*tables(spark, docs, items), window=4, slop=2).collect()
    expected = set()
    for doc, text in docs:
        w = words(text)
        for run_, owners in windows(items, 4).items():
            reach = len(run_) + 2
            if any(set(run_) <= set(w[s : s + reach]) for s in range(len(w))):
                expected |= {(doc, text, owner) for owner in owners}
    hashes = {h: t for t, h in spark.createDataFrame([(t,) for t in {t for _, t in docs}], "text string").selectExpr("text", "xxhash64(text)").collect()}
    assert {(r.doc_id, hashes[r.text_hash], r.item_id) for r in got} == expected
    assert len(expected) > len(brute(docs, items, 4)) / 4


def joined_columns(plan):
    """The names of the columns that the joins of an optimized plan take in."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [c.output().apply(i).name() for c in children for i in range(c.output().size())] if plan.nodeName() == "Join" else []
    return own + [name for c in children for name in joined_columns(c)]


def test_no_join_takes_whole_texts(spark, monkeypatch):
    seen = []

    def noted(df, name):
        seen.append((name, df))
        return stage(df, name)

    monkeypatch.setattr(decontamination, "stage", noted)
    docs, items = made()
    seen.append(("result", decontaminate(*tables(spark, docs, items), window=4)))
    columns = {name: joined_columns(df._jdf.queryExecution().optimizedPlan()) for name, df in seen}
    assert "near" in columns["leak-found"]
    assert not any("_text" in found for found in columns.values())


def test_ends_of_texts_repeated_rows_and_long_texts(spark):
    run_ = "quartz a1 xylo fox"
    fill = lambda n: " ".join(["the"] * n)
    items = [(1, run_), (2, f"{run_} b no"), (3, "Solo"), (4, "fox fox"), (None, "b no")]
    docs = [(i, f"{fill(i)} {run_} {fill(j)}") for i in range(6) for j in range(6)]
    docs += [(100, run_), (101, f"{run_} {run_} b no"), (102, f"{fill(3000)} {run_} b {fill(3000)} fox FOX fox {fill(50)} solo")]
    docs += [(None, f"{fill(9)} {run_}")] * 7 + [(None, None)] * 3 + [(103, f"solo {run_}")] * 7 + [(103, "the " * 20)] * 2
    assert run(spark, docs, items) == brute(docs, items, 4)


def test_postings_of_rarest_words_have_the_words_around_them(spark):
    docs = spark.createDataFrame([(1, 9, "A b c, d"), (None, 7, "c"), (2, 8, None)], "_id long, _hash long, _text string")
    terms = spark.createDataFrame([("a", False), ("c", True)], "term string, rarest boolean")
    got = sorted((tuple(r) for r in postings(docs, terms, 2).collect()), key=repr)
    assert got == sorted([("", 1, 9, 4, None), ("", 2, 8, 0, None), ("", None, 7, 1, None), ("a", 1, 9, 0, None), ("c", 1, 9, 2, "b c d"), ("c", None, 7, 0, "c")], key=repr)
