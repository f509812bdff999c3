import random

import pytest

import corpus_pipeline
from tests.llm.test_mixing import water_filled
from tests.llm.test_near_duplicates import brute as near_brute
from tests.llm.test_quality import brute as quality_brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    rows = [(i, prose(rng.randrange(12, 120)), "en", rng.choice(["s1", "s2", None])) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more words", "en", "s1") for i in range(0, 60, 2)] + [(400 + i, rows[i][1], None, "s2") for i in range(20)]
    rows += [(500, None, "en", "s1"), (501, "", "en", "s1"), (502, "12 34 !", "en", "s2"), (503, "few words", "en", "s1"), (504, "again and again we go " * 40, "en", "s2"), (505, prose(9000), "en", None)]
    folder = tmp_path_factory.mktemp("data")
    df = spark.createDataFrame([(*r, len(r[1] or ""), r[0]) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, kept long")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, function in corpus_pipeline.STAGES:
        function(spark, out[-1], str(folder)).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return str(folder), out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns_of_documents(stages):
    _, out = stages
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "mixing", "packing"]
    assert all(df.columns == out[0].columns for df in out[:-1])
    assert all(r.kept == r.doc_id for df in out[:-1] for r in df.collect())


def test_language_id_drops_texts_without_letters(stages):
    _, out = stages
    before, after = rows_of(out[0]), rows_of(out[1])
    assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}


def test_quality_rules_drop_what_fails_and_keep_prose(stages):
    _, out = stages
    before, after = rows_of(out[1]), rows_of(out[2])
    n = lambda r: quality_brute(r.text)
    assert set(after) == {i for i, r in before.items() if n(r)[0] >= 10 and 100 * n(r)[4] <= 20 * n(r)[0]}
    assert not {503, 504} & set(after)


def test_one_document_of_each_group_stays(stages):
    _, out = stages
    before = rows_of(out[2])
    expected = {i for i, _, _, kept in near_brute([(r.doc_id, r.text) for r in before.values()]) if kept}
    assert [r.doc_id for r in out[3].orderBy("doc_id").collect()] == sorted(expected)
    assert not set(range(400, 420)) & expected


def test_mix_follows_the_targets(stages):
    _, out = stages
    sizes, taken, largest = {}, {}, {}
    for r in out[3].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
        largest[r.source] = max(largest.get(r.source, 0), len(r.text.split()))
    for r in out[4].collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for source, target in water_filled(sizes).items():
        assert abs(taken[source] - target) <= largest[source]  # copies are whole, so the largest document bounds the error


def test_packing_holds_every_copy_once(stages, spark):
    folder, out = stages
    copies = {r.doc_id: r["count"] for r in out[4].groupBy("doc_id").count().collect()}
    firsts = {r.doc_id: r["count"] for r in out[5].filter("start = 0").groupBy("doc_id").count().collect()}
    assert firsts == copies
    assert out[5].groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").isEmpty()
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect())) == sorted(map(tuple, out[5].drop("sequence_id", "offset").collect()))


def test_stages_take_empty_tables_and_nulls_anywhere(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, _text string, lang_pred string, score int, _row int, _id int, kept int"
    prose = "a plain sentence with more than ten words stands here, and it goes on for some more of them"
    rows = [(None, None, None, None, None, None, None, None, None, None, None), (1, prose, None, None, None, "t", "p", 3, 4, 5, 6), (None, prose + " twice", "en", "s", 1, None, None, None, None, None, None)]
    for data, most in (([], 0), (rows, 2)):
        docs = spark.createDataFrame(data, schema)
        for _, function in corpus_pipeline.STAGES[:-1]:
            docs = function(spark, docs, "")
            assert docs.dtypes == spark.createDataFrame([], schema).dtypes and docs.select("doc_id").distinct().count() <= most
        if most:
            assert [tuple(r)[5:] for r in docs.filter("doc_id = 1").distinct().collect()] == [("t", "p", 3, 4, 5, 6)]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


ENGLISH = ["the house stands by the river and the children are there", "there is nothing in this house that they want", "which of these words would you rather have"]
GERMAN = ["das haus steht am fluss und die kinder sind auch dort", "es gibt nichts in diesem haus was sie haben wollen", "welche von diesen worten willst du lieber haben"]


def test_the_predicted_language_takes_effect(spark):
    rows = [(i, t + f" {t}", lang) for i, (t, lang) in enumerate([(t, "en") for t in ENGLISH * 3] + [(t, "de") for t in GERMAN * 3])]
    rows += [(100, "die kinder wollen das haus am fluss haben", None), (101, "the children would rather have the house", None), (102, "die worte die sie haben wollen", "en"), (103, "12 !", None)]
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert (got[100], got[101], got[102]) == ("de", "en", "de") and 103 not in got and len(got) == len(rows) - 1


def test_ambiguous_texts_go(spark):
    rows = [(0, "aaaa", "l0"), (1, "bbbb", "l1"), (2, "cccc", "l2"), (3, "ddd", None)]
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()} == {0, 1, 2}


def test_without_any_language_texts_with_letters_stay(spark):
    rows = [(0, "the house", None), (1, "12 !", None), (2, None, None), (3, "дом", None)]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert {(r.doc_id, r.lang) for r in got} == {(0, None), (3, None)}
