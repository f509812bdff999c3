import re

import pytest

from tessera.llm.license_scan import NOTICES, PHRASES, Template, scan_licenses

PHRASE_WORDS = {p.text: p.label for p in PHRASES}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in PHRASE_WORDS.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "?!", "one", "Under the MIT-License.", "under the mit license under THE mit license", "under the mit  licenses", "Licensed under CC BY-NC 4.0.",
    "the Apache License, Version 2.0 and cc_by_nc", "x " * 20000 + "under the mit license", "cc by nc by nc cc by nc", "çc by nc", "apache license version 3",
    "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files",
    "This work is licensed under the GNU General Public License, version 3.", "permission is hereby granted", "under the\nmit\tlicense",
]


def test_base_columns_match_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4]), (4, "another text"), (None, "cc by nc")]
    df = spark.createDataFrame([(i, t, 1, "l") for i, t in rows], "doc_id long, text string, n_words int, labels string")
    got = [tuple(r[:6]) for r in scan_licenses(df).collect()]
    assert sorted(got, key=repr) == sorted([(i, *brute(t)) for i, t in rows], key=repr)


def test_method_finds_notices_with_gaps(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    changed = TEXTS.index(next(t for t in TEXTS if t and t.startswith("Permission is hereby granted, free")))
    assert got[changed].labels == "mit" and got[changed].base_labels == "" and 0.7 <= got[changed].score < 1
    gpl = next(i for i, t in enumerate(TEXTS) if t and "GNU" in t)
    assert got[gpl].labels == "gpl-3" and got[gpl].score == 1.0
    assert got[TEXTS.index("permission is hereby granted")].labels == ""
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.values() if r.base_labels)


def test_templates_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert scan_licenses(df).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(df, [Template("x", "too short")])
    assert all(t.text == " ".join(re.findall(r"[a-z0-9]+", t.text)) for t in PHRASES + NOTICES)
