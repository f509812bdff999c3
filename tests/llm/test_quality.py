import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality as q

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {r for r, c in Counter(runs).items() if c > 1}
    covered = {k for i, r in enumerate(runs) if r in twice for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def random_texts(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "é#", "ñ|x", "Ω", "\xa0"]
    return ["".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "\n\n", " \t", "  "]) for _ in range(rng.randrange(40))) for _ in range(120)]


@pytest.mark.parametrize("seed", range(3))
def test_counts_match_brute_force(seed):
    texts = [*random_texts(seed), None, "", " \n\n ", "x", "\n", "a b c d e " * 3000, "l1\nl1\n l1\nl1", "no end\n\nno end"]
    random.Random(seed).shuffle(texts)
    got = q.base_counts(pa.array(texts, pa.string()))
    assert [tuple(int(got[x][i]) for x in q.LONGS) for i in range(len(texts))] == [brute(t) for t in texts]


def symbols(text):
    return [int(q.symbol_table()[ord(c)]) for c in text or ""]


def test_ngrams_stay_within_texts():
    texts = ["abcd", "", "d", "efg", "GhIjk", None, "k", ""]
    codes, lengths = q.ngrams(pa.array(texts))
    code = lambda s: sum(x << 7 * (3 - i) for i, x in enumerate(symbols(s)))
    assert list(lengths) == [1, 0, 0, 0, 2, 0, 0, 0] and list(codes) == [code("abcd"), code("ghij"), code("hijk")]


def test_symbols_keep_letters_of_an_alphabet_apart():
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àáâãäåæçèéêëìíîïðñòóôõö", "ابتثجحخدذرزسشصضطظعغ"):
        assert len(set(symbols(alphabet))) == len(alphabet)
        assert symbols(alphabet) == symbols(alphabet.upper())
    assert len(set(symbols("#*$%&|<> \n"))) == 10


class Slow:
    """Interpolated modified Kneser-Ney by its definition, over dictionaries."""

    def __init__(self, texts):
        grams = Counter(tuple(s[i : i + 4]) for s in map(symbols, texts) for i in range(len(s) - 3))
        self.by_hash = Counter()
        for gram, n in grams.items():
            self.by_hash[self.hash(gram)] += n
        self.levels = [grams]
        for _ in range(3):
            self.levels.append(Counter(g[1:] for g in self.levels[-1]))
        self.followers = [defaultdict(list) for _ in self.levels]
        for level, followers in zip(self.levels, self.followers):
            for gram, n in level.items():
                followers[gram[:-1]].append(n)
        self.d = [q.discounts(*(sum(n == k for n in level.values()) for k in (1, 2, 3, 4))) for level in self.levels]

    @staticmethod
    def hash(gram):
        return int(q.hashed(np.array([sum(x << 7 * (3 - i) for i, x in enumerate(gram))]))[0])

    def probability(self, gram, level=0):
        if level == 4:
            return 1 / 128
        lower, counts = self.probability(gram[1:], level + 1), self.followers[level].get(gram[:-1])
        if not counts:
            return lower
        d = self.d[level]
        n = self.levels[level].get(gram, 0) if level else self.by_hash[self.hash(gram)]  # n-grams of order four may share a hash
        return min((n - d[min(n, 3)]) / sum(counts), 1) + sum(d[min(x, 3)] for x in counts) / sum(counts) * lower

    def bits(self, text):
        s = symbols(text)
        return -sum(math.log2(self.probability(tuple(s[i : i + 4]))) for i in range(len(s) - 3)) if len(s) > 3 else None


def quantile(values, share):
    """The smallest value that at least this share of values does not exceed."""
    return sorted(values)[max(0, math.ceil(share * len(values)) - 1)]


def steadiness(n):
    return math.sqrt(n * 1000 / (n + 1000))


def test_operator_matches_a_slow_version(spark, monkeypatch):
    monkeypatch.setattr(q, "LEAST_TEXTS", 20)
    rng = random.Random(9)
    make = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "a", "en", "."]) for _ in range(n))
    english, greek = ["the", "tree", "stands", "there", "and", "rests", "then"], ["και", "δέντρο", "εκεί", "στέκει", "ύστερα"]
    rows = [(i, make(english, rng.randrange(12, 90)), "en", 1) for i in range(80)] + [(i, make(greek, rng.randrange(12, 90)), "el", 1) for i in range(100, 140)]
    rows += [(200 + i, " ".join(w + "***" for w in make(english, 60).split()), "en", 1) for i in range(3)]
    rows += [(900, None, None, 1), (901, "", "en", 1), (902, " ".join("".join(rng.choice("ZXQJz9~#,") for _ in range(8)) for _ in range(30)), "el", 1)]
    rows += [(903, "x y", "xx", 1), (904, make(english, 30), "xx", 1), (905, make(greek, 30), None, 1), (0, rows[0][1], "en", 1), (None, rows[1][1], None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int").withColumn("deviation", q.F.lit("own"))

    slot = lambda lang: lang if lang in ("en", "el") else q.OTHER
    models = {x: Slow(t for _, t, lang, _ in rows if x in (q.OTHER, lang)) for x in ("en", "el", q.OTHER)}
    per_word = {}
    for i, (_, text, lang, _) in enumerate(rows):
        n = brute(text)[0]
        found = models[slot(lang)].bits(text) if n else None
        per_word[i] = None if found is None else found / n
    expected = []
    bands = {}
    for x in models:
        own = [(per_word[i], brute(r[1])[0]) for i, r in enumerate(rows) if slot(r[2]) == x and per_word[i] is not None]
        median = quantile([b for b, _ in own], 0.5)
        z = [(b - median) * steadiness(n) for b, n in own]
        q1, q3 = quantile(z, 0.25), quantile(z, 0.75)
        reach = q.FENCE * max(q3 - q1, q.LEAST_SPREAD)
        bands[x] = median, q1 - reach, q3 + reach
    for i, (id_, text, lang, _) in enumerate(rows):
        counts = brute(text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        median, low, high = bands[slot(lang)]
        inside = per_word[i] is None or low <= (per_word[i] - median) * steadiness(counts[0]) <= high
        expected.append((str(id_), text, *counts, failed, per_word[i] and pytest.approx(per_word[i], rel=1e-4), not failed and inside))

    model = q.train_perplexity(df)
    out = q.quality_rules(df, model)
    assert out.columns == ["doc_id", "text", "lang", *q.LONGS, "base_failed", "bits_per_word", "deviation", "kept"]
    key = lambda r: (r[0], r[1] or "")
    got = [(str(r.doc_id), r.text, *[r[x] for x in q.LONGS], r.base_failed, r.bits_per_word, r.kept) for r in out.collect()]
    assert len(got) == len(expected)
    for found, wanted in zip(sorted(got, key=key), sorted(expected, key=key)):
        assert found == wanted
    by_id = {r[0]: r for r in got}
    assert not any(by_id[x][-1] for x in ("200", "201", "202", "902")) and sum(r[-1] for r in got) >= 115


def test_languages_beyond_one_broadcast_are_scored_in_further_groups(spark, monkeypatch):
    monkeypatch.setattr(q, "LEAST_TEXTS", 5)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["ba", "lo", "mi", "tu"]) + rng.choice("xyz") for _ in range(30)), f"l{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    together = q.train_perplexity(df)
    monkeypatch.setattr(q, "grouped", lambda sizes, most: [[x] for x in sizes])
    apart = q.train_perplexity(df)
    assert len(together.groups) == 1 and len(apart.groups) == 6 and apart.languages == together.languages
    score = lambda model: {r.doc_id: (round(r.bits_per_word, 6), r.kept) for r in q.quality_rules(df, model).collect()}
    assert score(together) == score(apart) and len(score(apart)) == 60


def test_groups_stay_under_the_bound():
    assert q.grouped({"a": 5, "b": 3, "c": 2, "d": 9, "e": 1}, 8) == [["a", "b"], ["c"], ["d"], ["e"]]
    assert q.grouped({}, 8) == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert q.quality_rules(df, q.train_perplexity(df)).count() == 0


def test_probabilities_sum_to_one():
    text = pa.array(["the tree stands there and rests, then it stands"] * 2)
    codes, _ = q.ngrams(text)
    found, n = np.unique(codes, return_counts=True)
    context, back = np.unique(found >> 7, return_inverse=True)
    seen = np.stack([np.bincount(back, weights=k) for k in ((n == 1), (n == 2), (n > 2))], axis=1)
    suffix, ways = np.unique(found & (q.TRIGRAMS - 1), return_counts=True)
    model = q.kneser_ney(q.hashed(found), n, [(n == k).sum() for k in (1, 2, 3, 4)], context, np.bincount(back, weights=n), seen, suffix, ways)
    for c in [*found[::5], 12345]:
        followers = (int(c) >> 7 << 7) + np.arange(128)
        assert model.probability(followers.astype(np.uint32)).sum() == pytest.approx(1, abs=1e-5)


class Captured:
    """Takes the function that ``mapInArrow`` is given, to run it here."""

    def mapInArrow(self, function, schema):
        self.function = function
        return self

    def groupBy(self, *keys):
        return self

    def agg(self, *columns):
        return self


def test_counting_holds_little_more_than_the_codes(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(4000)) + chr(rng.randrange(0x3B1, 0x3C0)) for _ in range(1000)]
    languages = [rng.choice("xyz") for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(languages)], ["text", "lang"])
    size = sum(map(len, texts))
    q.symbol_table()
    captured = Captured()
    q.count_ngrams(captured)
    tracemalloc.start()
    try:
        found = list(captured.function(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 25 * size  # the codes are four bytes for each of a text, and sorting copies a language's
    counted = Counter()
    for part in found:
        for row in part.to_pylist():
            counted[row["lang"], row["code"]] += row["n"]
    expected = Counter()
    for language in "xyz":
        for text in (t for t, x in zip(texts, languages) if x == language):
            expected.update((language, int(c)) for c in q.ngrams(pa.array([text]))[0].astype(np.int32))
    assert counted == expected
