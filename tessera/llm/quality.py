"""Quality rules: word and line statistics, and perplexity bands of an n-gram model.

The model is a modified Kneser-Ney model of order four over 128 symbols, one for each language: ASCII signs, digits and folded letters are symbols of their own,
all other characters share 57 by their code point, which keeps the letters of one alphabet apart.  Spark counts the n-grams of all texts and all that the
model needs of them.  A language keeps its n-grams in sorted hash arrays; those of order four fall into 2 ** 21 hashes, and those of order three have as many codes, so that
a model has a fixed bound whatever the corpus.  Languages are scored in groups, each of one language or of so many as have ``HASHES`` n-grams together, which bounds what is broadcast.
A language with fewer than ``LEAST_TEXTS`` texts has too few for quartiles of its own: its texts, and those without a language, are held against the model of all texts.

A document's perplexity is that per word, as bits: markup that sticks to words raises it, and signs that stand as words lower it.  Its deviation is the difference from
the language's median, times the root of its number of words, since the spread shrinks by that; the root levels off at that of ``STEADY`` words, as long texts still differ by style.  Bands are the usual fences: a deviation
may lie at most ``FENCE`` interquartile ranges outside the language's quartiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .scratch import stage
from .text import PRIME, SPACE, mixed, raw, slices, span_hashes, unused, windows, words

ORDER = 4
BITS = 7
SYMBOLS_ = 1 << BITS
OWN_SYMBOLS = 71  # control, line feed, and ASCII from space on without capitals
TRIGRAMS = 1 << 3 * BITS
HASH_BITS = 21
HASHES = 1 << HASH_BITS
SPREADER = 165901065  # odd, near 2 ** 28 over the golden ratio
LEAST_TEXTS = 50
OTHER = "\x00other"
SLICE_BYTES = 1 << 20
FENCE = 1.5
STEADY = 1000.0  # words
LEAST_SPREAD = 1.0  # of the quartiles, in bits; copies of one text have none
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """The symbol of each code point."""
    points = np.arange(0x110000)
    table = (OWN_SYMBOLS + points % (SYMBOLS_ - OWN_SYMBOLS)).astype(np.uint8)
    own = [p for p in range(0x20, 0x7F) if not chr(p).isupper()]
    table[:0x20] = table[0x7F] = 0
    table[0x0A] = 1
    table[own] = range(2, OWN_SYMBOLS)
    for point in range(0x1F000):
        if chr(point).isupper() and len(chr(point).lower()) == 1:
            table[point] = table[ord(chr(point).lower())]
    return table


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of order four within each text, in order, and how many each text has."""
    data, bounds = raw(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    symbols = symbol_table()[points].astype(np.uint32)
    if len(symbols) < ORDER:
        return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
    size = len(symbols) - ORDER + 1
    codes = reduce(lambda code, k: code << np.uint32(BITS) | symbols[k : k + size], range(1, ORDER), symbols[:size])
    inside = np.ones(size, bool)
    for back in range(1, ORDER):
        edges = bounds[1:-1] - back
        inside[edges[(edges >= 0) & (edges < size)]] = False
    return codes[inside], np.maximum(np.diff(bounds) - ORDER + 1, 0)


def hashed(codes: np.ndarray) -> np.ndarray:
    """Hashes of n-grams of order four: the upper bits of a product modulo their range."""
    return (codes.astype(np.uint64) * np.uint64(SPREADER) & np.uint64((1 << ORDER * BITS) - 1)) >> np.uint64(ORDER * BITS - HASH_BITS)


def _hashed(code: Column) -> Column:
    return F.shiftright(code.cast("long") * SPREADER % (1 << ORDER * BITS), ORDER * BITS - HASH_BITS)


@dataclass
class HashArrays:
    """Sorted hashes of n-grams and a value of each; 0 for those that are not there."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.values[at], 0.0)

    @classmethod
    def of(cls, hashes: np.ndarray, values: np.ndarray) -> HashArrays:
        order = np.argsort(hashes, kind="stable")
        return cls(hashes[order].astype(np.uint64), values[order].astype(np.float32))


@dataclass
class KneserNey:
    """Counts and discounts of order four, totals and back-off weights of its contexts, and probabilities of the orders below."""

    counts: HashArrays
    discount: np.ndarray
    totals: HashArrays
    weights: HashArrays
    trigram: HashArrays
    pair_weight: np.ndarray
    bigram: np.ndarray

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Of the last symbol of each n-gram of order four after the others."""
        context, suffix = mixed((codes >> np.uint32(BITS)).astype(np.uint64)), codes & np.uint32(TRIGRAMS - 1)
        lower = self.trigram.find(mixed(suffix.astype(np.uint64)))
        lower += self.pair_weight[suffix >> np.uint32(BITS)] * self.bigram[suffix & np.uint32((1 << 2 * BITS) - 1)]
        total = self.totals.find(context)
        count = np.where(total > 0, self.counts.find(hashed(codes)), 0.0)
        kept = count - self.discount[np.minimum(count, 3).astype(int)]
        # n-grams that share a hash share a count: no more than all of a context's can follow it
        return np.minimum(kept / np.maximum(total, 1), 1.0) + np.where(total > 0, self.weights.find(context), 1.0) * lower


def discounts(ones: float, twos: float, threes: float, fours: float) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more, from the counts of counts."""
    n1, n2, n3, n4 = (max(1.0, float(n)) for n in (ones, twos, threes, fours))
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.1), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def _interpolated(counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What counts (contexts x symbols) give by themselves, and the weight each context gives to the lower order."""
    discount = discounts(*((counts == k).sum() for k in (1, 2, 3, 4)))
    taken = discount[np.minimum(counts, 3)]
    total = counts.sum(axis=1, keepdims=True)
    weight = np.where(total > 0, taken.sum(axis=1, keepdims=True) / np.maximum(total, 1), 1.0)
    return (counts - taken) / np.maximum(total, 1), weight[:, 0]


def kneser_ney(hashes: np.ndarray, counts: np.ndarray, of_counts: np.ndarray, contexts: np.ndarray, totals: np.ndarray, seen: np.ndarray, suffixes: np.ndarray, ways: np.ndarray) -> KneserNey:
    """Estimate from the counts of hashes of order four, the counts of counts 1 to 4, each context's total and its numbers of n-grams seen once, twice and
    more, and in how many ways each trigram is preceded."""
    triples = np.zeros(TRIGRAMS, np.int32)
    triples[suffixes] = ways
    cube = triples.reshape(SYMBOLS_, SYMBOLS_, SYMBOLS_)
    pairs = (cube > 0).sum(axis=0)  # distinct symbols before each pair
    singles = (pairs > 0).sum(axis=0)
    unigram, weight = _interpolated(singles[None, :], np.empty(0))
    unigram = unigram + weight[:, None] / SYMBOLS_
    bigram, weight = _interpolated(pairs, unigram)
    bigram = bigram + weight[:, None] * unigram
    own, pair_weight = _interpolated(cube.reshape(-1, SYMBOLS_), bigram)
    discount = discounts(*of_counts)
    context = mixed(contexts.astype(np.uint64))
    return KneserNey(
        HashArrays.of(hashes, counts), discount, HashArrays.of(context, totals), HashArrays.of(context, (seen @ discount[1:]) / np.maximum(totals, 1)),
        HashArrays.of(mixed(suffixes.astype(np.uint64)), own.ravel()[suffixes]), pair_weight.astype(np.float32), bigram.ravel().astype(np.float32),
    )


@dataclass
class PerplexityModel:
    """Models by language, ``OTHER`` for all texts, in groups that are broadcast together."""

    groups: list[dict[str, KneserNey]]

    @property
    def languages(self) -> list[str]:
        return [x for group in self.groups for x in group if x != OTHER]


def _slot(lang: Column, languages: list[str]) -> Column:
    lang = lang.cast("string")
    return F.when(lang.isin(languages), lang).otherwise(F.lit(OTHER)) if languages else F.lit(OTHER)


def counted_ngrams(texts: pa.Array, languages: pa.Array) -> pa.RecordBatch:
    """``lang, code, n`` of some texts, one at least.  Codes are made from ``SLICE_BYTES`` of text at a time and sorted language by language, so that little more than the codes is held."""
    coded = languages.dictionary_encode()
    names, of_text = coded.dictionary, coded.indices.to_numpy()
    held: list[list[np.ndarray]] = [[] for _ in range(len(names))]
    for lo, hi in slices(texts, SLICE_BYTES):
        codes, lengths = ngrams(texts.slice(lo, hi - lo))
        own = np.repeat(of_text[lo:hi], lengths)
        for i in np.unique(of_text[lo:hi]).tolist():
            held[i].append(codes[own == i])
    found = []
    for i, parts in enumerate(held):
        found.append(np.unique(np.concatenate(parts), return_counts=True))
        held[i] = []
    of_row = np.repeat(np.arange(len(names)), [len(codes) for codes, _ in found])
    codes, n = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([names.take(pa.array(of_row)), pa.array(codes.astype(np.int32)), pa.array(n)], ["lang", "code", "n"])


def count_ngrams(df: DataFrame) -> DataFrame:
    """``lang, code, n`` of all texts of ``df`` (``text, lang``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0), 4 * SLICE_BYTES):
                yield counted_ngrams(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo))
            del batch
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def grouped(sizes: dict[str, int], most: int) -> list[list[str]]:
    """Names in groups whose sizes add up to ``most`` at most, or of one name."""
    groups: list[list[str]] = []
    left = 0
    for name, size in sizes.items():
        if not groups or size > left:
            groups.append([])
            left = most
        groups[-1].append(name)
        left -= size
    return groups


def train_perplexity(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> PerplexityModel:
    """Count all texts' n-grams and estimate a model for each language that has ``LEAST_TEXTS`` texts, and one for all texts."""
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    numbers = rows.dropna().groupBy("lang").count()
    languages = sorted(r[0] for r in numbers.filter(F.col("count") >= LEAST_TEXTS).collect())
    own = stage(count_ngrams(rows.select("text", _slot(F.col("lang"), languages).alias("lang"))), "ngrams")
    whole = own.groupBy("code").agg(F.sum("n").alias("n")).select(F.lit(OTHER).alias("lang"), "code", "n")
    counts = own.filter(F.col("lang") != OTHER).unionByName(whole)
    some = lambda k, more=False: F.count(F.when(F.col("n") >= k if more else F.col("n") == k, 1))
    of_counts = counts.groupBy("lang").agg(F.count(F.lit(1)), *[some(k) for k in range(1, 5)]).collect()
    by_language = {r[0]: r[1:] for r in sorted(of_counts)}
    models = []
    for group in grouped({x: min(r[0], HASHES) for x, r in by_language.items()}, HASHES):
        part = counts.filter(F.col("lang").isin(group))
        # a language has HASHES, TRIGRAMS and TRIGRAMS rows at most
        tables = [
            part.groupBy("lang", _hashed(F.col("code")).alias("code")).agg(F.sum("n").alias("n")),
            part.groupBy("lang", F.shiftright("code", BITS).alias("code")).agg(F.sum("n").alias("total"), some(1).alias("one"), some(2).alias("two"), some(3, True).alias("more")),
            part.groupBy("lang", F.col("code").bitwiseAND(TRIGRAMS - 1).alias("code")).agg(F.count(F.lit(1)).alias("ways")),
        ]
        arrays = [{name: np.array(column.to_pylist(), object) if name == "lang" else column.to_numpy() for name, column in zip(t.column_names, t.columns)} for t in (x.toArrow() for x in tables)]
        models.append({})
        for language in group:
            grams, contexts, suffixes = ({name: column[a["lang"] == language] for name, column in a.items()} for a in arrays)
            models[-1][language] = kneser_ney(
                grams["code"], grams["n"], by_language[language][1:], contexts["code"], contexts["total"],
                np.stack([contexts[x] for x in ("one", "two", "more")], axis=1), suffixes["code"], suffixes["ways"],
            )
    return PerplexityModel(models)


def bits(texts: pa.Array, languages: list[str], models: dict[str, KneserNey]) -> np.ndarray:
    """Negative log2-probability of each text under its language's model; NaN where it has no n-gram."""
    codes, lengths = ngrams(texts)
    distinct = sorted(set(languages))
    slot = np.repeat([distinct.index(x) for x in languages], lengths)
    value = np.empty(len(codes))
    for i, language in enumerate(distinct):
        own = np.flatnonzero(slot == i)
        found, back = np.unique(codes[own], return_inverse=True)
        value[own] = np.log2(models[language].probability(found))[back]
    total = np.bincount(np.repeat(np.arange(len(texts)), lengths), weights=value, minlength=len(texts))
    return np.where(lengths > 0, -total, np.nan)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The rules' counts for each text."""
    data, bounds = raw(texts)
    found = words(data, bounds)
    n, counts = len(texts), found.counts()
    inside = ~SPACE[data]
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])

    breaks = np.flatnonzero(data == 0x0A)
    begin = np.union1d(bounds[:-1], breaks + 1)
    begin = begin[begin < len(data)]
    row = np.searchsorted(bounds, begin, "right") - 1
    after = np.searchsorted(breaks, begin)
    end = np.minimum(np.append(breaks, len(data))[after], bounds[row + 1])
    filled = np.concatenate([[0], np.cumsum(inside)])
    worded = filled[end] > filled[begin]
    begin, end, row = begin[worded], end[worded], row[worded]

    def repeated(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by row and hash, and where a value equals the one before it."""
        keys = mixed(hashes ^ (rows.astype(np.uint64) * PRIME))
        order = np.argsort(keys, kind="stable")
        return order, np.concatenate([[False], keys[order[1:]] == keys[order[:-1]]]) if len(keys) else np.empty(0, bool)

    order, same = repeated(span_hashes(data, begin, end, False), row)
    dup_lines = np.bincount(row[order[same]], minlength=n)

    runs, of_word = windows(found.hashes, 5), found.documents()
    whole = np.flatnonzero(of_word[: len(runs)] == of_word[4:]) if len(runs) else np.empty(0, np.int64)
    order, same = repeated(runs[whole], of_word[whole])
    twice = same.copy()
    twice[:-1] |= same[1:]
    at = whole[order[twice]]
    cover = np.zeros(len(of_word) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    repeats = np.bincount(of_word[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {
        "n_words": counts,
        "word_chars": sums(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": sums(IS_SYMBOL[data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
    }


def _steadiness() -> Column:
    """Root of the number of words, levelling off: texts differ by style as much as ``STEADY`` words of one style do by chance."""
    return F.sqrt(F.col("n_words") * STEADY / (F.col("n_words") + STEADY))


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(df: DataFrame, model: PerplexityModel, text_col: str, lang_col: str, slot: str, carried: list[str]) -> DataFrame:
    """The rules' counts, ``base_failed``, ``bits_per_word`` and the language whose model was used (``slot``), after the columns ``carried``."""
    new = {*LONGS, "base_failed", "bits_per_word", "deviation", "kept"}
    carried = [c for c in carried if c not in new]
    own = text_col if text_col in carried else unused(df, "_text")  # a kept text goes to Python once
    kept = df.withColumns({own: F.col(text_col), slot: _slot(F.col(lang_col), model.languages)}).select(*carried, *({own} - {*carried}), slot)
    fields = [f for f in kept.schema.fields if f.name not in {own, slot} - {text_col}]
    fields += [T.StructField(slot, T.StringType()), *[T.StructField(x, T.LongType()) for x in LONGS]]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("bits_per_word", T.DoubleType())]
    names = [f.name for f in fields]

    def run_with(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text, lang = (batch.schema.get_field_index(x) for x in (own, slot))
                others = [i for i in range(batch.num_columns) if i != lang and (i != text or own == text_col)]
                for lo, hi in slices(batch.column(text), SLICE_BYTES):
                    texts, languages = batch.column(text).slice(lo, hi - lo), batch.column(lang).slice(lo, hi - lo)
                    counts = base_counts(texts)
                    n = counts["n_words"]
                    per_word = np.where(n > 0, bits(texts, languages.to_pylist(), shared.value), np.nan) / np.maximum(n, 1)
                    failed = (n < 10) | (100 * counts["n_repeat_words"] > 20 * n)
                    columns = [*[batch.column(i).slice(lo, hi - lo) for i in others], languages, *[pa.array(counts[x].astype(np.int64)) for x in LONGS]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(per_word, from_pandas=True)], names)
                batch = texts = languages = columns = None
                pa.default_memory_pool().release_unused()

        return run

    broadcast = df.sparkSession.sparkContext.broadcast
    parts = [(kept.filter(F.col(slot).isin([*group])) if len(model.groups) > 1 else kept).mapInArrow(run_with(broadcast(group)), T.StructType(fields)) for group in model.groups]
    return reduce(DataFrame.unionByName, parts) if parts else kept.limit(0).mapInArrow(lambda batches: batches, T.StructType(fields))


def perplexity_bands(rows: DataFrame, slot: str) -> DataFrame:
    """``slot, _median, _low, _high``: each language's median of ``bits_per_word`` and the band of deviations from it, from all its rows."""
    known = rows.filter(F.col("bits_per_word").isNotNull()).select(slot, "n_words", "bits_per_word")
    quantile = lambda column, q: F.percentile_approx(column, F.lit(q), F.lit(10000))
    medians = known.groupBy(slot).agg(quantile("bits_per_word", 0.5).alias("_median"))  # a row for each model
    deviation = (F.col("bits_per_word") - F.col("_median")) * _steadiness()
    quartiles = known.join(F.broadcast(medians), slot).groupBy(slot, "_median").agg(quantile(deviation, 0.25).alias("_q1"), quantile(deviation, 0.75).alias("_q3"))
    reach = FENCE * F.greatest(F.col("_q3") - F.col("_q1"), F.lit(LEAST_SPREAD))
    return quartiles.select(slot, "_median", (F.col("_q1") - reach).alias("_low"), (F.col("_q3") + reach).alias("_high"))


def quality_rules(df: DataFrame, model: PerplexityModel, text_col: str = "text", lang_col: str = "lang", carried: list[str] | None = None) -> DataFrame:
    """Add the rules' counts, ``base_failed``, ``bits_per_word``, ``deviation`` and ``kept`` to every row of ``df``, or of its columns ``carried``.

    A null or empty text has no words and fails.  A text without an n-gram has no perplexity (null) and is not rejected for it.  A language without a
    model, and a null one, is held against the model of all texts, and in the band of all such rows.  Columns named like a result are replaced; the rest are kept; repeated
    rows each get a result; an empty table gives no rows.
    """
    slot = unused(df, "_model")
    rows = scored(df, model, text_col, lang_col, slot, df.columns if carried is None else carried)
    rows = stage(rows, "quality")
    band = ["_median", "_low", "_high"]
    own = {name: unused(rows, name) for name in band}
    bands = perplexity_bands(rows, slot).withColumnsRenamed(own).withColumnRenamed(slot, own["_median"] + "_of")
    median, low, high = (F.col(own[name]) for name in band)
    deviation = (F.col("bits_per_word") - median) * _steadiness()
    inside = F.coalesce(deviation.between(low, high), F.lit(True))
    judged = rows.join(F.broadcast(bands), F.col(slot) == F.col(own["_median"] + "_of"), "left")
    return judged.withColumn("deviation", deviation).withColumn("kept", ~F.col("base_failed") & inside).drop(slot, *own.values(), own["_median"] + "_of")
