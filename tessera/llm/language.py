"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-cased code points with everything but letters as one separator; n-grams of two and three of these, hashed to
``BUCKETS`` features, are counted per language over all training rows.  The log-probability matrix has ``BUCKETS`` rows and a column
for each language, at most ``MOST_LANGUAGES``, which bounds what is broadcast.  Batches are scored by looking up the
features that occur and summing their rows per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import raw, slices, unused

BUCKETS = 1 << 15
MOST_LANGUAGES = 256
SMOOTHING = 0.5
SLICE_BYTES = 1 << 20
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_probability: np.ndarray  # BUCKETS x languages


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x40000):  # no plane beyond the fourth has letters
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams with a letter, the text of each, and the number of letters of each text."""
    data, bounds = raw(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    letters = _folded()[points]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(begins))
    per_text = np.bincount(row[letters > 0], minlength=len(texts))
    found, rows = [], []
    for n in (2, 3):
        size = len(letters) - n + 1
        if size <= 0:
            continue
        key, some = np.full(size, n, np.uint32), np.zeros(size, bool)
        for k in range(n):
            part = letters[k : k + size]
            key = (key ^ part) * np.uint32(0x9E3779B1)
            key ^= key >> np.uint32(15)
            some |= part > 0
        some &= row[:size] == row[n - 1 :]
        found.append(key[some] & np.uint32(BUCKETS - 1))
        rows.append(row[:size][some])
    if not found:
        return np.empty(0, np.uint32), np.empty(0, np.int32), per_text
    return np.concatenate(found), np.concatenate(rows), per_text


def count_features(df: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows of ``df`` (``text, lang``); bucket -1 counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo, hi in slices(batch.column(0), SLICE_BYTES):
                coded = batch.column(1).slice(lo, hi - lo).dictionary_encode()
                languages, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                buckets, rows, _ = features(batch.column(0).slice(lo, hi - lo))
                counted = np.bincount(code[rows] * BUCKETS + buckets, minlength=len(languages) * BUCKETS).reshape(-1, BUCKETS)
                texts = np.bincount(code, minlength=len(languages))
                for i, language in enumerate(languages):
                    total = totals.setdefault(language, np.zeros(BUCKETS + 1, np.int64))
                    total[:BUCKETS] += counted[i]
                    total[BUCKETS] += texts[i]
        for language, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"]
            )

    return df.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train_language_model(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from all rows with a language and a text."""
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    counted = count_features(rows).filter(F.col("n") > 0)
    table = counted.toArrow()  # BUCKETS + 1 rows a language at most
    names = np.array(table["lang"].to_pylist(), dtype=object)
    languages = sorted(set(names))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the model takes {MOST_LANGUAGES} at most")
    counts = np.zeros((BUCKETS, len(languages)))
    texts = np.zeros(len(languages))
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    for i, language in enumerate(languages):
        own = names == language
        counts[bucket[own & (bucket >= 0)], i] = n[own & (bucket >= 0)]
        texts[i] = n[own & (bucket < 0)].sum()
    smoothed = counts + SMOOTHING
    return LanguageModel(languages, np.log(texts / max(1.0, texts.sum())), np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32))


def identify_language(df: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the most probable language and its posterior probability (0 to 1) to every row of ``df``.

    ``und`` with score 0 for a null or empty text, one without a letter, and for all rows if the model has no language.  A text of one letter and nothing else has no n-gram:
    it gets the language with most texts and that language's share.  Ties go to the language first by code point.  Columns of ``df`` named like a result are replaced; all others are kept; repeated rows each get a
    result; an empty table gives no rows.
    """
    kept = df.drop(pred_col, score_col)
    own = text_col if text_col in kept.columns else unused(df, "_text")  # a kept text goes to Python once
    if own != text_col:
        kept = df.withColumn(own, F.col(text_col)).drop(pred_col, score_col)
    hidden = {own} - {text_col}
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in kept.schema.fields if f.name not in hidden] + [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    names = [f.name for f in fields]

    def predict(texts: pa.Array) -> tuple[list[str], np.ndarray]:
        model = shared.value
        buckets, rows, letters = features(texts)
        if not model.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        logs = np.zeros((len(texts), len(model.languages)))
        for i in range(len(model.languages)):
            logs[:, i] = np.bincount(rows, weights=model.log_probability[buckets, i], minlength=len(texts))
        logs += model.log_prior
        logs -= logs.max(axis=1, keepdims=True)
        posterior = np.exp(logs)
        best = posterior.argmax(axis=1)
        score = 1.0 / posterior.sum(axis=1)
        known = letters > 0
        return [model.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())], np.where(known, score, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(own)
            others = [c for c, name in zip(batch.columns, batch.schema.names) if name not in hidden]
            found: list[str] = []
            scores = [np.empty(0)]
            for lo, hi in slices(batch.column(at), SLICE_BYTES):
                languages, score = predict(batch.column(at).slice(lo, hi - lo))
                found += languages
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*others, pa.array(found, pa.string()), pa.array(np.concatenate(scores))], names)

    return kept.mapInArrow(run, T.StructType(fields))


def in_fold(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in a fold; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold
