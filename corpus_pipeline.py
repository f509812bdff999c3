"""Corpus pipeline: language ID, quality rules, near-duplicates, mixing to target weights, packing.

Each stage takes what the one before kept, written as Parquet and read again, and its decisions take effect: documents without a
determined language go and the others carry the predicted language from then on, documents that the quality rules reject go, one document of each group of near-duplicates stays,
and the mix repeats or leaves out documents.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.language import UNDETERMINED, identify_language, train_language_model
from tessera.llm.mixing import mixed_rows
from tessera.llm.near_duplicates import drop_near_duplicates
from tessera.llm.packing import pack_windows
from tessera.llm.quality import quality_rules, train_perplexity
from tessera.llm.scratch import stage as written

#: A language's posterior probability must reach this: no other language, nor all others together, can be more probable.
LEAST_POSTERIOR = 0.5


def _apart(docs: DataFrame) -> DataFrame:
    """The text, and all else in one column, so that an operator's results can't clash with a column of the table."""
    return docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))


def _together(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(c) if c == "text" else F.col("_row")[c].alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with the predicted language as ``lang``.

    A null text or one without a letter goes, and so does one for which no language is more probable than all others together.  If no row has a language
    there is none to predict: texts with letters stay as they are.
    """
    model = train_language_model(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = identify_language(_apart(docs), model).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_POSTERIOR))
    told = F.col("lang_pred").cast(docs.schema["lang"].dataType).alias("lang")
    return found.select(*[told if c == "lang" else F.col(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their language's perplexity band keep."""
    judged = quality_rules(_apart(docs), train_perplexity(docs), lang_col="_row.lang")
    return _together(judged.filter("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix, packed into sequences; each copy of a document is packed by itself."""
    return pack_windows(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokens and perplexities are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = written(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
