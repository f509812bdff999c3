"""License scan: diagonal voting of word k-grams against license texts.

The rolling k-gram hashes of every text are joined to the positions of the templates' k-grams.  A match at word p with template position t votes
for the diagonal p - t.  Votes are added up by diagonal, diagonals that lie close together are merged, so that inserted or dropped words do not
break a match, and a merged span counts if it covers enough of the template's positions and is not much longer than it.  Each match's
words are compared with the template's before it may vote.  A phrase is a template that counts only in full and on one diagonal, which is where its words
stand consecutively.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

K = 3
COVERED = 0.7
GAP = 4  # words that may be inserted or dropped between neighbouring diagonals
LONGEST = 1.5  # of a span, over the template's length
MARK = -1  # the template number of the one row that stands for the text itself


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


PHRASES = [
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
]

# Opening sentences and notices of public licenses, as lower-case words.
NOTICES = [
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    Template("lgpl-3", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Runs, with A-Z lower-cased, of characters other than ASCII signs, in order; a null text has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1)
    lead = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    trail = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, lead + 1, F.greatest(F.size(parts) - lead - trail, F.lit(0)))


def _grams(words: Column) -> Column:
    """Hashes of all runs of ``K`` words, after the mark of the text itself."""
    hashed = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(K)])
    starts = F.when(F.size(words) >= K, F.sequence(F.lit(0), F.size(words) - K)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(0).cast("long")), F.transform(starts, hashed))


def _positions(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """``gram, template, at, expected``: where each k-gram stands in the templates, and the mark."""
    rows = [(number, at, t.words[at : at + K]) for number, t in enumerate(templates) for at in range(len(t.words) - K + 1)]
    table = spark.createDataFrame(rows, "template int, at int, expected array<string>").withColumn(
        "gram", F.xxhash64(*[F.get("expected", F.lit(k)) for k in range(K)])
    )
    mark = spark.createDataFrame([(MARK, 0, None, 0)], "template int, at int, expected array<string>, gram long")
    return table.unionByName(mark)


def scan_licenses(df: DataFrame, templates: list[Template] = PHRASES + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses that each row's text names: ``<id_col>, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of phrases, of which ``first_word`` and ``last_word`` are the smallest and largest start (null if there are none).  ``labels`` has
    those of phrases and of notices found; both label columns are empty strings if there are none.  ``score`` is the largest covered share
    of any template found, 0 without.  Null and empty texts have no words.  Repeated rows each get a result; a null id is kept; an empty table
    gives no rows.  Other columns are ignored, whatever their names.  Templates have ``K`` words at least.
    """
    if any(len(t.words) < K for t in templates):
        raise ValueError(f"templates need {K} words")
    spark = df.sparkSession
    positions = F.broadcast(_positions(spark, templates))
    split = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), words_of(F.col(text_col)).alias("_words"))
    grams = split.select("_id", "_hash", "_words", F.posexplode(_grams(F.col("_words"))).alias("_slot", "gram"))
    at = F.col("_slot") - 1
    mark = F.col("template") == MARK
    matched = grams.join(positions, "gram").filter(
        F.when(F.col("_slot") == 0, mark).otherwise(~mark & (F.slice("_words", F.col("_slot"), K) == F.col("expected")))
    ).select("_id", "_hash", F.size("_words").alias("_n"), "template", "at", at.alias("_p"))
    # one exchange, by text: all that follows groups within it
    dealt = matched.repartition(F.col("_id"), F.col("_hash"))
    text = ["_id", "_hash", "_n"]
    diagonals = dealt.groupBy(*text, "template", (F.col("_p") - F.col("at")).alias("_d")).agg(
        F.count(F.lit(1)).alias("_votes"), F.collect_set("at").alias("_at"), F.min("_p").alias("_from"), F.max("_p").alias("_to")
    )
    ordered = W.partitionBy(*text, "template").orderBy("_d")
    fresh = F.when(F.col("_d") - F.lag("_d").over(ordered) <= GAP, 0).otherwise(1)
    known = lambda value, kind: F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(templates) for x in (i, value(t))]), F.col("template")).cast(kind)
    marked = diagonals.withColumn("_fresh", fresh).withColumn("_group", F.sum("_fresh").over(ordered))
    merged = marked.groupBy(*text, "template", "_group").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_at")))).alias("_covered"),
        F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max("_votes").alias("_votes"),
        F.collect_list(F.when(F.size("_at") == F.when(~mark, known(lambda t: len(t.words) - K + 1, "int")), F.col("_d"))).alias("_whole"),
    )
    size = known(lambda t: len(t.words), "int")
    covered = F.col("_covered") / (size - K + 1)
    phrase = known(lambda t: t.phrase, "boolean")
    found = F.when(mark, F.lit(False)).when(phrase, F.size("_whole") > 0).otherwise((covered >= COVERED) & (F.col("_to") - F.col("_from") + K <= size * LONGEST))
    judged = merged.withColumn("_found", found).withColumn("_phrase", F.col("_found") & phrase)
    label = known(lambda t: t.label, "string")
    joined = lambda flag: F.array_join(F.sort_array(F.collect_set(F.when(F.col(flag), label))), ",")
    starts = F.flatten(F.collect_list(F.when(F.col("_phrase"), F.col("_whole"))))
    result = judged.groupBy(*text).agg(
        F.max(F.when(mark, F.col("_votes"))).alias("_copies"), starts.alias("_starts"), joined("_phrase").alias("base_labels"), joined("_found").alias("labels"),
        F.coalesce(F.max(F.when(F.col("_found"), F.when(F.col("_phrase"), F.lit(1.0)).otherwise(covered))), F.lit(0.0)).alias("score"),
    )
    return result.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(
        F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_words"), F.size("_starts").cast("long").alias("n_base"),
        F.array_min("_starts").cast("long").alias("first_word"), F.array_max("_starts").cast("long").alias("last_word"), "base_labels", "labels", "score",
    )


def oracle_sql(templates: list[Template] = PHRASES + NOTICES) -> str:
    """DuckDB SQL for ``scan_licenses`` over ``documents``."""
    values = ", ".join(f"({i}, '{t.label}', {str(t.phrase).lower()}, string_split('{' '.join(t.words)}', ' '))" for i, t in enumerate(templates))
    return rf"""
WITH t AS (SELECT * FROM (VALUES {values}) AS v(template, label, phrase, w)
), g AS (
  SELECT template, i - 1 AS tp, w[i:i + {K - 1}] AS gram FROM (SELECT *, unnest(range(1, len(w) - {K - 2})) AS i FROM t)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT r, i - 1 AS p, w[i:i + {K - 1}] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - {K - 2})) AS i FROM d WHERE len(w) >= {K})
), x AS (
  SELECT r, template, p - tp AS d, count(*) AS votes, list(tp) AS ats, min(p) AS f, max(p) AS l FROM s JOIN g USING (gram) GROUP BY ALL
), y AS (
  SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY d) AS grp FROM (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, template ORDER BY d) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM x)
), m AS (
  SELECT r, template, grp, len(list_distinct(flatten(list(ats)))) AS covered, min(f) AS f, max(l) AS l, list(y.d) FILTER (len(ats) = len(w) - {K - 1}) AS whole
  FROM y JOIN t USING (template) GROUP BY r, template, grp
), j AS (
  SELECT r, label, phrase, whole, covered / (len(w) - {K - 1})::DOUBLE AS share,
         CASE WHEN phrase THEN len(coalesce(whole, [])) > 0 ELSE covered / (len(w) - {K - 1})::DOUBLE >= {COVERED} AND l - f + {K} <= len(w) * {LONGEST}::DOUBLE END AS found FROM m JOIN t USING (template)
), a AS (
  SELECT r, flatten(list(whole) FILTER (found AND phrase)) AS starts, list_sort(list(DISTINCT label) FILTER (found AND phrase)) AS b, list_sort(list(DISTINCT label) FILTER (found)) AS n,
         max(CASE WHEN found THEN CASE WHEN phrase THEN 1.0::DOUBLE ELSE share END END) AS score FROM j GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(starts), 0) AS BIGINT) AS n_base, CAST(list_min(starts) AS BIGINT) AS first_word, CAST(list_max(starts) AS BIGINT) AS last_word,
       coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(n, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)
"""
