"""Benchmark decontamination: a distributed positional inverted index of the training texts, probed from the rarest test terms.

1. Benchmark items are cut into windows of consecutive words; equal windows of several items are searched once.
2. The words of all texts that occur in windows are counted.  Each window names its ``TERMS`` rarest words: a window with a word that
   no text has can't occur.
3. Postings ``term, document, position`` of those words are written once: the index.  Postings of words that are some window's rarest carry the words
   around them.  The postings of a window's rarest word, moved back by the word's place in the window, are the places where the window may begin; the list
   is intersected with the moved postings of the next rarest words.
4. What is left is compared with the document's own words around the posting: exact phrases, and, on request, proximity matches (all words of a
   window within a slightly longer stretch, in any order).  No text is sent through the cluster for that.

No list is held by one task: postings are rows, dealt by term and place; only the words and matches of one document stand in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import stage

TERMS = 2
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """The text with A-Z lower-cased and all else as it is; a null is empty."""
    known = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(known) == F.char_length(known), F.lower(known)).otherwise(F.translate(known, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and characters beyond ASCII, in order; a null text has none."""
    return F.filter(F.split(folded(text), SIGNS, -1), lambda w: w != "")


def item_windows(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """``_item, _phrase, _len``: every run of ``size`` words of an item, or all of its words if it has fewer, once for each item."""
    split = benchmark.select(F.col(item_col).alias("_item"), words_of(F.col(text_col)).alias("_words")).filter(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - size + 1, F.lit(1)))
    runs = split.select("_item", F.explode(F.transform(starts, lambda i: F.slice("_words", i, size))).alias("_run"))
    return runs.select("_item", F.array_join("_run", " ").alias("_phrase"), F.size("_run").alias("_len")).distinct()


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _hash, _text``: a row is known by its id and the hash of its text."""
    return df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & (a["_hash"] == b["_hash"])


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n``: occurrences in all texts of those of ``terms`` (``term``, distinct) that occur at all."""
    return texts.select(F.explode(F.split(folded(F.col("_text")), SIGNS, -1)).alias("term")).join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def search_plan(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``_window, _phrase, _len, terms``: for each window that can occur, its rarest distinct words, each with the place of its first occurrence."""
    placed = windows.select("_window", "_phrase", "_len", F.posexplode(F.split("_phrase", " ")).alias("at", "term"))
    rated = placed.groupBy("_window", "_phrase", "_len", "term").agg(F.min("at").alias("at")).join(counts, "term", "left")
    found = rated.groupBy("_window", "_phrase", "_len").agg(
        F.count_if(F.col("n").isNull()).alias("_lacking"), F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("terms")
    )
    return found.filter("_lacking = 0").select("_window", "_phrase", "_len", F.slice("terms", 1, TERMS).alias("terms"))


def postings(texts: DataFrame, terms: DataFrame, reach: int = 0) -> DataFrame:
    """The positional index: ``term, _id, _hash, at`` for every occurrence of one of ``terms`` (``term``, distinct).

    Each text has besides a row with an empty term and the number of its words as ``at``.  With a ``reach``, ``terms`` has a flag ``rarest`` too, and
    postings of terms with it have as ``near`` the words of the text, apart by spaces, from ``reach - 1`` places before them on, ``2 * reach - 1`` at most;
    others have none.
    """
    split = texts.select("_id", "_hash", words_of(F.col("_text")).alias("_words"))
    marked = F.posexplode(F.concat(F.array(F.lit("")), "_words")).alias("_slot", "term")
    sizes = terms.sparkSession.range(1).select(F.lit("").alias("term"), *[F.lit(False).alias("rarest")] * bool(reach))
    # the text's words must not be sent along with each of them: terms are broadcast, words of the benchmark, whose number no text adds to
    placed = split.select("_id", "_hash", "_words", F.size("_words").alias("_n"), marked).join(F.broadcast(terms.unionByName(sizes)), "term")
    near = F.when(F.col("rarest"), F.array_join(F.slice("_words", F.greatest(F.col("_slot") - reach + 1, F.lit(1)), 2 * reach - 1), " ")).alias("near")
    return placed.select("term", "_id", "_hash", F.when(F.col("_slot") == 0, F.col("_n")).otherwise(F.col("_slot") - 1).alias("at"), *[near] * bool(reach))


def phrase_starts(plan: DataFrame, index: DataFrame) -> DataFrame:
    """``_window, _id, _hash, _place, _start``: where the offset-adjusted lists of a window's rarest words meet, and the place of its rarest word there.

    Lists meet by a hash of term, row and place, so once in a long while a place more is left to be compared with the text.
    """
    rarest = plan.select("_window", "terms", F.col("terms")[0]["term"].alias("term"), F.col("terms")[0]["at"].alias("_at"))
    lists = index.filter(F.col("near").isNotNull())
    found = rarest.join(lists, "term").select("_window", "terms", "_id", "_hash", F.col("at").alias("_place"), (F.col("at") - F.col("_at")).alias("_start")).filter("_start >= 0")
    spots = index.select(F.xxhash64("term", "_id", "_hash", "at").alias("_spot"))
    for k in range(1, TERMS):
        # a window of fewer words has no such list: its row asks for the list that has found it already
        term = F.coalesce(F.get("terms", F.lit(k)), F.col("terms")[0])
        found = found.withColumn("_spot", F.xxhash64(term["term"], "_id", "_hash", F.col("_start") + term["at"])).join(spots, "_spot", "left_semi")
    return found.select("_window", "_id", "_hash", "_place", "_start").distinct()


def near_places(plan: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """``_window, _id, _hash, _place``: occurrences of a window's rarest word with the next rarest one in reach of ``_len + slop`` words.

    Places are dealt by stretches of that length, and a place looks into its own and the two stretches beside it.
    """
    window = ["_window", "_len"]
    reach = F.col("_len") + slop
    own = plan.select(*window, "terms", F.col("terms")[0]["term"].alias("term")).join(index, "term").select(
        *window, "_id", "_hash", F.col("at").alias("_place"), F.coalesce(F.get("terms", F.lit(1)), F.col("terms")[0])["term"].alias("_next"),
        F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.floor(F.col("at") / reach) + s)).alias("_stretch"),
    )
    lengths = plan.select(F.explode(F.slice("terms.term", 1, 2)).alias("term"), "_len").distinct()
    other = lengths.join(index, "term").select(
        F.col("term").alias("_next"), F.col("_len").alias("_len_b"), F.col("_id").alias("_id_b"), F.col("_hash").alias("_hash_b"), F.col("at").alias("_at_b"),
        F.floor(F.col("at") / reach).alias("_stretch_b"),
    )
    met = (
        (own["_next"] == other["_next"]) & (own["_len"] == other["_len_b"]) & own["_id"].eqNullSafe(other["_id_b"]) & (own["_hash"] == other["_hash_b"])
        & (own["_stretch"] == other["_stretch_b"]) & (F.abs(own["_place"] - other["_at_b"]) < own["_len"] + slop)
    )
    return own.join(other, met, "left_semi").select("_window", "_id", "_hash", "_place").distinct()


def _index_of(texts: DataFrame, items: DataFrame, reach: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plan of all windows, the index for it, and ``_id, _hash, n_words`` of every text."""
    windows = stage(items.select("_phrase", "_len").distinct().withColumn("_window", F.monotonically_increasing_id()), "leak-windows")
    terms = windows.select(F.explode(F.split("_phrase", " ")).alias("term")).distinct()
    plan = stage(search_plan(windows, term_counts(texts, stage(terms, "leak-terms"))), "leak-plan")
    wanted = plan.select(F.posexplode("terms.term").alias("_rank", "term")).groupBy("term").agg((F.min("_rank") == 0).alias("rarest"))
    index = stage(postings(texts, stage(wanted, "leak-terms"), reach), "leak-postings")
    return plan, index.filter("term <> ''"), index.filter("term = ''").select("_id", "_hash", F.col("at").cast("long").alias("n_words"))


def verified(plan: DataFrame, index: DataFrame, reach: int, places: DataFrame, at: str, holds: Callable[[Column, Column], Column]) -> DataFrame:
    """``_id, _hash, found``: of the texts with places for whose window ``holds(words, place)`` is true, those places (``at, len, window``), each once.

    ``holds`` sees the words that the index has around the place, and the place (``at, _len, _phrase``) counted from the first of them.
    """
    around = index.filter(F.col("near").isNotNull()).select("_id", "_hash", F.col("at").alias("_place"), "near")
    asked = places.join(around, _same(places, around) & (places["_place"] == around["_place"])).select(places["*"], "near")
    first = F.greatest(F.col("_place") - (reach - 1), F.lit(0))
    place = F.struct((F.col(at) - first).alias("at"), "_len", "_phrase")
    found = asked.join(plan.select("_window", "_len", "_phrase"), "_window").filter(holds(F.split("near", " "), place))
    return found.groupBy("_id", "_hash").agg(F.collect_set(F.struct(F.col(at).alias("at"), F.col("_len").alias("len"), F.col("_window").alias("window"))).alias("found"))


def decontaminate(
    df: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Benchmark passages in every row of ``df``: ``<id_col>, n_words, n_hit, n_items, items_sha256, contaminated``.

    A window is a run of ``window`` words of an item, or all words of an item that has fewer; an item without words has none.  ``n_hit`` counts the words
    of a text that lie in an occurrence of any window, ``n_items`` the distinct items with one, and ``items_sha256`` is that of their ids, sorted as strings and
    joined by commas (of the empty string without any).  Null and empty texts have no words.  Repeated rows each get a result, null ids are kept; items without an
    id give hits and are no item of the list.  Empty tables give no rows, or rows without hits.  Other columns are ignored, whatever their names.
    """
    texts = _texts(df, id_col, text_col)
    items = stage(item_windows(benchmark, window, item_col, item_text_col), "leak-items")
    plan, index, sizes = _index_of(texts, items, window)
    starts = stage(phrase_starts(plan, index), "leak-starts")
    exact = lambda words, p: F.array_join(F.slice(words, p["at"] + 1, p["_len"]), " ") == p["_phrase"]
    found = stage(verified(plan, index, window, starts, "_start", exact), "leak-found")
    end = lambda p: p["at"] + p["len"]
    covered = F.aggregate(
        F.array_sort("found"), F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["hit"] + F.greatest(F.lit(0), end(p) - F.greatest(p["at"], a["end"]))).alias("hit"), F.greatest(a["end"], end(p)).alias("end")),
    )
    of_windows = plan.select("_window", "_phrase").join(items.filter(F.col("_item").isNotNull()), "_phrase").select("_window", F.col("_item").cast("string").alias("_item"))
    hits = found.select("_id", "_hash", covered["hit"].cast("long").alias("_hit"), F.explode(F.array_distinct(F.col("found.window"))).alias("_window"))
    listed = hits.join(of_windows, "_window", "left").groupBy("_id", "_hash", "_hit").agg(F.sort_array(F.collect_set("_item")).alias("_items"))
    listed = listed.select(
        F.col("_id").alias("_id_b"), F.col("_hash").alias("_hash_b"), "_hit", F.size("_items").cast("long").alias("_n"), F.sha2(F.array_join("_items", ","), 256).alias("_digest")
    )
    met = sizes["_id"].eqNullSafe(listed["_id_b"]) & (sizes["_hash"] == listed["_hash_b"])
    none = F.lit(0).cast("long")
    return sizes.join(listed, met, "left").select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("_hit", none).alias("n_hit"), F.coalesce("_n", none).alias("n_items"),
        F.coalesce("_digest", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("_hit").isNotNull().alias("contaminated"),
    )


def proximity_matches(
    df: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``<id_col>, text_hash, <item_col>, place`` of each item window whose words all stand within a stretch of its length and ``slop`` words more, in any order.

    ``place`` is that of the window's rarest word in the text.  Each distinct (id, text) is reported once; null ids of rows and items are kept.
    """
    texts = _texts(df, id_col, text_col)
    items = stage(item_windows(benchmark, window, item_col, item_text_col), "leak-items")
    plan, index, _ = _index_of(texts, items, window + slop)
    places = stage(near_places(plan, index, slop), "leak-places")

    def near(words: Column, p: Column) -> Column:
        reach, wanted = p["_len"] + slop, F.array_distinct(F.split(p["_phrase"], " "))
        starts = F.sequence(F.greatest(p["at"] - reach + 1, F.lit(0)), p["at"])
        return F.exists(starts, lambda s: F.size(F.array_except(wanted, F.slice(words, s + 1, reach))) == 0)

    found = stage(verified(plan, index, window + slop, places, "_place", near), "leak-found")
    found = found.select("_id", "_hash", F.explode("found").alias("_p")).select("_id", "_hash", F.col("_p.window").alias("_window"), F.col("_p.at").alias("place"))
    named = plan.select("_window", "_phrase").join(items, "_phrase").select("_window", "_item")
    return found.join(named, "_window").select(F.col("_id").alias(id_col), F.col("_hash").alias("text_hash"), F.col("_item").alias(item_col), "place").distinct()


def oracle_sql(window: int = 10) -> str:
    """DuckDB SQL for ``decontaminate`` over ``documents`` and ``benchmark``."""
    words = lambda c: rf"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH b AS (SELECT item_id, {words("text")} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, w[i:i + {window - 1}] AS run FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window - 2}, 2))) AS i FROM b WHERE len(w) > 0)
), d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents
), lens AS (SELECT DISTINCT len(run) AS n FROM win
), spot AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n
), hit AS (
  SELECT s.r, s.i, s.n, win.item_id FROM (SELECT r, i, n, w[i:i + n - 1] AS run FROM spot) s JOIN win ON win.run = s.run
), pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
