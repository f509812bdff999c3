"""Phrase collocations by hierarchical pair naming.

A batch of texts is a sequence of local codes.  Level 1 codes its words.  At each level every distinct gram of a batch is one row (batch, code, name of its
first part, name of its rest, count); the rows of all batches meet by their pair of names, are counted, and the frequent pairs get a global name,
which goes back to the batches that have the gram.  A batch replaces each pair of adjacent frequent grams by one code, and the next level begins.

Only pairs of frequent grams are formed, since a phrase is no more frequent than its parts.  The two names of a gram are its parents, the gram without its last and the one
without its first word.  Following them gives the counts of all first parts and rests, which the cuts need, and what a longer phrase subsumes: if some longer candidate is
frequent enough, so is one that is a single word longer, and that names the shorter one as a parent.

A level's tables are deleted when the next is written.

Names never collide: a word's is the place (batch and code) of one of its rows, a longer gram's a number of its bucket.  Buckets grow in number with the words, so that
one holds about ``BUCKET_WORDS`` pairs at most; a batch is bounded by bytes of text, and a gram has one entry for each batch that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .scratch import release, stage
from .text import mixed, raw

BATCH_BYTES = 4 << 20
BUCKET_WORDS = 1 << 20  # so many words of text for each bucket of pairs
CODE_BITS = 25  # a batch has no more words than bytes
PACKED_ROWS = 1 << 20  # of words at a time
COUNTED = ["a", "b", "f", "name", "batch", "size", "codes", "names"]
ROWS = "batch long, code long, lang string, word string, n long, codes binary"

BREAK, BLANK = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
BLANK[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def split_words(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lower-cased words of texts, the text of each, and whether it stands right after another word of its piece."""
    broken = BREAK[data]
    inside = ~(broken | BLANK[data])
    after = np.zeros(len(data) + 1, bool)
    after[1:] = inside
    after[bounds] = False
    begin = np.flatnonzero(inside & ~after[:-1]).astype(np.int32)
    before = np.zeros(len(data) + 1, bool)
    before[:-1] = inside
    before[bounds] = False
    end = np.flatnonzero(inside & ~before[1:]).astype(np.int32) + 1
    text = (np.searchsorted(bounds, begin, "right") - 1).astype(np.int32)
    piece = np.searchsorted(np.flatnonzero(broken), begin).astype(np.int32)
    follows = np.zeros(len(begin), bool)
    follows[1:] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]])])
    return words, text, follows


def squeezed(codes: np.ndarray) -> bytes:
    return bytes(pa.compress(codes.astype(np.int32), "zstd", asbytes=True)) if len(codes) else b""


def codes_of(blob: bytes, most: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, most, "zstd", asbytes=True), np.int32) if blob else np.empty(0, np.int32)


def _rows(batch: int, codes: np.ndarray, n: np.ndarray, sequence: np.ndarray, langs: pa.Array, words: pa.Array) -> Iterator[pa.RecordBatch]:
    """The distinct words of a batch, and one row without a code that holds its sequence with the length as ``n``."""
    size, names = len(codes), ["batch", "code", "lang", "word", "n", "codes"]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, batch), pa.int64()), pa.array(codes, pa.int64()), langs, words, pa.array(n, pa.int64()), pa.nulls(size, pa.binary())], names
    )
    yield pa.RecordBatch.from_arrays(
        [pa.array([batch], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([len(sequence)], pa.int64()), pa.array([squeezed(sequence)], pa.binary())],
        names,
    )


def _batches(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows (text, lang) gathered up to about ``most`` bytes of text; a longer text is a batch by itself."""
    held, size = [], 0
    for part in parts:
        bounds, at = raw(part.column(0))[1], 0
        while at < part.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most - size, "right")) - 1) if size < most else at + 1
            held.append(part.slice(at, end - at))
            size += int(bounds[end] - bounds[at])
            at = end
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def coded_words(df: DataFrame, lang_col: str, text_col: str, batch_bytes: int) -> DataFrame:
    """Level 1 of all batches: the distinct (language, word) of each with counts, and its sequence of codes, -1 where a piece ends."""
    source = df.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")).filter(F.length("text") > 0)

    def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 12
        for number, table in enumerate(_batches(parts, batch_bytes)):
            if number >= 1 << 12:
                raise ValueError("a partition has too many batches: use more partitions")
            texts, langs = (table.column(i).chunk(0) for i in (0, 1))
            words, text, follows = split_words(*raw(texts))
            if not len(words):
                continue
            known = pc.dictionary_encode(words)
            spoken = pc.dictionary_encode(langs)
            both = pc.dictionary_encode(pa.array(np.asarray(spoken.indices)[text].astype(np.int64) * len(known.dictionary) + np.asarray(known.indices)))
            keys, codes = np.asarray(both.dictionary), np.asarray(both.indices)
            n = np.bincount(codes)
            # a break before every word that follows none
            at = np.cumsum(~follows) + np.arange(len(codes))
            sequence = np.full(len(codes) + int((~follows).sum()), -1, np.int32)
            sequence[at] = codes
            which = lambda dictionary, i: dictionary.take(pa.array(i)).cast(pa.string())
            lang, word = which(spoken.dictionary, keys // len(known.dictionary)), which(known.dictionary, keys % len(known.dictionary))
            del texts, words, text, known, both, table
            yield from _rows(first + number, np.arange(len(keys)), n, sequence, lang, word)
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(code, ROWS)


def named(grams: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows (``batch, code, *keys, n``) of the grams that all batches together have ``least`` times: ``batch, code, *keys, f, name, own``, the last true for one row of each."""
    same = W.partitionBy(*keys)
    place = F.col("batch") * F.lit(1 << CODE_BITS) + F.col("code")
    counted = grams.select("batch", "code", *keys, F.sum("n").over(same).alias("f"), F.min(place).over(same).alias("name"))
    return counted.filter(F.col("f") >= least).withColumn("own", F.col("name") == place)


def planes(values: np.ndarray) -> bytes:
    """64-bit integers by bytes of one weight, compressed: small numbers take little."""
    return bytes(pa.compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True))


def from_planes(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 8 * size, "zstd", asbytes=True), np.uint8).reshape(8, size).T.copy().view("<i8").ravel()


def packed(words: DataFrame) -> DataFrame:
    """Rows of ``named`` words as those of ``counted_pairs``: ``name, lang, word, f`` of each frequent word, and for each batch rows ``batch, size, codes, names`` with compressed columns."""
    grams = T.StructType([T.StructField("name", T.LongType()), *[words.schema[c] for c in ("lang", "word", "f")]])
    fields = [*grams.fields, *[T.StructField(c, t) for c, t in (("batch", T.LongType()), ("size", T.LongType()), ("codes", T.BinaryType()), ("names", T.BinaryType()))]]
    names = [f.name for f in fields]

    def back(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch, code, name = (np.concatenate([np.asarray(part.column(i)) for part in held]) for i in range(3))
        order = np.lexsort((code, batch))
        batch, code, name = batch[order], code[order], name[order]
        begin = np.flatnonzero(np.diff(batch, prepend=-1))
        spans = list(zip(begin.tolist(), [*begin[1:].tolist(), len(batch)]))
        columns = [pa.array(batch[begin]), pa.array([hi - lo for lo, hi in spans], pa.int64())]
        columns += [pa.array([planes(np.diff(code[lo:hi], prepend=0)) for lo, hi in spans], pa.binary()), pa.array([planes(name[lo:hi]) for lo, hi in spans], pa.binary())]
        empty = [pa.nulls(len(spans), t) for t in (pa.int64(), pa.string(), pa.string(), pa.int64())]
        return pa.RecordBatch.from_arrays([*empty, *columns], names)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            own = part.filter(part.column(6))
            rest = [pa.nulls(own.num_rows, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*[own.column(i) for i in range(2, 6)], *rest], names)
            held.append(part.select([0, 1, 2]))
            size += part.num_rows
            if size >= PACKED_ROWS:
                yield back(held)
                held, size = [], 0
        if size:
            yield back(held)

    once = lambda c: F.when(F.col("own"), F.col(c)).alias(c)  # noqa: E731  a word goes to Python once
    return words.select("batch", "code", "name", once("lang"), once("word"), "f", "own").mapInArrow(pack, T.StructType(fields))


def paired(sequences: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """The next level: each batch's distinct pairs of adjacent frequent grams, by name, and its sequence of their codes.

    The pairs of a batch are dealt to buckets by hash and go there as one row each, ``batch, code, bucket, n, blob``: ``n`` pairs whose codes begin with
    ``code``, as compressed columns of both names and counts.  A row without a bucket holds a batch's sequence of ``n`` codes.
    """
    names = found.filter("batch IS NOT NULL").groupBy("batch").agg(F.collect_list(F.struct("size", "codes", "names")).alias("known"))

    def named_codes(known: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of a batch that have names, in order, and the names."""
        rows = known.to_pylist()
        codes = np.concatenate([np.cumsum(from_planes(r["codes"], r["size"])) for r in rows])
        names = np.concatenate([from_planes(r["names"], r["size"]) for r in rows])
        order = np.argsort(codes)
        return codes[order], names[order]

    def pair(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch, size, blob, known in zip(*[part.column(i) for i in range(4)]):
                batch, codes = batch.as_py(), codes_of(blob.as_py(), 4 * size.as_py())
                known, names = named_codes(known.values)
                place = np.full(int(max(codes.max(), known.max())) + 1, -1, np.int32)
                place[known] = np.arange(len(known))
                at = np.where(codes >= 0, place[codes], -1)  # a frequent gram's place among the known ones
                both = (at[:-1] >= 0) & (at[1:] >= 0)
                if not both.any():
                    continue
                keys, pairs, n = np.unique(at[:-1][both].astype(np.int64) * len(known) + at[1:][both], return_inverse=True, return_counts=True)
                a, b = names[keys // len(known)], names[keys % len(known)]
                bucket = (mixed(mixed(a.astype(np.uint64)) + b.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((b, a, bucket))
                code = np.empty(len(keys), np.int32)
                code[order] = np.arange(len(keys), dtype=np.int32)
                next_codes = np.full(len(at) - 1, -1, np.int32)
                next_codes[both] = code[pairs]
                a, b, n, bucket = a[order], b[order], n[order], bucket[order]
                begin = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = []
                for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)]):
                    columns = [planes(np.diff(a[lo:hi], prepend=0)), planes(b[lo:hi]), planes(n[lo:hi])]
                    rows.append((batch, lo, int(bucket[lo]), hi - lo, columns))
                alive = next_codes >= 0
                kept = next_codes[alive | np.concatenate([[False], alive[:-1]])]  # one break is enough after a run
                rows.append((batch, 0, None, len(kept), [squeezed(kept)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary())))], ["batch", "code", "bucket", "n", "blobs"])

    return sequences.join(names, "batch").select("batch", "n", "codes", "known").mapInArrow(pair, "batch long, code long, bucket long, n long, blobs array<binary>")


def counted_pairs(level: DataFrame, least: int, buckets: int) -> DataFrame:
    """A bucket's pairs of all batches counted together: rows ``a, b, f, name`` of the frequent ones, and for each batch that has some one row ``batch, size, codes, names``.

    The latter holds compressed columns: the batch's codes and their names.
    """

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r in rows.itertuples(index=False):
            a, b, n = (from_planes(x, r.n) for x in r.blobs)
            parts.append((np.full(r.n, r.batch), r.code + np.arange(r.n), np.cumsum(a), b, n))
        batch, code, a, b, n = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((code, batch, b, a))
        batch, code, a, b, n = batch[order], code[order], a[order], b[order], n[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        total = np.add.reduceat(n, np.flatnonzero(first))
        gram = np.cumsum(first) - 1
        frequent = total >= least
        name = (np.cumsum(frequent) - 1) * buckets + int(rows["bucket"].iloc[0])
        keep = frequent[gram]
        at = np.flatnonzero(first)[frequent]
        grams = pd.DataFrame({"a": a[at], "b": b[at], "f": total[frequent], "name": name[frequent]})
        batch, code, own = batch[keep], code[keep], name[gram[keep]]
        order = np.lexsort((code, batch))
        batch, code, own = batch[order], code[order], own[order]
        begin = np.flatnonzero(np.diff(batch, prepend=-1))
        back = [
            (batch[lo], hi - lo, planes(np.diff(code[lo:hi], prepend=0)), planes(own[lo:hi])) for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(batch)])
        ]
        parts = pd.DataFrame(back, columns=["batch", "size", "codes", "names"])
        return pd.concat([grams.reindex(columns=COUNTED), parts.reindex(columns=COUNTED)], ignore_index=True).astype({c: "Int64" for c in COUNTED[:6]})

    pairs = level.filter("bucket IS NOT NULL")
    return pairs.groupBy("bucket").applyInPandas(count, "a long, b long, f long, name long, batch long, size long, codes binary, names binary")


def collocations(
    df: DataFrame, most_words: int = 5, least: int = 100, subsumed_percent: int = 100, top: int | None = 2000, lang_col: str = "lang", text_col: str = "text",
    batch_bytes: int = BATCH_BYTES, bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the phrases of 2 to ``most_words`` words that a language has ``least`` times or more.

    Texts are lower-cased (A-Z), split at ``. , ; : ! ?`` and line ends into pieces and those at blanks and tabs into words; phrases do not cross pieces.  ``n`` counts the
    language's words, ``a`` the phrase, ``l`` and ``r`` the two parts of its weakest cut, and the score is ``floor(1000 * a * n / (l * r))`` in exact decimals;
    among equal cuts the first counts.  A phrase is dropped if some longer candidate that contains it has ``subsumed_percent`` per cent of its count or more, dropped itself or not.
    Ranks go by score, count (both descending) and phrase, up to ``top`` for each language (all without it).

    A null language is ``und``; null, empty and blank texts have no words; repeated rows count as often as they stand; an empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    level = stage(coded_words(df, lang_col, text_col, batch_bytes), "phrases-1")
    words = level.filter("code IS NOT NULL")
    totals = stage(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    found = stage(packed(named(words, ["lang", "word"], least)), "phrases-named")
    buckets = -(-(words.agg(F.sum("n")).first()[0] or 1) // bucket_words)
    sequences = level.filter("code IS NULL").select("batch", "n", "codes")
    none = F.array().cast("array<long>")
    grams = stage(found.filter("batch IS NULL").select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("firsts"), none.alias("rests")), "phrases-grams")
    candidates, above = [], []
    for size in range(2, most_words + 1):
        before = level, found
        level = stage(paired(sequences, found, buckets), f"phrases-{size}")
        for table in before:  # what follows is read from the tables written since
            release(table)
        found = stage(counted_pairs(level, least, buckets), "phrases-named")
        sequences = level.filter("bucket IS NULL").select("batch", "n", F.col("blobs")[0].alias("codes"))
        pairs = found.filter("batch IS NULL").select("name", "a", "b", "f")
        first = grams.select(F.col("name").alias("a"), "lang", "phrase", "firsts", F.col("f").alias("f_a"))
        rest = grams.select(F.col("name").alias("b"), "last", "rests", F.col("f").alias("f_b"))
        longer = pairs.join(first, "a").join(rest, "b").select(
            "name", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f",
            F.concat("firsts", F.array("f_a")).alias("firsts"), F.concat("rests", F.array("f_b")).alias("rests"), "a", "b",
        )
        longer = stage(longer, "phrases-grams")
        # names are those of a level
        above.append(longer.select(F.lit(size - 1).alias("size"), F.explode(F.array("a", "b")).alias("name"), F.col("f").alias("f_longer")))
        grams = longer.drop("a", "b")
        candidates.append(grams.withColumn("size", F.lit(size)))
    if not candidates:
        raise ValueError("phrases have two words at least")
    for table in level, found:
        release(table)
    every, parents = candidates[0], above[0]
    for more, up in zip(candidates[1:], above[1:]):
        every, parents = every.unionByName(more), parents.unionByName(up)
    subsumed = parents.groupBy("size", "name").agg(F.max("f_longer").alias("f_longer"))
    apart = every.join(subsumed, ["size", "name"], "left").filter(F.col("f_longer").isNull() | (100 * F.col("f_longer") < subsumed_percent * F.col("f"))).join(totals, "lang")
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    # a cut after k words: firsts[k - 1] is the count of the first k words, the rest has size - k words
    cuts = F.expr(f"""transform(sequence(1, size(firsts)), k -> named_struct(
        'score', CAST({wide(1000)} * f * n DIV ({wide('firsts[k - 1]')} * rests[size(rests) - k]) AS BIGINT), 'k', k, 'l', firsts[k - 1], 'r', rests[size(rests) - k]))""")
    scored = apart.select("lang", "phrase", F.col("f").alias("a"), "n", F.array_min(cuts).alias("_cut"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score")).withColumn("rank", rank)
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(most_words: int = 5, least: int = 100, subsumed_percent: int = 100, top: int = 2000) -> str:
    """DuckDB SQL for ``collocations`` over ``documents``."""
    sizes = ", ".join(f"({k})" for k in range(1, most_words + 1))
    return rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
), g AS (
  SELECT lang, w[i:i + k - 1] AS gram, k, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES {sizes}) AS s(k) WHERE len(w) >= k) GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
  SELECT * FROM g WHERE k >= 2 AND f >= {least}
), x AS (
  SELECT c.*, n.n, unnest(range(1, k)) AS cut FROM c JOIN n USING (lang)
), s AS (
  SELECT x.lang, x.gram, x.k, x.f AS a, x.n, x.cut, l.f AS l, r.f AS r, CAST(1000::HUGEINT * x.f * x.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM x JOIN g l ON l.lang = x.lang AND l.gram = x.gram[1:cut] JOIN g r ON r.lang = x.lang AND r.gram = x.gram[cut + 1:]
), m AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1
), inner_runs AS (
  SELECT DISTINCT lang, gram[i:i + j - 1] AS gram, f FROM (SELECT lang, gram, f, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c))
), sub AS (
  SELECT lang, gram, max(f) AS f FROM inner_runs GROUP BY ALL
), kept AS (
  SELECT m.*, array_to_string(m.gram, ' ') AS phrase FROM m LEFT JOIN sub ON sub.lang = m.lang AND sub.gram = m.gram WHERE sub.f IS NULL OR 100 * sub.f < {subsumed_percent} * m.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}
"""
