"""Language-model scoring with an n-gram trie that is sharded over the cluster.

Texts are read in batches.  A batch sends each shard the distinct n-grams that end in one of the shard's words, with their training
counts, and keeps a map from its tokens to those n-grams.  A shard adds up the counts of all batches and writes the seen n-grams to an
Elias-Fano trie in a memory-mapped file: the last word first, then the words before it, so that an n-gram and all its shorter
suffixes are one path.  Unigrams keep their counts, deeper levels quantised logarithms of smoothed masses.  The batch's n-grams are looked up by
successor search within their context and sent back, and the batch sums its tokens' values by text.  No model is gathered anywhere.

A word that is too frequent for one shard is dealt out by the word before it, under an alias for each part.  A part holds a quarter of a shard's tokens, or a
65,536th of all where that is more, so that the list of aliases, which goes to all tasks with the words' counts, has a fixed bound.

The mass of an n-gram is its count plus ``a`` times the mass of its suffix without the first word, with ``a`` = 1 for bigrams and
``HIGHER`` beyond; that of a single word is ``PRIOR`` times (c + 1) / (N + V + 1).  A context's mass is the sum of those of all its n-grams,
which has the same form, so that log-probabilities are differences of two lookups in one shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .elias_fano import MappedFile, Quantised, TrieLevel
from .scratch import stage
from .text import PRIME, mixed, raw, slices, words

PRIOR = 500.0
HIGHER = 0.01
SLICE_BYTES = 4 << 20
SHARD_TOKENS = 1_000_000
END, START = np.uint64(0x5EED0E17D0000001), np.uint64(0x5EED057A27000003)
LABEL = np.uint64(0xFFFFFFFF)
MOST_PARTS = 1 << 16
MOST_WORDS = 1 << 20


def pack(arrays: list[np.ndarray]) -> bytes:
    """Unsigned arrays, each in the narrowest type that holds it."""
    out = []
    for a in arrays:
        kind = np.uint64 if a.dtype == np.uint64 else np.min_scalar_type(int(a.max()) if len(a) else 0)
        a = a.astype(kind)
        out += [np.array([a.itemsize, len(a)], np.int64).tobytes(), a.tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        width, size = np.frombuffer(data, np.int64, 2, at).tolist()
        out.append(np.frombuffer(data, f"u{width}", size, at + 16))
        at += 16 + width * size
    return out


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def planes(values: np.ndarray) -> list[np.ndarray]:
    """The bytes of values under 2 ** 32 as four arrays, lowest first: high bytes repeat and compress."""
    return list(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def gaps(values: np.ndarray) -> list[np.ndarray]:
    """Values that mostly ascend, as the bytes of their differences (modulo their type's range) in arrays, lowest first."""
    differences = np.diff(values, prepend=values.dtype.type(0))
    return list(differences.view(np.uint8).reshape(-1, values.itemsize).T)


def summed(parts: list[np.ndarray]) -> np.ndarray:
    """The values whose differences have these bytes."""
    whole = np.ascontiguousarray(np.stack(parts, axis=1)).view(f"<u{len(parts)}").ravel()
    return np.cumsum(whole, dtype=whole.dtype)


def coded(values: np.ndarray) -> bytes:
    """Values as 16-bit codes between their least and greatest, after their number, the least and the step."""
    least, most = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
    step = (most - least) / 65535 or 1.0
    return np.array([len(values), least, step]).tobytes() + np.rint((values - least) / step).astype(np.uint16).tobytes()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then the end, and the number of each text's tokens."""
    found = words(*raw(texts), lower=True)
    counts = found.counts() + 1
    out = np.full(int(counts.sum()), END, np.uint64)
    out[np.arange(len(found.hashes)) + found.documents()] = found.hashes
    return out, counts


def preceding(stream: np.ndarray, counts: np.ndarray, back: int) -> np.ndarray:
    """The token ``back`` places before each, ``START`` before a text's first."""
    out = np.full(len(stream), START, np.uint64)
    out[back:] = stream[: len(stream) - back]
    begin = np.cumsum(counts) - counts
    for k in range(back):
        out[(begin + k)[counts > k]] = START
    return out


@dataclass(frozen=True)
class Frequent:
    """Words dealt out in parts: sorted hashes and numbers of parts; and by sorted alias, the word and its training count."""

    words: np.ndarray
    parts: np.ndarray
    aliases: np.ndarray
    originals: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, found: dict[int, int], part: int) -> Frequent:
        words_ = np.array(sorted(found), np.uint64)
        counts = np.array([found[w] for w in words_.tolist()], np.int64)
        parts = -(-counts // part)
        original, count = np.repeat(words_, parts), np.repeat(counts, parts)
        number = np.arange(len(original)) - np.repeat(np.cumsum(parts) - parts, parts)
        aliases = mixed(original + (number.astype(np.uint64) + np.uint64(1)) * PRIME)
        order = np.argsort(aliases)
        return cls(words_, parts, aliases[order], original[order], count[order])

    @staticmethod
    def _find(known: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(known):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
        hit = np.flatnonzero(known[at] == sought)
        return hit, at[hit]

    def deal(self, stream: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The tokens, frequent ones under the alias that the token before them chooses."""
        hit, at = self._find(self.words, stream)
        if not len(hit):
            return stream
        out = stream.copy()
        number = mixed(before[hit]) % self.parts[at].astype(np.uint64)
        out[hit] = mixed(stream[hit] + (number + np.uint64(1)) * PRIME)
        return out

    def restore(self, words_: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words without aliases, and counts with those of whole words."""
        hit, at = self._find(self.aliases, words_)
        words_, counts = words_.copy(), counts.copy()
        words_[hit], counts[hit] = self.originals[at], self.counts[at]
        return words_, counts


NONE = Frequent(*(np.empty(0, np.uint64) for _ in range(5)))


def batch_rows(texts: pa.Array, train: np.ndarray, shards: int, order: int, frequent: Frequent = NONE) -> tuple[dict[int, bytes], bytes]:
    """What a batch sends to each shard, and what it keeps to itself.

    For a shard: words and their training counts, then for each further level the number of children of every node above, the children's
    labels and their training counts.  For itself: the number of each text's tokens, and each token's n-gram, word and training mark.
    """
    stream, counts = tokens(texts)
    learnt = np.repeat(train, counts)
    word, inverse = np.unique(frequent.deal(stream, preceding(stream, counts, 1)), return_inverse=True)
    shard = (word % np.uint64(shards)).astype(np.int64)
    by_shard = np.lexsort((word, shard))
    place = np.empty(len(word), np.int64)
    place[by_shard] = np.arange(len(word))
    word, shard, node = word[by_shard], shard[by_shard], place[inverse]
    of_word = node
    levels = [(None, word, np.bincount(node[learnt], minlength=len(word)))]
    edges = [np.searchsorted(shard, np.arange(shards + 1))]
    for back in range(1, order):
        keys, inverse = np.unique(node.astype(np.uint64) << np.uint64(32) | preceding(stream, counts, back) >> np.uint64(32), return_inverse=True)
        above = (keys >> np.uint64(32)).astype(np.int64)
        children = np.bincount(above, minlength=len(levels[-1][1]))
        levels.append((children, (keys & LABEL).astype(np.uint32), np.bincount(inverse[learnt], minlength=len(keys))))
        edges.append(np.searchsorted(above, edges[-1]))
        node = inverse
    out = {}
    for s in np.unique(shard).tolist():
        parts = []
        for depth, (children, label, count) in enumerate(levels):
            lo, hi = edges[depth][s], edges[depth][s + 1]
            if depth:
                parts.append(children[edges[depth - 1][s] : edges[depth - 1][s + 1]])
            parts += [*gaps(label[lo:hi]), count[lo:hi]]
        out[s] = squeezed(pack(parts))
    # the word of every n-gram follows from how many n-grams each word has
    leaves = np.bincount(of_word_of_leaf(levels), minlength=len(word))
    return out, squeezed(pack([counts, leaves, *planes(node)]))


def of_word_of_leaf(levels: list[tuple]) -> np.ndarray:
    """The word of each n-gram of the deepest level."""
    above = np.arange(len(levels[0][1]))
    for children, _, _ in levels[1:]:
        above = np.repeat(above, children)
    return above


def asked_of(data: bytes, order: int) -> list[np.ndarray]:
    """A batch's arrays for one shard: words and counts, then children, labels and counts of each further level."""
    arrays = unpack(restored(data))
    out = [summed(arrays[:8]), arrays[8]]
    for depth in range(1, order):
        at = 9 + 6 * (depth - 1)
        out += [arrays[at], summed(arrays[at + 1 : at + 5]), arrays[at + 5]]
    return out


def score_shard(rows: list[list[np.ndarray]], total: int, distinct: int, order: int, frequent: Frequent = NONE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each batch of a shard: the value of each n-gram and the training count of each word.

    A value is the log10-mass of the n-gram, less that of the context that its last ``order - 1`` tokens are for the next token.
    """
    sizes = [[len(r[0]) for r in rows]]
    label = np.concatenate([r[0] for r in rows])
    count = np.concatenate([r[1] for r in rows]).astype(np.int64)
    node, distinct_nodes, level_counts = None, [], []
    keys, node = np.unique(label, return_inverse=True)
    distinct_nodes.append((None, keys))
    level_counts.append(np.bincount(node, weights=count, minlength=len(keys)).astype(np.int64))
    of_row = [node]
    for depth in range(1, order):
        children = np.concatenate([r[3 * depth - 1] for r in rows]).astype(np.int64)
        label = np.concatenate([r[3 * depth] for r in rows])
        count = np.concatenate([r[3 * depth + 1] for r in rows]).astype(np.int64)
        sizes.append([len(r[3 * depth]) for r in rows])
        keys, node = np.unique(np.repeat(node, children).astype(np.uint64) << np.uint64(32) | label, return_inverse=True)
        distinct_nodes.append(((keys >> np.uint64(32)).astype(np.int64), (keys & LABEL).astype(np.uint32)))
        level_counts.append(np.bincount(node, weights=count, minlength=len(keys)).astype(np.int64))
        of_row.append(node)

    with MappedFile() as file:
        word = distinct_nodes[0][1]
        original, level_counts[0] = frequent.restore(word, level_counts[0])
        seen = level_counts[0] > 0
        trie = TrieLevel(np.zeros(int(seen.sum()), np.int64), word[seen], 1, 64, file)
        counts = file.keep(level_counts[0][seen])
        at = trie.find(np.zeros(len(word), np.int64), word)
        known = np.zeros(len(word), np.int64)
        known[at >= 0] = counts[at[at >= 0]]
        mass = PRIOR * (known + 1) / (total + distinct + 1)
        context = known + PRIOR
        ends = original == END
        stored, slots = np.flatnonzero(seen), int(seen.sum())
        index = np.full(len(word), -1, np.int64)
        index[stored] = np.arange(slots)
        for depth in range(1, order):
            parent, label = distinct_nodes[depth]
            weight = 1.0 if depth == 1 else HIGHER
            seen = level_counts[depth] > 0
            trie = TrieLevel(index[parent[seen]], label[seen], slots, 32, file)
            raised = level_counts[depth][seen] + weight * mass[parent[seen]]
            masses = Quantised.of(np.log10(raised), file)
            found = trie.find(at[parent], label)
            hit = found >= 0
            deeper = weight * mass[parent]
            deeper[hit] = 10 ** masses.at(found[hit])
            if depth < order - 1:
                wide = level_counts[depth][seen] + HIGHER * context[parent[seen]]
                contexts = Quantised.of(np.log10(wide), file)
                context_next = HIGHER * context[parent]
                context_next[hit] = 10 ** contexts.at(found[hit])
                context = context_next
            else:
                context = context[parent]
            ends = ends[parent]
            mass, at = deeper, found
            slots = int(seen.sum())
            index = np.full(len(label), -1, np.int64)
            index[seen] = np.arange(slots)
        value = np.log10(mass) - np.where(ends, 0.0, np.log10(context))
    out, first, last = [], 0, 0
    for words_of_row, grams_of_row in zip(sizes[0], sizes[-1]):
        out.append((value[of_row[-1][last : last + grams_of_row]], known[of_row[0][first : first + words_of_row]]))
        first, last = first + words_of_row, last + grams_of_row
    return out


def sum_texts(kept: bytes, answers: list[bytes]) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, sum of log10(count + 1) and sum of values of each text of a batch; answers in order of shards."""
    counts, leaves, *parts = (a.astype(np.int64) for a in unpack(restored(kept)))
    gram = sum(part << 8 * i for i, part in enumerate(parts))
    values, known = [], []
    for answer in answers:
        size, least, step = np.frombuffer(answer, np.float64, 3).tolist()
        end = 24 + 2 * int(size)
        values.append(np.frombuffer(answer[24:end], np.uint16) * step + least)
        known.append(unpack(answer[end:])[0].astype(np.int64))
    value = np.concatenate([np.empty(0), *values])[gram]
    known = np.repeat(np.concatenate([np.empty(0, np.int64), *known]), leaves)[gram]
    text = np.repeat(np.arange(len(counts)), counts)
    sums = lambda x: np.bincount(text, weights=x, minlength=len(counts))
    return counts, sums(known > 0).astype(np.int64), sums(np.log10(known + 1.0)), sums(value)


def batch_key(texts: pa.Array, train: np.ndarray, ids: pa.Array) -> int:
    """A key of a batch by its content; batches of the same content are scored together."""
    data, bounds = raw(texts)
    digest = md5(bounds.tobytes() + train.tobytes() + repr(ids.to_pylist()).encode("utf-8", "surrogatepass"))
    digest.update(data.tobytes())
    return int.from_bytes(digest.digest()[:8], "little", signed=True)


def vocabulary(df: DataFrame) -> DataFrame:
    """``word, n``: hashes and counts of the training tokens of ``df`` (``_text, _train``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(0), SLICE_BYTES):
                found, times = np.unique(tokens(batch.column(0).slice(lo, hi - lo))[0], return_counts=True)
                word, inverse = np.unique(np.concatenate([word, found]), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate([n, times]), minlength=len(word)).astype(np.int64)
                if len(word) > MOST_WORDS:  # of a task at once
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])
                    word, n = word[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    return df.filter("_train").select("_text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score_texts(df: DataFrame, train: Column, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all rows of ``df`` by a model learnt from those for which ``train`` holds.

    Returns ``<id_col>, n_tokens, n_known, train_tokens, base_score, score``.  Null and empty texts have one token, the end.  Repeated rows count and are
    scored one by one.  Without training rows every word is unknown.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    ``df`` is read three times, so that what a batch keeps is shuffled once.  A batch's key is its content, and its answers must be as many as the shards it asked, so that a task that runs again over rows in
    another order fails and is never joined with answers to other rows.
    """
    source = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"), F.col(id_col).alias("_id"))
    known_words = stage(vocabulary(source), "lm-words")
    found = known_words.agg(F.sum("n"), F.count("n"), F.max(F.when(F.col("word") == int(END.astype(np.int64)), F.col("n")))).first()
    total, distinct, texts = (x or 0 for x in found)
    part = max(SHARD_TOKENS // 4, total // MOST_PARTS)
    frequent = Frequent.of({r[0] & (1 << 64) - 1: r[1] for r in known_words.filter(F.col("n") > part).collect()}, part)  # MOST_PARTS words at most
    everywhere = df.sparkSession.sparkContext.broadcast(frequent)
    shards = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_TOKENS))
    id_field = source.schema["_id"]
    asked_row = "batch long, shard int, grams binary"
    row = T.StructType([
        T.StructField("batch", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("grams", T.BinaryType()),
        T.StructField("asked", T.IntegerType()), T.StructField("kept", T.BinaryType()), T.StructField("ids", T.ArrayType(id_field.dataType)),
    ])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Each batch's key, ids, grams by shard and what it keeps."""
        for batch in batches:
            for lo, hi in slices(batch.column(0), SLICE_BYTES):
                text, learnt, ids = (batch.column(i).slice(lo, hi - lo) for i in range(3))
                learnt = learnt.to_numpy(zero_copy_only=False)
                yield batch_key(text, learnt, ids), ids, *batch_rows(text, learnt, shards, order, everywhere.value)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, sent, _ in split(batches):
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(sent), pa.int64()), pa.array(list(sent), pa.int32()), pa.array(list(sent.values()), pa.binary())], ["batch", "shard", "grams"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, sent, kept in split(batches):
            holder = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([ids]))
            columns = [pa.array([key], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([len(sent)], pa.int32()), pa.array([kept], pa.binary()), holder]
            yield pa.RecordBatch.from_arrays(columns, row.names)

    def score(group: pa.Table) -> pa.Table:
        answers = []
        for value, known in score_shard([asked_of(x, order) for x in group["grams"].to_pylist()], total, distinct, order, everywhere.value):
            answers.append(coded(value) + pack([known]))
        return group.set_column(2, "grams", pa.array(answers, pa.binary()))

    start = texts + PRIOR
    for _ in range(2, order):
        start = texts + HIGHER * start
    out = T.StructType([
        T.StructField(id_col, id_field.dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def gather(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        kept = group.filter(group["kept"].is_valid())
        answers = group.filter(group["grams"].is_valid()).sort_by("shard")["grams"].to_pylist()
        copies = len(kept)  # batches of the same content have the same answers
        if not copies or len(answers) != copies * kept["asked"][0].as_py():
            raise RuntimeError("a task ran again over other rows: write the input to storage first")
        n, known, base, value = sum_texts(kept["kept"][0].as_py(), answers[::copies])
        ids = kept["ids"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        times = lambda a: pa.array(np.tile(a, copies))
        return pa.Table.from_arrays(
            [ids.flatten(), times(n), times(known), times(np.full(len(n), total)), times(base - n * np.log10(total + distinct + 1)), times(value - np.log10(start))],
            out.names,
        )

    # one shard a partition, whatever its number hashes to; and about one batch
    answered = source.mapInArrow(send, asked_row).repartitionById(shards, "shard").groupBy("shard").applyInArrow(score, asked_row)
    both = answered.unionByName(source.mapInArrow(keep, row), allowMissingColumns=True)
    return both.repartition(2 * shards, "batch").groupBy("batch").applyInArrow(gather, out)
