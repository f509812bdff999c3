"""Packing token sequences into windows by minimum bin slack.

Each document is cut into full windows and one rest.  Rests are known by their lengths alone, so a histogram of at
most ``window - 1`` counts describes a corpus of any size.  For a window, the longest rest left is taken and a subset-sum
dynamic programme over bitsets finds the multiset of other lengths that leaves the least slack; the counts
are backtracked and the pattern is repeated as often as the histogram allows.  A rest finds its window by its rank
among the rests of its length.  Ranks come from counts per (length, salt) cell, so no length is gathered in one task.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from .scratch import stage
from .text import slices

SALTS = 256
CACHED_PARTS = 400_000
SLICE_BYTES = 1 << 20
#: The word pattern of byte-level BPE vocabularies, a fixed value.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, others follow from U+0100."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class PartTokenizer:
    """Ids of whole texts under a byte-level BPE file, put together from the ids of their space-separated parts.

    The word pattern never joins a character that is no white space to a space after it, so a text may be cut before each such space, and a
    part met before need not be encoded again.  Texts with parts that do not end in a character known to be no white space are encoded
    whole.  Strings of the file's added tokens are ordinary text or, with ``added``, those tokens' ids, and the texts between them are encoded apart.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special, byte = {t["content"]: struct.pack("<I", t["id"]) for t in spec["added_tokens"]}, byte_of()
        ranks = {bytes(byte[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        self._encode = tiktoken.Encoding("byte-level", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        if added and any(t[x] for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take white space or stand for whole words only")
        self._added = special
        longest_first = "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
        self._mark = re.compile(f"({longest_first})") if added and special else None
        self.heads: dict[str, bytes | None] = {}
        self.parts: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self._encode(text)).tobytes()

    def _spliced(self, text: str) -> bytes:
        return b"".join(self._added[x] if i % 2 else self._whole(x) for i, x in enumerate(self._mark.split(text)))

    def _learn(self, known: dict[str, bytes | None], found: set[str], prefix: str) -> None:
        if len(known) + len(found) > CACHED_PARTS:
            known.clear()
        for part in found.difference(known):
            last = part[-1:]
            known[part] = self._whole(prefix + part) if "!" <= last <= "~" or "\u00c0" <= last <= "\u07ff" else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.split(" ") for t in texts]
        self._learn(self.heads, {s[0] for s in split}, "")
        self._learn(self.parts, set().union(*(s[1:] for s in split)), " ")
        out = []
        for text, parts in zip(texts, split):
            if self._mark and self._mark.search(text):
                out.append(self._spliced(text))
                continue
            ids = [self.heads[parts[0]], *map(self.parts.__getitem__, parts[1:])]
            out.append(self._whole(text) if None in ids else b"".join(ids))
        return out


def cut_documents(df: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document: ``_id, start, length, ids_crc32, doc_tokens``."""
    end = struct.pack("<I", end_id)
    source = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    fields = [source.schema["_id"], *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = PartTokenizer(tokenizer_path, added=True)
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_BYTES):
                rows, columns = [], ([], [], [], [])
                for row, ids in enumerate(tokenizer.encode(batch.column(1).slice(lo, hi - lo).to_pylist()), lo):
                    ids = memoryview(ids + end)
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        rows.append(row)
                        for column, value in zip(columns, (start, len(piece) // 4, zlib.crc32(piece), total)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], [f.name for f in fields]
                )

    return source.mapInArrow(cut, T.StructType(fields))


def best_fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """Copies of each length in the fullest window that holds the longest length left."""
    longest = max(counts)
    room = window - longest
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        copies = 1
        while left > 0 and not reach >> room & 1:
            taken = min(copies, left)
            steps.append((length, taken, reach))
            reach |= reach << (length * taken) & mask
            left -= taken
            copies *= 2
    total, used = reach.bit_length() - 1, {longest: 1}
    for length, taken, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + taken
            total -= length * taken
    return used


def plan_windows(histogram: dict[int, int], window: int) -> np.ndarray:
    """Rows (length, first rank, copies a window, first window, offset), by length and first rank."""
    counts = {n: c for n, c in histogram.items() if c}
    ranks = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while counts:
        used = best_fill(counts, window)
        times = min(counts[n] // k for n, k in used.items())
        offset = 0
        for length, copies in used.items():
            rows.append((length, ranks[length], copies, sequence, offset))
            ranks[length] += copies * times
            offset += copies * length
            counts[length] -= copies * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack_windows(
    df: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack all rows of ``df`` into sequences of at most ``window`` tokens.

    Returns a row per piece: ``<id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset``.  A null text counts as empty: its one
    id is ``end_id``.  Repeated rows and ids are packed one by one; rows that tie are interchangeable.  Very long texts are
    cut into as many pieces as they need.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    pieces = stage(
        cut_documents(df, tokenizer_path, window, end_id, id_col, text_col).withColumn(
            "_salt", F.pmod(F.xxhash64(F.col("_id").cast("string"), "start", "ids_crc32"), F.lit(SALTS)).cast("int")
        ),
        "packing",
    )
    cells = pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counted = cells.groupBy("length").agg(F.sum("_n")).collect()  # one row per length, ``window`` at most
    plan = plan_windows({r[0]: r[1] for r in counted}, window)
    in_length = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select("length", "_salt", F.coalesce(F.sum("_n").over(in_length), F.lit(0)).alias("_cell_start"))
    place = F.row_number().over(W.partitionBy("length", "_salt").orderBy("_id", "start", "ids_crc32")) - 1
    ranked = (
        pieces.withColumn("_place", place)
        .join(starts, ["length", "_salt"])
        .select("_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_cell_start") + F.col("_place")).alias("_rank"))
    )
    fields = [
        T.StructField(id_col, ranked.schema["_id"].dataType),
        *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
    ]
    keys = plan[:, 0] << 40 | plan[:, 1]  # ranks of a length stay under 2 ** 40

    def place_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            _, first, copies, sequence, offset = plan[np.searchsorted(keys, length << 40 | rank, "right") - 1].T
            times, slot = np.divmod(rank - first, copies)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence + times), pa.array(offset + slot * length)], [f.name for f in fields]
            )

    return ranked.mapInArrow(place_pieces, T.StructType(fields))
