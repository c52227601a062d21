"""Best-fit packing by exact-complement hashing.

Texts become token ids, then the end id.  Sequences longer than the capacity are cut into full pieces; a shorter piece,
if any, comes first.  Only the number of pieces of each length decides how to pack, and there are at most ``capacity``
lengths, so the plan is made on the driver from that histogram whatever the number of documents:

1. the longest length that is left opens a pattern; its gap is looked up among single lengths, sums of two and sums of
   three that are still available, and the match is used as often as the counts allow;
2. what finds no exact complement is filled best-fit: the largest length that still fits, again and again.

Each use of a pattern empties at least one length's count, so there are few patterns.  Every piece then gets its rank
among the pieces of its length (length and a hash salt form small groups, whose sizes are summed up to ranks), and the
rank tells its sequence and offset.  Hot lengths are split by the salt; nothing but the histogram reaches the driver.

Null texts are empty: one piece that holds the end id.  Repeated rows are packed as often as they come, ties of equal
lengths are ordered by doc_id.  An empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .tokens import TOKENIZER, encoder

CAPACITY, END_ID = 1024, 2


def _bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of docs(doc_id, text)."""
    path, end = path or public_tokenizers.path(TOKENIZER), _bytes([END_ID])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, "ids", _bytes)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = memoryview(b"".join(own.parts(text.as_py()) if text.is_valid else []) + end)
                n = len(ids) // 4
                at = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    row.append(k)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            ids_ = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _complement(have: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that sum to ``gap``; the one with the longest parts."""
    if have[gap] > 0:
        return [gap]

    def two(total: int, most: int) -> list[int] | None:
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        if not len(a):
            return None
        hit = np.flatnonzero((have[a] > 0) & (have[total - a] > (a == total - a)))
        return [int(a[hit[0]]), int(total - a[hit[0]])] if len(hit) else None

    if pair := two(gap, gap):
        return pair
    for a in np.flatnonzero(have[: gap - 1])[::-1]:
        if 3 * a < gap:
            return None
        have[a] -= 1
        rest = two(gap - int(a), int(a))
        have[a] += 1
        if rest:
            return [int(a), *rest]
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order of their offsets, how often) that use up ``counts`` exactly."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[list[int], int]] = []

    def use(lengths: list[int]) -> None:
        need = np.bincount(lengths, minlength=capacity + 1)
        n = int((have[need > 0] // need[need > 0]).min())
        have[need > 0] -= n * need[need > 0]
        out.append((lengths, n))

    for length in range(capacity, 0, -1):
        while have[length]:
            if length == capacity:
                use([length])
                continue
            have[length] -= 1
            rest = _complement(have, capacity - length)
            have[length] += 1
            if rest:
                use([length, *rest])
                continue
            lengths, gap, left = [length], capacity - length, have.copy()
            left[length] -= 1
            while gap and len(fits := np.flatnonzero(left[: gap + 1])):
                lengths.append(int(fits[-1]))
                left[fits[-1]] -= 1
                gap -= int(fits[-1])
            use(lengths)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, piece, start, length, ids_crc32); no sequence exceeds ``capacity``."""
    pieces = stored(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # slots: pieces of a length whose rank is first, first + 1, ... go to sequences base, base + 1, ... at an offset
    slots, taken, base = [], dict.fromkeys(counts, 0), 0
    for lengths, n in plan(counts, capacity):
        offset = 0
        for x in lengths:
            slots.append((x, taken[x], base, offset))
            taken[x] += n
            offset += x
        base += n
    slots.sort()
    length, first, base_, offset_ = (np.array(x, dtype=np.int64) for x in zip(*slots, strict=True)) if slots else (np.zeros(0, np.int64),) * 4
    span = max(counts.values(), default=0) + 1  # (length, rank) as one number; under 2**63 up to 10**15 pieces

    group = max(200, sum(counts.values()) // 1_000_000)  # at most a million groups and one for each length
    salts = F.element_at(F.array(*(F.lit(max(1, counts.get(x, 0) // group)) for x in range(1, capacity + 1))), F.col("length").cast("int"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            at = np.searchsorted(length * span + first, x["length"].to_numpy() * span + x["rank"].to_numpy(), side="right") - 1
            yield x.drop(columns="rank").assign(sequence_id=base_[at] + x["rank"].to_numpy() - first[at], offset=offset_[at])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.select(*kept, "rank").mapInPandas(placed, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every row of ``documents``, whole texts, into sequences of 1024 tokens."""
    return pack(token_pieces(table(spark, sf_dir, "documents")))
