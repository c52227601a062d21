"""Removal of word passages that repeat anywhere in the corpus.

A window is ``window`` consecutive words of one document; every word that lies in a window whose word sequence also
starts elsewhere, in the same document or another, is removed.

Why no broadcast automata here: the reference shards are the whole corpus, so every shard's automaton would have to
meet every document, which is quadratic in the input, and an automaton in Python takes hundreds of bytes a word (README
has the figures).  Instead, matches are seeded by minimizers and verified by counting, which is linear and exact up to
collisions of 64-bit hashes (keys and contents come from the same word hashes, so two hashes together are no stronger):

1. Each window has a key: the least hash of its ``gram``-word grams.  Equal windows have equal keys.  Consecutive windows
   with one key form a run; a document of n words has about 2n/29 runs.  One narrow row a run is counted by (key, content
   of the whole run) and by key.  A key with one occurrence has no repeated window.  A run whose whole content occurs
   twice is repeated as a whole, which settles all copies.
2. The runs that are left (the ends of shared passages, edited places), and one representative of each repeated run with
   the same key, are verified: their window hashes are counted by (key, window).
3. Repeated ranges go back to their documents.

Windows that repeat within one run are found on the spot, in step 1.  Every count is pre-aggregated on the map side, no
group is collected, and joins run against tables with one row a key, whose other side can be split when it is skewed.

Null and empty texts and those shorter than a window lose nothing.  Repeated rows are occurrences of their own, so their
windows count as repeated.  An empty table gives an empty result; other columns are kept aside or not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, stored, table

WINDOW, GRAM = 35, 8
_BASE = 0x9E3779B97F4A7C15 | 1
#: Word hashes that a worker remembers before it starts anew.
CACHE = 100_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 15)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Hashed:
    """Rolling hashes of one text's words."""

    def __init__(self, found: list[bytes]) -> None:
        n = self.n = len(found)
        power, self.inverse = _power(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.fromiter(map(_words.__getitem__, found), np.uint64, n) * power[:n], out=self.sums[1:])

    def spans(self, a: np.ndarray, size) -> np.ndarray:
        """Hashes of the ``size`` words from each place of ``a``."""
        return _mix((self.sums[a + size] - self.sums[a]) * self.inverse[a])

    def every(self, size: int) -> np.ndarray:
        return _mix((self.sums[size:] - self.sums[:-size]) * self.inverse[: self.n - size + 1])

    def keys(self, window: int, gram: int) -> np.ndarray:
        """The least gram hash of each window."""
        least, width, goal = self.every(gram), 1, window - gram + 1
        while 2 * width <= goal:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        return np.minimum(least[: len(least) - (goal - width)], least[goal - width :]) if width < goal else least


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of equal keys."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]]) - 1


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _seeds(window: int, gram: int):
    """(doc_id, text_hash, key, content, a, b) for every run; rows with a null key hold windows that repeat within a run."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            row, cols = [], []
            for k, text in enumerate(batch.column(2)):
                found = text.as_py().encode().split() if text.is_valid else []
                if len(found) < window:
                    continue
                h = Hashed(found)
                keys = h.keys(window, gram)
                a, b = runs(keys)
                length = b - a + window
                content = _mix(h.spans(a, length) ^ length.astype(np.uint64))
                row.append(np.full(len(a), k))
                cols.append((keys[a], content, a, b, np.zeros(len(a), bool)))
                if (b - a).max() >= 1:
                    # a window that repeats at a distance shorter than a run: its text has a period, so look only there
                    every = h.every(window)
                    order = np.argsort(every, kind="stable")
                    same = every[order[1:]] == every[order[:-1]]
                    if same.any():
                        twice = np.zeros(len(every), bool)
                        twice[order[1:][same]] = twice[order[:-1][same]] = True
                        x, y = _ranges(twice)
                        row.append(np.full(len(x), k))
                        cols.append((np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64), x, y, np.ones(len(x), bool)))
            if not row:
                continue
            at = pa.array(np.concatenate(row))
            key, content, a, b, own = (np.concatenate(x) for x in zip(*cols, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(key.view(np.int64), mask=own), _signed(content), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                ["doc_id", "text_hash", "key", "content", "a", "b"],
            )

    return made


def _windows(window: int):
    """(doc_id, text_hash, key, hash, at, weight) for every window of the runs to verify."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for k, (text, todo) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                h = Hashed(text.as_py().encode().split())
                x = todo.values.flatten()
                key, a, b, weight = (np.asarray(y) for y in x)
                size = b - a + 1
                at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(n, k))), batch.column(1).take(pa.array(np.full(n, k))), pa.array(np.repeat(key, size)), _signed(h.spans(at, window)), pa.array(at, pa.int32()), pa.array(np.repeat(weight, size), pa.int32())],
                    ["doc_id", "text_hash", "key", "hash", "at", "weight"],
                )

    return made


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, ranges array<struct<a, b>>): first and last starts of repeated windows, one row for each
    (doc_id, text) that has any."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    ids = f"doc_id {id_type}, text_hash bigint"
    seeds = stored(docs.mapInArrow(_seeds(window, gram), f"{ids}, key bigint, content bigint, a int, b int"), "seeds")
    local = seeds.filter("key IS NULL").select("doc_id", "text_hash", "a", "b")
    seeds = seeds.filter("key IS NOT NULL")

    place = F.xxhash64("doc_id", "text_hash", "a")
    contents = seeds.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    contents = stored(contents, "contents")
    keys = contents.groupBy("key").agg(F.sum("n").alias("n_key"), F.min("n").alias("least")).filter("n_key > 1")
    known = stored(contents.join(keys, "key").select("key", "content", "n", "first", (F.col("least") == 1).alias("open")), "known")
    marked = seeds.join(known, ["key", "content"]).select("doc_id", "text_hash", "key", "a", "b", (F.col("n") > 1).alias("whole"), (F.col("open") & ((F.col("n") == 1) | (F.col("first") == place))).alias("verify"))
    marked = stored(marked.filter("whole OR verify"), "marked")

    # the representative of a run that occurs n > 1 times weighs 2; single runs weigh 1
    weight = F.when(F.col("whole"), 2).otherwise(1)
    todo = marked.filter("verify").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("key", "a", "b", weight.alias("weight"))).alias("todo"))
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["text_hash"] == y["text_hash"])
    # rows that share id and text need one reading: they are repeated as a whole, so only as representatives they occur here
    joined = docs.join(todo, same(docs, todo)).select(docs["doc_id"], docs["text_hash"], "text", "todo")
    windows = stored(joined.mapInArrow(_windows(window), f"{ids}, key bigint, hash bigint, at int, weight int"), "windows")
    twice = stored(windows.groupBy("key", "hash").agg(F.sum("weight").alias("n")).filter("n > 1").select("key", "hash"), "twice")
    proven = windows.filter("weight = 1").join(twice, ["key", "hash"]).select("doc_id", "text_hash", F.col("at").alias("a"), F.col("at").alias("b"))

    ranges = local.unionAll(marked.filter("whole").select("doc_id", "text_hash", "a", "b")).unionAll(proven)
    return stored(ranges.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")


def _kept(window: int, wanted: bool):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n_words, n_removed, digest, texts = [], [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("__ranges"), strict=True):
                found = text.as_py().encode().split() if text.is_valid else []
                n_words.append(len(found))
                if ranges.is_valid:
                    a, b = (np.asarray(x) for x in ranges.values.flatten())
                    depth = np.zeros(len(found) + 1, np.int64)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, b + window, -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    found = [w for w, k in zip(found, keep.tolist(), strict=True) if k]
                n_removed.append(n_words[-1] - len(found))
                if wanted:
                    texts.append(b" ".join(found).decode() if n_removed[-1] else text.as_py())
                else:
                    digest.append(hashlib.sha256(b" ".join(found)).hexdigest())
            if wanted:
                kept = [batch.column(i) for i, x in enumerate(batch.schema.names) if x != "__ranges"]
                kept[batch.schema.names.index("text")] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*kept], [x for x in batch.schema.names if x != "__ranges"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return made


def _with_ranges(docs: DataFrame, window: int, gram: int) -> DataFrame:
    found = repeated_ranges(docs, window, gram).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), F.col("ranges").alias("__ranges"))
    joined = docs.withColumn("__text_hash", F.xxhash64("text"))
    return joined.join(found, joined["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__h")), "left").select(*docs.columns, "__ranges")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the words left in ``text``, joined by one space; a text that loses nothing stays as it is.  All columns
    are kept; ``n_chars``, if there, is counted anew."""
    out = _with_ranges(docs, window, gram).mapInArrow(_kept(window, True), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every row of ``documents``, whole texts, windows of 35 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return _with_ranges(docs, WINDOW, GRAM).mapInArrow(_kept(WINDOW, False), f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string")
