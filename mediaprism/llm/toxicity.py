"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features: words in lower case without outer punctuation, pairs of neighbours, and pairs with one word between them, each
hashed to one of 2**20 places; a text has a feature or not, however often.  The model has a learning rate for every
coordinate and an L1 penalty that leaves most weights at exactly zero; the others, at most ``1 << BITS`` of them and in
practice some hundreds, are what is broadcast.

Learning: of the labelled rows that are not held out (crc32 of the id as text, modulo 3, is not 1), the ``max_rows`` with
the smallest hash of their id are taken, in that order, as long as their features number ``MAX_PLACES`` or less in all; these
two bounds are the model's parameters.  A document that stands in ``docs`` repeatedly with one text is one example a label.
One task fits the model, in memory within these bounds, and the driver gets its weights only.  Features of so few examples
that their weight can't leave zero (their number times the epochs is at most L1) are left out first, which changes nothing.
Labels, language, source and id are no features.  With no usable label every score is 0.5.

``ALPHA``, ``L1`` and ``EPOCHS`` have the least log loss of 36 settings, fitted on the rows with remainder 0 and scored on
those with remainder 2 and the other way round; rows with remainder 1 were never looked at.

Null texts score like empty ones: by the intercept.  Null ids are scored and count as not held out.  Repeated label rows
are repeated examples; null labels are left out.  An empty table gives an empty result.  Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sliced, stored, table

BITS, MAX_ROWS, EPOCHS, THRESHOLD = 20, 12_000, 4, 0.7
MAX_PLACES = 16_000_000
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
_STRIP = b""".,;:!?"'()[]{}<>*#%&$|_-"""
CACHE = 100_000


class _Words(dict):
    """Hashes of words as they stand in the text; those that strip to nothing are 0."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        bare = word.decode().lower().encode().strip(_STRIP)
        out = self[word] = xxhash.xxh3_64_intdigest(bare) | 1 if bare else 0
        return out


_words = _Words()


def all_features(text: str | None) -> np.ndarray:
    """Places of all features of a text, with repeats."""
    found = (text or "").encode().split()
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    h = h[h > 0]
    pair = lambda a, b, salt: (a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
    every = np.concatenate([h, pair(h[:-1], h[1:], 1), pair(h[:-2], h[2:], 2)])
    return (every >> np.uint64(64 - BITS)).astype(np.uint32)


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, intercept) after FTRL-proximal over the examples (unique places, label), in their order."""
    seen = np.zeros(1 << BITS, np.int64)
    for places, _ in examples:
        seen[places] += 1
    # a gradient is less than 1, so the sum of fewer than L1 of them leaves the weight at zero
    examples = [(places[seen[places] * epochs > L1], label) for places, label in examples]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))
        w[-1] = -zi[-1] / ((BETA + np.sqrt(n[at[-1]])) / ALPHA)  # the intercept has no penalty
        return w

    for _ in range(epochs):
        for places, label in examples:
            at = np.append(places, 1 << BITS).astype(np.int64)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    at = np.flatnonzero(np.abs(z[:-1]) > L1)
    final = weights(np.append(at, 1 << BITS))
    return at.astype(np.uint32), final[:-1].astype(np.float32), float(final[-1])


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_places: int = MAX_PLACES) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from docs(doc_id, text) and labels(doc_id, toxic)."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("label"))
    # at most max_rows narrow rows, so the broadcasts have a bound
    chosen = stored(usable.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id", "label").limit(max_rows), "chosen")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [np.unique(all_features(x.as_py())) for x in batch.column(1)]
            hashes = [xxhash.xxh3_64_intdigest(x.as_py() or "") - (1 << 63) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.int64()), pa.array([len(x) for x in rows], pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())], ["doc_id", "h", "n", "places"])

    wanted = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    found = wanted.mapInArrow(featured, f"doc_id {kind}, h bigint, n bigint, places binary")
    found = stored(found.groupBy("doc_id", "h").agg(F.any_value("n").alias("n"), F.any_value("places").alias("places")), "features")
    sizes = found.select("doc_id", "h", "n").join(F.broadcast(chosen), "doc_id")
    order = ["rank", "doc_id", "label", "h"]
    taken = sizes.orderBy(*order).limit(max_rows)  # one partition of narrow rows
    total = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    taken = stored(taken.withColumn("total", total).filter(F.col("total") <= max_places).drop("total", "n"), "taken")
    examples = found.join(F.broadcast(taken), ["doc_id", "h"]).select("rank", F.col("doc_id").cast("string").alias("id"), "label", "h", "places")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:  # features stay in the batches' buffers, and are not copied
            keys = zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)
            rows += [(*k, np.frombuffer(p.as_buffer(), np.uint32) if len(p.as_buffer()) else np.zeros(0, np.uint32)) for k, p in zip(keys, batch.column(4), strict=True)]
        if rows:
            rows.sort(key=lambda r: r[:4])
            places, weights, intercept = fit([(r[4], r[2]) for r in rows])
            yield pa.RecordBatch.from_pydict({"places": [places.tobytes()], "weights": [weights.tobytes()], "intercept": [intercept]})

    model = examples.coalesce(1).mapInArrow(fitted, "places binary, weights binary, intercept double").collect()  # one row
    if not model:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0
    return np.frombuffer(model[0]["places"], np.uint32), np.frombuffer(model[0]["weights"], np.float32), model[0]["intercept"]


def score_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: bool = False, name: str = "score") -> DataFrame:
    """docs(doc_id, text) -> doc_id and the score, or all columns and the score if ``keep``; ``name`` names the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs if keep else docs.select("doc_id", "text")
    out = docs.schema if keep else docs.select("doc_id").schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights, intercept = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[places] = weights
        for batch in sliced(batches):
            got = []
            for text in batch.column("text"):
                at = all_features(text.as_py())
                at = np.unique(at[dense[at] != 0])
                got.append(1 / (1 + np.exp(-np.clip(float(dense[at].sum(dtype=np.float64)) + intercept, -35, 35))))
            names = [f.name for f in out]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(got, pa.float64())], [*names, name])

    return docs.mapInArrow(scored, partial(type(out), list(out.fields))().add(name, "double"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below ``threshold``, with all their columns."""
    return score_texts(docs, train(docs, labels), keep=True, name="__score").filter(F.col("__score") < threshold).drop("__score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every row of ``documents``, whole texts; labels from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    out = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
