"""SimHash near-duplicates by Golay fuzzy hashing.

Fingerprints: 64 majority bits of the XXH64 hashes of a text's word shingles.  Two fingerprints are linked if they differ
in at most three bits; linked ones form components.

Search without loss: cut 64 bits into four blocks of 16.  If three bits or fewer differ, at least one block is equal, and
of the two 24-bit halves of the remaining 48 bits at least one differs in at most one bit.  So for each block and half
there is a key: the block's 16 bits and a Golay codeword near 23 bits of the half.  One side of the join carries the 8
narrow keys of a fingerprint, the other its at most 48 wide keys; a pair that meets is verified on all 64 bits within the
join.  Only distinct fingerprints take part, so exact copies never meet each other.

Null and empty texts have no words and the fingerprint zero, which links like any other.  Repeated rows have equal
fingerprints and share a component.  Null ids are allowed; a component's id is the smallest id that isn't null.  Texts of
any length are read whole.  An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from .common import stored, table
from .components import components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles as they come, repeats included."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < shingle:
        return np.array([_hash(b" ".join(found))], np.uint64)
    runs = map(b" ".join, zip(*(found[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(_hash, runs), np.uint64, len(found) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have, as an unsigned number; zero if there are none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, text_hash, fp); fp holds the 64 bits as a signed number."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(made, f"doc_id {kind}, text_hash bigint, fp bigint")


def fuzzy_keys(fps: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) pairs of signed fingerprints: eight keys each, or up to 48 if ``wide``."""
    bits = fps.view(np.uint64)
    out, row = [], []
    for block in range(4):
        own = (bits >> np.uint64(16 * block)) & np.uint64(0xFFFF)
        low = bits & np.uint64((1 << 16 * block) - 1)
        high = (bits >> np.uint64(16 * block + 16)) << np.uint64(16 * block) if block < 3 else np.uint64(0)
        rest = low | high
        for half in range(2):
            narrow, near = golay.keys(((rest >> np.uint64(24 * half)) & np.uint64(0xFFFFFF)).astype(np.int64))
            head = (np.int64(2 * block + half) << np.int64(28)) | (own.astype(np.int64) << np.int64(12))
            if wide:
                at, slot = np.nonzero(near >= 0)
                out.append(head[at] | near[at, slot])
                row.append(at)
            else:
                out.append(head | narrow)
                row.append(np.arange(len(fps)))
    return np.concatenate(out), np.concatenate(row)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints fps(fp) that differ in 1 to ``max_bits`` (at most 3) bits."""

    def keyed(wide: bool) -> DataFrame:
        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in frames:
                fp = x["fp"].to_numpy()
                key, row = fuzzy_keys(fp, wide)
                yield pd.DataFrame({"key": key, "b" if wide else "a": fp[row]})

        return fps.mapInPandas(rows, f"key bigint, {'b' if wide else 'a'} bigint")

    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # Spark takes the keys for about as large as the fingerprints, though there are up to 48 of each: never to the driver
    pairs = keyed(False).hint("merge").join(keyed(True).hint("merge"), "key").filter(near)
    return pairs.select("a", "b").distinct()


def classes(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The distinct fingerprints fps(fp, ...) with their root, which names the component over links of ``max_bits`` bits."""
    found = components(links(fps.select("fp"), max_bits)).select(F.col("node").alias("fp"), "component")
    return fps.join(found, "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for every row of docs(doc_id, text); root names the component."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    each = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    named = stored(classes(each, max_bits), "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(named.select("fp", "root").join(ids, "root"), "roots")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that are the first of their component in found(doc_id, text_hash, root): smallest
    id, then text hash; a repeated row stays once.  All columns are kept."""
    first = stored(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x")).select("x.doc_id", "x.text_hash"), "first")
    row, h = first.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")), F.xxhash64(docs["text"])
    kept = docs.join(row, docs["doc_id"].eqNullSafe(F.col("__id")) & (h == F.col("__h")), "left_semi")
    # a repeated row would stay twice; such rows are looked for in the narrow table first
    again = found.join(first.withColumnRenamed("doc_id", "__id").withColumnRenamed("text_hash", "__h"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__h")), "left_semi")
    if again.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        return kept
    return kept.withColumn("__h", h).dropDuplicates(["doc_id", "__h"]).drop("__h")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that are the first of their component."""
    return first_rows(docs, near_duplicates(docs, shingle, max_bits))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every row of ``documents``, whole texts."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
