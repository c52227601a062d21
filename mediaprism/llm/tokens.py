"""Token counts with a broadcast table of frequent pieces and a cache in every Python worker.

The byte-level pre-tokenizer always ends a pre-token before a space that is followed by a character that is no white
space, so a text can be cut there and each piece encoded alone.  (Cutting only there keeps runs of white space, whose
split depends on what follows, within one piece.)  A text that holds the string of a special token is encoded as a whole
by the library.

The frequent pieces are counted over all documents, whole texts, in a pass of its own.  Pieces that are rare in a partition
may be forgotten while counting, so counts near the end of the table are not exact; the table only saves work, and what it
holds or lacks never changes a result.

Null texts count as empty, with no tokens.  Repeated rows and ids give repeated rows.  An empty table gives an empty
result.  Very long texts are streamed piece by piece; other columns are not looked at.
"""

from __future__ import annotations

import base64
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Pieces in the broadcast table; with at most MAX_PIECE characters each it stays under 3 MB.
FREQUENT, MAX_PIECE = 32_768, 48
#: Pieces in a worker's own cache, which is emptied when it is full.
CACHE = 400_000
#: Longer pieces go to the library itself.
LONG = 2000
CUT = re.compile(r" (?=\S)")


class Pieces(dict):
    """What ``make(piece)`` gives, for pieces of a text without their leading space."""

    def __init__(self, make, known: dict | None = None) -> None:
        super().__init__(known or {})
        self.make, self.known = make, known or {}

    def __missing__(self, piece: str):
        out = self.make(" " + piece)
        if len(piece) <= MAX_PIECE:
            if len(self) >= CACHE:
                self.clear()
                self.update(self.known)
            self[piece] = out
        return out


def _fast(path: str):
    """The same vocabulary for tiktoken, which encodes short pieces several times faster and gives the same ids (tested
    against the library); None if there is no such file beside it."""
    import tiktoken

    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        return None
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
    return tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary


class Encoder:
    """The library's encoder for one vocabulary file, with a cache of pieces for one kind of result."""

    def __init__(self, path: str, result, known: dict | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.one = lambda text: result(self.tokenizer.encode(text, add_special_tokens=False).ids)
        fast = _fast(path)
        short = (lambda text: result(fast(text)) if len(text) <= LONG else self.one(text)) if fast else self.one
        self.pieces = Pieces(short, known)

    def parts(self, text: str) -> list:
        """Results of the pieces of a text, in order."""
        if any(x in text for x in self.special):
            return [self.one(text)]
        first, *rest = CUT.split(text)
        return [*([self.one(first)] if first else []), *map(self.pieces.__getitem__, rest)]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str, result, known: dict | None = None) -> Encoder:
    """The worker's encoder; it outlives the task."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, result, known)
    return _encoders[path, kind]


def _trimmed(counts: Counter, size: int) -> Counter:
    return Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]))


def _summaries(size: int):
    """One row a partition: counts of its most frequent pieces.  Rare pieces are dropped while counting."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches):
            for text in batch.column(0):
                if text.is_valid:
                    counts.update(CUT.split(text.as_py())[1:])
                    if len(counts) > 8 * size:
                        counts = _trimmed(counts, 2 * size)
        kept = _trimmed(Counter({k: v for k, v in counts.items() if len(k) <= MAX_PIECE}), size // 4)
        yield pa.RecordBatch.from_pydict({"counts": [pickle.dumps(kept)]})

    return made


def _merged(size: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for blob in batch.column(0):
                counts.update(pickle.loads(blob.as_py()))
                if len(counts) > 8 * size:
                    counts = _trimmed(counts, 4 * size)
        yield pa.RecordBatch.from_pydict({"counts": [pickle.dumps(_trimmed(counts, size))]})

    return made


def frequent_pieces(docs: DataFrame, path: str, size: int = FREQUENT) -> dict[str, int]:
    """Token counts of the ``size`` most frequent pieces over all documents.

    Each partition sends one summary of bounded size; summaries are merged in two steps, so no piece is shuffled and the
    driver gets one summary.
    """
    parts = docs.select("text").mapInArrow(_summaries(size), "counts binary")
    n = max(1, round(parts.rdd.getNumPartitions() ** 0.5))
    rows = parts.repartition(n).mapInArrow(_merged(size), "counts binary").coalesce(1).mapInArrow(_merged(size), "counts binary").collect()
    found = list(pickle.loads(rows[0][0])) if rows else []
    one = Encoder(path, len)
    return {x: one.pieces[x] for x in found}


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text)."""
    path = path or public_tokenizers.path(TOKENIZER)
    docs = docs.select("doc_id", "text")
    known = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path, frequent))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, "count", len, known.value)
        for batch in batches:
            n = [sum(own.parts(x.as_py())) if x.is_valid else 0 for x in batch.column(1)]
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every row of ``documents``, whole texts."""
    return count_tokens(table(spark, sf_dir, "documents"))
