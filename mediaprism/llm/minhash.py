"""Near-duplicates by shingle similarity: SimHash classes and MinHash buckets, exact Jaccard check, components.

A text's set holds the XXH64 hashes of its runs of five words (a shorter text is one run); texts with equal sets are one
node.  Two nodes are linked if the Jaccard similarity of their sets is 0.8 or more; linked ones form components.

Search, first by the operator of ``simhash``: fingerprints of the five-word runs, repeats included, Golay keys, their join, the
check on all 64 bits, components.  A component is a bucket, cut by the sets' sizes, so no pair within three bits is left
unchecked.  Pairs at 0.8 differ in up to 11 bits, which those keys can't reach; for them a node is also in one bucket of each
of 20 bands of five minima.  A pair at exactly 0.8 shares one with probability 0.9996, one at 0.9 with all but 1e-7; a pair
that shares none and isn't joined by SimHash is the only kind of link that can be lost.  No link is taken on an estimate: each
is checked on the whole sets, in whole numbers.

A bucket of m nodes isn't compared pair by pair at once.  First each node is checked against one leader of each of its
buckets, in a few rounds with other leaders; that joins the bulk of a large group in steps linear in m.  Then the nodes of a
bucket outside its largest component are checked against all of the bucket, in blocks of bounded numbers of nodes and of
shingles, and a block gives no more edges than its components need.  So no pair is a row of any join, and pairs left out are
within one component already: the components are those of all pairs that share a bucket.

Null and empty texts have the empty set and are one node without links.  Repeated rows share a node.  Null ids are allowed.
Texts of any length are read whole.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored
from .components import components
from .simhash import classes, first_rows, majority, shingle_hashes

SHINGLE, PERCENT, BANDS, ROWS, STARS, SEED = 5, 80, 20, 5, 3, 42
_CHUNK = 256
#: Nodes and shingles of a block, and columns that are multiplied at once.
BLOCK_NODES, BLOCK_SHINGLES, _COLUMNS = 1024, 1 << 20, 2048


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles in order."""
    return np.unique(shingle_hashes(text, shingle))


def node_of(members: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(members.tobytes(), SEED)).view(np.int64))


def buckets(members: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """The signed 64-bit names of a set's buckets, one a band; the empty set has none."""
    if not len(members):
        return []
    r = np.random.default_rng(SEED)
    flips = r.integers(0, 1 << 64, bands * rows, dtype=np.uint64)
    factors = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, (1 << 64) - 1, np.uint64)
    for at in range(0, len(members), _CHUNK):
        least = np.minimum(least, ((members[at : at + _CHUNK, None] ^ flips) * factors).min(0))
    names = [xxhash.xxh64_intdigest(least[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)]
    return np.array(names, np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, node, size, fp, buckets) for every row of docs(doc_id, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            nodes, sizes, fps, near = [], [], [], []
            for x in batch.column(2):
                hashes = shingle_hashes(x.as_py(), shingle)
                members = np.unique(hashes)
                nodes.append(node_of(members))
                sizes.append(len(members))
                fps.append(majority(hashes))
                near.append(buckets(members))
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(near, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "node", "size", "fp", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(made, f"doc_id {kind}, text_hash bigint, node bigint, size int, fp bigint, buckets array<bigint>")


def simhash_buckets(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, size, bucket) for every component of fingerprints and each two steps of sizes in it, over rows(node, size, fp).

    Sets that are similar enough differ in size by a factor of 100 / percent at most, so they are in one step or in two that follow.
    """
    fps = stored(rows.filter("size > 0").select("node", "size", "fp").distinct(), "fps")
    roots = stored(classes(fps.select("fp").distinct()), "classes")
    step = F.floor(F.log("size") / F.log(F.lit(101 / percent)))
    return fps.join(roots, "fp").select("node", "size", F.explode(F.array(*(F.xxhash64("root", step + i) for i in range(2)))).alias("bucket")).distinct()


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, members) of the nodes wanted(node); one text is read for each."""
    own = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.text_hash").alias("__h"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left_semi").select("text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "members"])

    return texts.mapInArrow(made, "node bigint, members array<bigint>").distinct()


def _enough(common: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes a and b with so many common members are similar enough."""
    return common.cast("long") * 100 >= (a.cast("long") + b - common) * percent


def _block_links(percent: int):
    """(a, b): edges between components of one block (node, component, members), enough to join what is similar enough."""

    def found(block: pa.Table) -> pa.Table:
        node, component = block.column("node").to_numpy(), block.column("component").to_numpy()
        members = block.column("members").combine_chunks()
        size = members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, row = members.flatten().to_numpy(), np.repeat(np.arange(len(node)), size)
        _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[token] > 1  # others can't be common to two sets
        token, row = np.unique(token[shared], return_inverse=True)[1], row[shared]
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        names, kind, many = np.unique(component, return_inverse=True, return_counts=True)
        rest = np.flatnonzero(kind != many.argmax())
        common = np.zeros((len(rest), len(node)), np.float32)
        for start in range(0, int(token[-1]) + 1 if len(token) else 0, _COLUMNS):
            part = slice(*np.searchsorted(token, [start, start + _COLUMNS]))
            has = np.zeros((len(node), _COLUMNS), np.float32)
            has[row[part], token[part] - start] = 1
            common += has[rest] @ has.T
        both = common.astype(np.int64)
        x, y = np.nonzero((both * 100 >= (size[rest][:, None] + size[None, :] - both) * percent) & (kind[rest][:, None] != kind[None, :]))
        x = rest[x]
        _, first = np.unique(np.minimum(kind[x], kind[y]) * len(names) + np.maximum(kind[x], kind[y]), return_index=True)
        root, edges = list(range(len(names))), []
        for a, b in zip(x[first].tolist(), y[first].tolist(), strict=True):
            i, j = int(kind[a]), int(kind[b])
            while root[i] != i:
                root[i] = i = root[root[i]]
            while root[j] != j:
                root[j] = j = root[root[j]]
            if i != j:
                root[i] = j
                edges.append((min(node[a], node[b]), max(node[a], node[b])))
        return pa.table({"a": pa.array([int(a) for a, _ in edges], pa.int64()), "b": pa.array([int(b) for _, b in edges], pa.int64())})

    return found


def links(crowded: DataFrame, sets: DataFrame, percent: int = PERCENT, stars: int = STARS) -> DataFrame:
    """(node, component) over the pairs of crowded(bucket, node, size) that share a bucket and are similar enough."""

    def checked(pairs: DataFrame) -> DataFrame:
        side = lambda name: sets.select(F.col("node").alias(name), F.col("members").alias(f"of_{name}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.filter(_enough(F.size(F.array_intersect("of_a", "of_b")), F.size("of_a"), F.size("of_b"), percent)).select("a", "b")

    fits = lambda x, y: _enough(F.least(x, y), x, y, percent)
    edges, found, left, turn = None, None, crowded.withColumn("component", F.col("node")), 0
    while turn <= stars:
        if found is not None:
            left = crowded.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        spread = left.groupBy("bucket").agg(F.min("component").alias("m"), F.max("component").alias("n")).filter("m < n").select("bucket")
        left = stored(left.join(spread, "bucket", "left_semi").select("bucket", "node", "size", "component"), "open")
        if found is not None and left.isEmpty():
            break
        if turn < stars:
            mix = F.xxhash64(F.lit(turn), "bucket")
            leader = left.groupBy("bucket").agg(F.min(F.col("node").bitwiseXOR(mix)).alias("l")).select("bucket", F.col("l").bitwiseXOR(mix).alias("node"))
            leader = leader.join(left, ["bucket", "node"]).select("bucket", F.col("node").alias("lead"), F.col("size").alias("lead_size"), F.col("component").alias("lead_component"))
            pairs = left.join(leader, "bucket").filter((F.col("component") != F.col("lead_component")) & fits(F.col("size"), F.col("lead_size"))).select(F.col("node").alias("x"), F.col("lead").alias("y"))
            more = checked(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        else:
            cut = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum(F.col("size").cast("long")) / BLOCK_SHINGLES)).cast("int")
            blocks = left.groupBy("bucket").agg(cut.alias("c"))
            rows = left.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("c")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
            rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component").join(sets, "node")
            more = rows.select("bucket", "i", "j", "node", "component", "members").groupBy("bucket", "i", "j").applyInArrow(_block_links(percent), "a bigint, b bigint").distinct()
        more = stored(more, "links")
        # where leaders give nothing new, the pairs that are left come next
        turn = turn + 1 if turn == stars or not more.isEmpty() else stars
        if edges is None or not more.isEmpty():
            edges = more if edges is None else edges.unionAll(more)
            found = components(edges)
    return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, root) for every row of docs(doc_id, text); root names the component."""
    rows = stored(sketches(docs, shingle), "sketches")
    nodes = rows.select("node", "size", "buckets").distinct()
    spread = nodes.select("node", "size", F.explode("buckets").alias("bucket")).unionAll(simhash_buckets(rows, percent))
    spread = stored(spread, "buckets")
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    crowded = stored(spread.join(shared, "bucket", "left_semi").select("bucket", "node", "size"), "crowded")
    narrow = rows.select("doc_id", "text_hash", "node")
    sets = stored(_sets(docs, narrow, crowded.select("node").distinct(), shingle), "sets")
    found = links(crowded, sets, percent)
    return stored(narrow.join(found, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("root")), "roots")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that are the first of their component, see simhash.first_rows."""
    return first_rows(docs, near_duplicates(docs, shingle, percent))
