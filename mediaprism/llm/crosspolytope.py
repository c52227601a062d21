"""Approximate nearest neighbours by cross-polytope hashing.

A table has two hashes; each rotates a vector with three rounds of random signs and a fast Hadamard transform and names the
nearest signed axis.  The pair of axes is the vector's cell in that table, so a table has ``(2 * size) ** 2`` cells.  Every
vector stands in one cell of each table.  A query values a cell by the sum of its own two coordinates along the cell's axes
and probes, in every table, the cells that it values at ``tau`` or more.

``tau`` follows from the neighbours, by one rule at every size of table.  First a query looks along its nearest first axis
in each table; the (k+1)-th best row there bounds its list from below.  A row that belongs in the list has at least that
inner product, so at least a known cosine, and ``reach`` says which ``tau`` finds a row at that cosine in one of the tables
with probability ``TARGET`` (simulated once a driver from a fixed seed; it depends on the dimension and the tables alone).
The query then probes these cells, and only what reaches the bound leaves the scan.  Where a first look finds too few rows,
or the bound is so low that angles say nothing, the rule gives every cell, and the query sees every vector.

Norms may differ: vectors are held in bands of norms, hashed by direction, and a band needs the larger a cosine the
shorter its longest vector; bands too short to matter are left out, exactly.

Equal vectors are one entry of the index with the ``k + 1`` smallest of their ids, which is all that can be in a result
(the rest only tie behind them), so a vector that a third of the rows share is searched once.  Neighbouring cells are
scanned together in blocks, cut further by hash, so that a task sees at most about ``chunk`` vectors and ``chunk`` queries.
Vectors travel with their entries (``tables`` copies): a query has thousands of candidates even at 0.4 cosine, so fetching
them by id, pair by pair, would move far more.

Rows with a null id, a null or empty vector, a zero vector, or null, NaN or infinite components take no part, as query or
candidate.  Shorter vectors count as filled up with zeros.  Rows with the same id are separate candidates; a query leaves
out one candidate of its own id and vector.  Ties go to smaller ids.  Inner products beyond the range of doubles are
infinite, as IEEE arithmetic has it.  An empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

TABLES, TARGET, NEIGHBOURS, EVERY = 8, 0.92, 20, 20
#: Numbers in the vectors of a chunk, and queries that are scored at once.
CHUNK_NUMBERS, _BLOCK = 1 << 20, 256
#: Steps of the cosine in ``reach``; below the first one a cosine says nothing.
_STEPS = 25


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotations(tables: int, size: int) -> np.ndarray:
    """Signs (tables, 2, 3, size) of the pseudo-rotations; fixed for a size."""
    return np.random.default_rng(size).choice([-1.0, 1.0], (tables, 2, 3, size))


@cache
def _hadamard(size: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rounds of signs and a fast Hadamard transform, in n log n; x is (rows, power of two).  Steps are of radix 16: one
    small matrix product each."""
    rows, size = x.shape
    y = x
    for s in signs:
        y, done = y * s, 1
        while done < size:
            radix = min(16, size // done)
            y = y.reshape(rows, size // (done * radix), radix, done).swapaxes(2, 3).reshape(-1, radix) @ _hadamard(radix)
            y = y.reshape(rows, size // (done * radix), done, radix).swapaxes(2, 3).reshape(rows, size)
            done *= radix
        y = y / np.sqrt(size)
    return y


def axes(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """(rows, 2 * size): coordinates along the signed axes; axis i is i, its opposite size + i."""
    y = rotate(x, signs)
    return np.concatenate([y, -y], axis=1)


@cache
def reach(dim: int, tables: int, target: float) -> np.ndarray:
    """For cosines in ``_STEPS`` equal steps: the ``tau`` that finds a row at that cosine with probability ``target``."""
    r, n, m = np.random.default_rng(dim), 128, 4
    size = 1 << (dim - 1).bit_length()
    signs = rotations(tables, size)
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-300)
    q = unit(r.normal(size=(n, dim)))
    u = r.normal(size=(n, m, dim))
    u = unit(u - (u * q[:, None]).sum(2, keepdims=True) * q[:, None])
    c = np.linspace(0, 1, _STEPS + 1)[:, None, None, None]
    x = _padded((c * q[None, :, None] + np.sqrt(1 - c * c) * u[None]).reshape(-1, dim), size)
    of, q = np.tile(np.repeat(np.arange(n), m), _STEPS + 1), _padded(q, size)
    best = np.full(len(x), -np.inf)
    for first, second in signs:
        best = np.maximum(best, sum(axes(q, s)[of, axes(x, s).argmax(1)] for s in (first, second)))
    tau = np.maximum.accumulate(np.quantile(best.reshape(_STEPS + 1, -1), 1 - target, axis=1))
    tau[0] = -np.inf
    return tau


def _padded(x: np.ndarray, size: int) -> np.ndarray:
    return x if x.shape[1] == size else np.concatenate([x, np.zeros((len(x), size - x.shape[1]))], axis=1)


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(x.tobytes())])


def _hits(scores: np.ndarray, low: np.ndarray, allowed, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the allowed scores that reach ``low`` and can be among the k best of their row."""
    row, col = np.nonzero(scores >= low[:, None])
    if allowed is not None:
        ok = allowed(row, col)
        row, col = row[ok], col[ok]
    if len(row) > 4 * k * len(scores) and scores.shape[1] > k:
        some = np.full(scores.shape, -np.inf)
        some[row, col] = scores[row, col]
        least = -np.partition(-some, k - 1, axis=1)[:, k - 1]
        with np.errstate(invalid="ignore"):
            least = least - 1e-9 * np.abs(least)
        ok = scores[row, col] >= np.where(np.isnan(least), -np.inf, least)[row]
        row, col = row[ok], col[ok]
    return row, col


class Layout:
    """What the tasks know of the index: dimension, bands and how many blocks each has.  ``bands`` has (band, longest norm,
    entries); a band's cells of a table are cut into 2**a blocks by the first axis, and these into 2**b by the second."""

    def __init__(self, dim: int, single: bool, tables: int, target: float, k: int, chunk: int, bands: list[tuple[int, float, int]]) -> None:
        self.dim, self.kind, self.k, self.chunk = dim, np.dtype(np.float32 if single else np.float64), k, chunk
        self.size = 1 << (dim - 1).bit_length()
        self.signs, self.target, self.bands = rotations(tables, self.size), target, bands
        self.cuts = []
        most = (2 * self.size).bit_length() - 1
        for _, _, n in bands:
            cut = min((max(n // chunk, 1) - 1).bit_length(), 2 * most)
            self.cuts.append((min(cut, most), max(cut - most, 0)))
        self.width = 1 << 2 * most  # blocks that a band may have

    def group(self, t: int, band: int, block: np.ndarray) -> np.ndarray:
        return (t * len(self.bands) + band) * self.width + block

    def matrix(self, column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(-1, self.dim).astype(np.float64)

    def directions(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return _padded(x / np.linalg.norm(x, axis=1, keepdims=True), self.size)

    def index(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(group, cell, v, ids, v1, v2) for each table of each entry (v, ids, v1, v2, band)."""
        number = {b: i for i, (b, _, _) in enumerate(self.bands)}
        for batch in batches:
            x = self.directions(self.matrix(batch.column(0)))
            band = np.array([number[b] for b in batch.column(4).to_pylist()], dtype=np.int64)
            a, b = np.array(self.cuts, dtype=np.int64).reshape(-1, 2)[band].T
            most = (2 * self.size).bit_length() - 1
            for t, (first, second) in enumerate(self.signs):
                i, j = axes(x, first).argmax(1), axes(x, second).argmax(1)
                block = (i >> (most - a) << b) + (j >> (most - b))
                yield pa.RecordBatch.from_arrays([pa.array(self.group(t, band, block)), pa.array((i * 2 * self.size + j).astype(np.int32)), *batch.columns[:4]], ["g", "cell", "v", "ids", "v1", "v2"])

    def probes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(group, v, v1, v2, low, tau) for the blocks that each query (v, v1, v2, low) looks into; ``low`` is null in the
        first round."""
        tau = reach(self.dim, len(self.signs), self.target)
        for batch in batches:
            q = self.matrix(batch.column(0))
            x, norm = self.directions(q), _norms(q)
            low = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            for t, (first, second) in enumerate(self.signs):
                y1, y2 = axes(x, first), axes(x, second)
                for n, (_, longest, _) in enumerate(self.bands):
                    (a, b), every = self.cuts[n], np.isnan(low)
                    with np.errstate(all="ignore"):
                        cosine = np.where(every, 0.0, low / norm / longest)
                    cosine = np.where(np.isnan(cosine), 0.0, cosine)
                    level = np.where(cosine > 0, tau[np.clip(cosine * _STEPS, 0, _STEPS).astype(np.int64)], -np.inf)
                    best1, best2 = y1.reshape(len(q), 1 << a, -1).max(2), y2.reshape(len(q), 1 << b, -1).max(2)
                    hit = best1[:, :, None] + best2[:, None, :] >= level[:, None, None]
                    own = np.arange(1 << a)[None, :] == (y1.argmax(1) // (2 * self.size >> a))[:, None]
                    hit = np.where(every[:, None, None], own[:, :, None], hit) & (cosine <= 1 + 1e-9)[:, None, None]
                    row, block = np.nonzero(hit.reshape(len(q), -1))
                    if len(row):
                        at = pa.array(row)
                        yield pa.RecordBatch.from_arrays([pa.array(self.group(t, n, block)), *(c.take(at) for c in batch.columns), pa.array(level[row])], ["g", "v", "v1", "v2", "low", "tau"])

    def scan(self, left: pa.Table, right: pa.Table) -> pa.Table:
        """(q1, q2, v1, v2, ids, score): the k best rows of a block for each of its queries, of the cells that they probe."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            first, second = self.signs[left.column("g")[0].as_py() // self.width // len(self.bands)]
            q, x = self.matrix(left.column("v")), self.matrix(right.column("v"))
            low, tau = (left.column(c).to_numpy().astype(np.float64) for c in ("low", "tau"))
            look = np.isnan(low)
            low = np.where(look, -np.inf, low - 1e-12 * _norms(q) * _norms(x).max())
            cell = right.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            cell, x = cell[order], x[order]
            i, j = cell // (2 * self.size), cell % (2 * self.size)
            for at in range(0, len(q), _BLOCK):
                part = slice(at, at + _BLOCK)
                d = self.directions(q[part])
                y1, y2 = axes(d, first), axes(d, second)
                nearest, top = y1.argmax(1), y2.max(1)
                for start, stop in _runs(i):
                    axis = i[start]
                    able = np.where(look[part], nearest == axis, y1[:, axis] + top >= tau[part])
                    cells = [(start + u, start + w) for u, w in _runs(j[start:stop])]
                    # few vectors a cell: the whole axis is scored at once, and cells are told apart among the hits
                    for u, w in cells if stop - start >= 16 * len(cells) else [(start, stop)]:
                        mine = np.flatnonzero(able & (look[part] | (y1[:, axis] + y2[:, j[u:w]].max(1) >= tau[part]))) if w - u < stop - start else np.flatnonzero(able)
                        if len(mine):
                            value = lambda row, col, u=u, axis=axis, mine=mine: look[part][mine[row]] | (y1[mine[row], axis] + y2[mine[row], j[u + col]] >= tau[part][mine[row]])
                            row, col = _hits(q[part][mine] @ x[u:w].T, low[part][mine], value, self.k + 1)
                            found.append((at + mine[row], u + col))
        row, col = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        score = (q[row] * x[col]).sum(axis=1) if len(row) else np.zeros(0)
        col = order[col] if len(row) else col
        ids = right.column("ids").combine_chunks()
        least = np.array([v[0] for v in right.column("ids").to_pylist()], dtype=np.int64)[col]
        place = np.lexsort((least, -score, row))
        row, col, score = row[place], col[place], score[place]
        keep = np.arange(len(row)) - np.searchsorted(row, row) <= self.k
        a, b = pa.array(row[keep]), pa.array(col[keep])
        return pa.table({"q1": left.column("v1").take(a), "q2": left.column("v2").take(a), "v1": right.column("v1").take(b), "v2": right.column("v2").take(b), "ids": ids.take(b), "score": pa.array(score[keep])})


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the runs of equal values."""
    cut = np.flatnonzero(np.diff(values)) + 1
    edges = [0, *cut.tolist(), len(values)]
    return list(zip(edges, edges[1:], strict=False))


def _norms(x: np.ndarray) -> np.ndarray:
    """Norms of rows, without overflow or underflow on the way."""
    most = np.abs(x).max(axis=1, keepdims=True)
    return most[:, 0] * np.linalg.norm(x / most, axis=1)


def search(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, tables: int = TABLES, target: float = TARGET, chunk: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of vectors(vec_id, embedding) where is_query."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    value = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("vector"), is_query.alias("asks")).filter(usable(F.col("vector")))
    v1, v2 = F.xxhash64("vector").alias("v1"), F.xxhash64(F.lit(1), "vector").alias("v2")
    rows = rows.select("vec_id", "vector", "asks", v1, v2)

    # cut on the map side, too, so a vector that many rows share leaves k + 1 ids a task
    place = F.row_number().over(Window.partitionBy("v1", "v2").orderBy("vec_id"))
    few = rows.select("vec_id", "vector", "v1", "v2").withColumn("place", place).filter(F.col("place") <= k + 1)
    entries = few.groupBy("v1", "v2").agg(F.any_value("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    most = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))).alias("most")
    norm = F.col("most") * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / F.col("most"), F.lit(2.0))))
    entries = entries.select("*", most).withColumn("norm", norm)
    # a band spans a factor of 2**(1/4); equal norms are in one band in spite of rounding
    entries = stored(entries.select("vector", "ids", "v1", "v2", "norm", F.rint(4 * F.log2("norm")).cast("int").alias("band")), "entries")
    found = entries.groupBy("band").agg(F.max("norm").alias("longest"), F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).collect()  # one row a band: the exponents of doubles bound them
    dim = max((r["dim"] for r in found), default=1)
    size = 1 << (dim - 1).bit_length()
    layout = Layout(dim, single, tables, target, k, chunk or max(256, CHUNK_NUMBERS // size), sorted((r["band"], r["longest"], r["n"]) for r in found))
    chunk = layout.chunk

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors as binary values, filled up with zeros."""
        for batch in batches:
            lists = batch.column(0)
            n = np.diff(lists.offsets.to_numpy())
            out = np.zeros((len(lists), dim), kind)
            row = np.repeat(np.arange(len(lists)), n)
            out[row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([_binary(out), *batch.columns[1:]], ["v", *batch.schema.names[1:]])

    index = entries.select("vector", "ids", "v1", "v2", "band").mapInArrow(packed, "v binary, ids array<bigint>, v1 bigint, v2 bigint, band int")
    index = stored(index.mapInArrow(layout.index, "g bigint, cell int, v binary, ids array<bigint>, v1 bigint, v2 bigint"), "index")
    asked = rows.filter("asks").groupBy("v1", "v2").agg(F.any_value("vector").alias("vector"))
    asked = stored(asked.select("vector", "v1", "v2").mapInArrow(packed, "v binary, v1 bigint, v2 bigint"), "asked")
    sizes = stored(index.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / (2 * chunk)).cast("int").alias("xs")), "sizes")
    own = lambda n: F.pmod(F.col("v1"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def looked(queries: DataFrame) -> DataFrame:
        """(q1, q2, v1, v2, ids, score), each pair once: what the scan finds for queries(v, v1, v2, low)."""
        probes = stored(queries.select("v", "v1", "v2", "low").mapInArrow(layout.probes, "g bigint, v binary, v1 bigint, v2 bigint, low double, tau double"), "probes")
        chunks = stored(probes.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("qs")).join(sizes, "g"), "chunks")
        left = probes.join(chunks, "g").withColumn("q", own("qs")).withColumn("x", every("xs")).select("g", "q", "x", "v", "v1", "v2", "low", "tau")
        right = index.join(chunks, "g").withColumn("x", own("xs")).withColumn("q", every("qs")).select("g", "q", "x", "cell", "v", "v1", "v2", "ids")
        pairs = left.groupBy("g", "q", "x").cogroup(right.groupBy("g", "q", "x")).applyInArrow(lambda queries, entries: layout.scan(queries, entries), "q1 bigint, q2 bigint, v1 bigint, v2 bigint, ids array<bigint>, score double")
        return pairs.repartition("q1", "q2").dropDuplicates(["q1", "q2", "v1", "v2"])

    of_query = Window.partitionBy("q1", "q2").orderBy(F.col("score").desc(), F.col("ids")[0])
    best = lambda pairs: pairs.withColumn("place", F.row_number().over(of_query)).filter(F.col("place") <= k + 1)
    # k + 1, as one of the ids may be the query's own
    first = stored(best(looked(asked.withColumn("low", F.lit(None).cast("double")))), "first")
    low = first.filter(F.col("place") == k + 1).select(F.col("q1").alias("v1"), F.col("q2").alias("v2"), F.col("score").alias("low"))
    second = looked(asked.join(low, ["v1", "v2"], "left").withColumn("low", F.coalesce("low", F.lit(float("-inf")))))
    both = second.unionByName(first.drop("place")).dropDuplicates(["q1", "q2", "v1", "v2"])
    lists = best(both).groupBy("q1", "q2").agg(F.collect_list(F.struct("v1", "v2", "score", "ids")).alias("near"))

    same = (F.col("v1") == F.col("q1")) & (F.col("v2") == F.col("q2"))
    own_id = lambda e: (e["v1"] == F.col("v1")) & (e["v2"] == F.col("v2"))
    at = lambda e: F.array_position(e["ids"], F.col("query_id"))
    # a query's own id is left out of its own vector's ids once
    without = lambda e: F.when(own_id(e) & (at(e) > 0), F.filter(e["ids"], lambda x, i: i + 1 != at(e))).otherwise(F.slice(e["ids"], 1, k + 1))
    each = F.flatten(F.transform("near", lambda e: F.transform(without(e), lambda x: F.struct((-e["score"]).alias("minus"), x.alias("vec_id")))))
    queries = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "v1", "v2")
    top = queries.join(lists, same).select("query_id", F.slice(F.array_sort(each), 1, k).alias("top"))
    out = top.select("query_id", F.posexplode("top").alias("i", "e"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.minus")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: rows of ``embeddings`` with an id divisible by 20 against all rows."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
