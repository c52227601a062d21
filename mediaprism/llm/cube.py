"""Mixing sources to target weights by balanced sampling (the cube method).

Targets: sources by code point, null last, weigh 1, 2, 3, 1, ... and share the total size; a target stops at
``max_repeats`` times its source's size, and what is cut off is shared again by weight.  Each document of a source is
taken whole ``floor(target / size)`` times, and once more with the fractional rest as its inclusion probability.

Flight: a source's documents are dealt into blocks of about ``block`` rows by a hash.  In a block, three undecided
documents at a time move along the null space of the constraints "number of documents" and "number of words", until at
least one of them is decided; two or fewer stay undecided at the end, and every 16th document of a block does not fly yet.
The undecided ones of all blocks fly in the next level, until one block a source is left.  Landing: the last two or fewer
documents of a source take the decision that brings its words nearest to the target; if they are long ones, single
decisions of the last block are flipped until no flip brings the words nearer.  So a source misses its target by a few
words where it has short documents, whatever its size, and no block holds more than a bounded number of rows.

The last step ("repair") gives up a little of the balance for the words: it flips at most 64 decisions a source, by a rule
that looks at sizes only.

Repeated rows (same id, source and text) fly as one unit: of m rows with inclusion probability p, floor(m * p) are taken,
one has the rest as its probability, and the others are left out, which keeps both sums.  So a row that a third of the table
repeats is one entry of one block.  All random choices come from hashes of ids and sizes, so that reruns agree.  Null texts
have size 0; a null source is a source of its own.  An empty table gives an empty result; sources without words have target
0 and ratio 0.  Other columns are not looked at.

Targets of up to ``MAX_SOURCES`` sources are computed on the driver; beyond, the sources are ranked and filled up by
DataFrame operations, and joined by shuffle.  Both ways give the same targets.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, stored, table

WEIGHTS, MAX_REPEATS, BLOCK, HOLD = (1.0, 2.0, 3.0), 3.0, 1000, 16
MAX_SOURCES, SPREAD = 200_000, 10_000
_CLOSE = 1e-9


def size_of(text: Column) -> Column:
    """The number of words, without building them: runs of separators shrink to one, then the separators are counted."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def targets(sizes: dict, max_repeats: float = MAX_REPEATS, weights: tuple[float, ...] = WEIGHTS) -> dict:
    """source -> target for source -> size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), list(names), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] > max_repeats * sizes[s]]
        if not full:
            return out | {s: share * weight[s] for s in free}
        out |= {s: max_repeats * sizes[s] for s in full}
        left -= sum(max_repeats * sizes[s] for s in full)
        free = [s for s in free if s not in full]
    return out


def _mixed(seed: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit seeds."""
    x = seed.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def fly(p: list[float], size: list[int], chance: list[float]) -> list[float]:
    """The flight of one block: at most two entries of the result lie strictly between 0 and 1; the sums of p and of
    p * size stay."""
    p, live = list(p), []
    for k in range(len(p)):
        if not _CLOSE < p[k] < 1 - _CLOSE:
            p[k] = float(round(p[k]))
            continue
        live.append(k)
        if len(live) < 3:
            continue
        i, j, m = live
        u = (float(size[m] - size[j]), float(size[i] - size[m]), float(size[j] - size[i]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / d if d > 0 else -p[x] / d for x, d in zip(live, u, strict=True) if d)
        down = min(p[x] / d if d > 0 else (p[x] - 1) / d for x, d in zip(live, u, strict=True) if d)
        step = up if chance[k] * (up + down) < down else -down
        for x, d in zip(live, u, strict=True):
            p[x] += step * d
            if not _CLOSE < p[x] < 1 - _CLOSE:
                p[x] = float(round(p[x]))
        live = [x for x in live if 0 < p[x] < 1]
    return p


def land(p: list[float], size: list[int], owed: float) -> list[float]:
    """Decides the last undecided units so that their words come nearest to ``owed`` (smaller sums win ties)."""
    live = [k for k in range(len(p)) if 0 < p[k] < 1]
    best = min(range(1 << len(live)), key=lambda m: (abs(sum(size[k] for i, k in enumerate(live) if m >> i & 1) - owed), m))
    out = list(p)
    for i, k in enumerate(live):
        out[k] = float(best >> i & 1)
    return out


def repair(p: list[float], size: list[int], owed: float) -> list[float]:
    """Flips decided units until their words are as near to ``owed`` as single flips bring them: each flip takes the unit
    whose size is nearest to what is missing or too much, and halves it or better on most data."""
    out, off = list(p), sum(a * b for a, b in zip(p, size, strict=True)) - owed
    sides = {v: sorted((size[k], k) for k in range(len(p)) if out[k] == v and size[k]) for v in (0.0, 1.0)}
    for _ in range(64):
        units = sides[1.0 if off > 0 else 0.0]
        at = bisect_left(units, (abs(off), -1))
        near = min(units[max(0, at - 1) : at + 1], key=lambda u: abs(u[0] - abs(off)), default=None)
        if near is None or abs(abs(off) - near[0]) >= abs(off):
            break
        units.remove(near)
        out[near[1]] = 1.0 - out[near[1]]
        insort(sides[out[near[1]]], near)
        off += near[0] if out[near[1]] else -near[0]
    return out


def _flown(frame: pd.DataFrame, level: int, last: bool) -> pd.DataFrame:
    """A block: new probabilities p; rows are put in an order that depends on their content only, large sizes first.  All
    but the last flights leave every 16th unit, by a hash of it and the level, for the next one, so that it has small units
    to land with."""
    frame = frame.sort_values(["size", "unit", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    before, size, chance = frame["p"].tolist(), frame["size"].tolist(), _mixed(frame["unit"].to_numpy())
    flies = np.flatnonzero(last | (_mixed(frame["unit"].to_numpy() ^ (0x5DEECE66D * (level + 1))) >= 1 / HOLD)).tolist()
    p = list(before)
    for k, x in zip(flies, fly([before[k] for k in flies], [size[k] for k in flies], [chance[k] for k in flies]), strict=True):
        p[k] = x
    if last:
        p = land(p, size, sum(a * b for a, b in zip(p, size, strict=True) if 0 < a < 1))
        p = repair(p, size, sum(a * b for a, b in zip(before, size, strict=True)))
    return frame.assign(p=p)


def _flight(level: int, last: bool):
    def flown(frame: pd.DataFrame) -> pd.DataFrame:
        return _flown(frame.drop(columns="dealt"), level, last)

    return flown


def _targets_table(known: DataFrame, max_repeats: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, size, n, target) by DataFrame operations, for any number of sources(source, size, n).

    Sources are ranked by ranges, whose counts are summed up.  A target is the smaller of its cap and of its weight times a
    level that rises round by round, as capped sources pass on what they can't take, until no further source is full."""
    ranged = known.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "sources")  # stored: a second run of the ranges could cut them elsewhere
    counts = ranged.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select("part", before.alias("before")))  # a row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int"))
    rows = ranged.join(counts, "part").withColumn("weight", weight).withColumn("cap", F.col("size") * F.lit(float(max_repeats)))
    rows = stored(rows.select("source", "size", "n", "weight", "cap"), "weights")
    total, level, full = rows.agg(F.sum("size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        capped, free, now = rows.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if now == full or not free:
            break
        level, full = (total - (capped or 0.0)) / free, now
    return rows.select("source", "size", "n", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _units(docs: DataFrame, max_repeats: float, block: int, weights: tuple[float, ...], max_sources: int) -> DataFrame:
    """(doc_id, source, unit, size, source_size, target, m, whole, sure, p): every distinct row, its number m, and p decided:
    each of the m is taken ``whole`` times, ``sure`` of them once more, and one of the rest once more if p is 1."""
    unit = F.xxhash64("doc_id", "source", "text")
    rows = docs.select("doc_id", "source", unit.alias("unit"), size_of(F.col("text")).alias("size"))
    rows = stored(rows.groupBy("doc_id", "source", "unit", "size").agg(F.count(F.lit(1)).alias("m")), "sizes")
    known = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size"), F.count(F.lit(1)).alias("n"))
    some = known.limit(max_sources + 1).collect()  # at most max_sources + 1 narrow rows
    if len(some) <= max_sources:
        goal = targets({r["source"]: r["size"] for r in some}, max_repeats, weights)
        facts = docs.sparkSession.createDataFrame([(r["source"], r["size"], r["n"], float(goal[r["source"]])) for r in some], "source string, size bigint, n bigint, target double")
        facts = F.broadcast(facts)
    else:
        facts = _targets_table(known, max_repeats, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    facts = facts.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", F.greatest(F.lit(1), F.floor(F.col("n") / block)).alias("blocks"))
    facts = facts.withColumn("ratio", ratio).withColumn("whole", F.floor(F.col("ratio") + _CLOSE).cast("int"))
    left = rows.join(facts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rest = F.col("m") * F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole"))
    left = left.withColumn("sure", F.floor(rest + _CLOSE)).withColumn("p", F.greatest(F.lit(0.0), rest - F.col("sure"))).drop("ratio")
    names = ["doc_id", "source", "unit", "size", "source_size", "target", "m", "whole", "sure", "p", "blocks"]
    schema = ", ".join(f"{x} {docs.schema['doc_id'].dataType.simpleString() if x == 'doc_id' else 'string' if x == 'source' else 'double' if x in ('target', 'p') else 'int' if x == 'whole' else 'bigint'}" for x in names)
    left = left.select(*names)
    largest = lambda df: df.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    most, done, level = largest(rows), [], 0
    while True:
        last, seed = most <= block, level
        n = F.lit(1) if last else F.greatest(F.lit(1), F.floor(F.col("blocks") / F.lit(float(HOLD - 1) ** level)))
        dealt = left.withColumn("dealt", F.pmod(F.xxhash64(F.lit(seed), "unit", "doc_id"), n)).groupBy("source", "dealt")
        flown = stored(dealt.applyInPandas(_flight(level, last), schema), "flown")
        done.append(flown.filter("p = 0 OR p = 1"))
        if last:
            break
        left, level = flown.filter("p > 0 AND p < 1"), level + 1
        most = largest(left)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("blocks")


def _times(df: DataFrame, count: str, out: str) -> DataFrame:
    """Each row ``count`` times, numbered from 0 in ``out``; rows of very many are dealt over tasks first."""
    few = df.filter(F.col(count) <= SPREAD).withColumn(out, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    many = df.filter(F.col(count) > SPREAD)
    many = many.withColumn("__from", F.explode(F.sequence(F.lit(0), F.col(count) - 1, F.lit(SPREAD)))).repartition(F.col("__from"))
    many = many.withColumn(out, F.explode(F.sequence(F.col("__from"), F.least(F.col(count), F.col("__from") + SPREAD) - 1))).drop("__from")
    return few.unionByName(many)


def mix(docs: DataFrame, max_repeats: float = MAX_REPEATS, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, max_sources: int = MAX_SOURCES) -> DataFrame:
    """(doc_id, source, unit, size, source_size, target, copies, taken) for every row of docs(doc_id, text, source).

    ``unit`` is a hash of id, source and text.
    """
    out = _times(_units(docs, max_repeats, block, weights, max_sources), "m", "i")
    more = F.when(F.col("i") < F.col("sure"), 1).when(F.col("i") == F.col("sure"), F.col("p")).otherwise(0)
    copies = (F.col("whole") + more).cast("int")
    return out.select("doc_id", "source", "unit", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"))


def repeat_documents(docs: DataFrame, max_repeats: float = MAX_REPEATS, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, max_sources: int = MAX_SOURCES) -> DataFrame:
    """Each row of docs as often as the mix takes it; all columns are kept.  Rows that share id, source and text count as one
    row that comes as often as all of them; columns beside these are those of any of them."""
    units = _units(docs, max_repeats, block, weights, max_sources)
    number = (F.col("m") * F.col("whole") + F.col("sure") + F.col("p")).cast("bigint")
    wanted = stored(units.select(F.col("doc_id").alias("__id"), F.col("unit").alias("__unit"), "m", number.alias("__copies")).filter("__copies > 0"), "copies")
    tagged = docs.withColumn("__u", F.xxhash64("doc_id", "source", "text"))
    if not wanted.filter("m > 1").isEmpty():
        tagged = tagged.dropDuplicates(["doc_id", "__u"])
    joined = tagged.join(wanted.drop("m"), tagged["doc_id"].eqNullSafe(wanted["__id"]) & (tagged["__u"] == wanted["__unit"]))
    return _times(joined, "__copies", "__k").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all rows of ``documents``."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
