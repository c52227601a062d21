"""Quality rules with host verdicts.  DataFrame operations only.

Base rules look at one document; the method then looks at its host (``source``): failures are counted by host, and each
host's failure rate is shrunk with a beta prior that is fitted to all hosts by moments.  A host is bad, and none of its
documents kept, if its shrunk rate has more than ``max_odds`` times the odds of the prior's mean.  So the limit moves with
the corpus: where one document in ten fails, hosts above 31 in a hundred go; where most fail, only hosts that are far worse
still go; where none or all fail, no host does.  A host of few documents is drawn to the mean and needs clear evidence.

Null or empty texts have no words and fail the base rules.  A null host is a host of its own.  Repeated rows are counted
and returned as often as they come.  An empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stored, table, words

MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW, MAX_ODDS = 20, 30, 8, 4.0
#: Host verdicts are broadcast up to so many hosts (under 20 MB); beyond, they are joined by shuffle.
BROADCAST_HOSTS = 200_000


def n_repeated(found: Column, size: int = WINDOW) -> Column:
    """How many words lie in ``size``-word windows that occur twice or more in the array ``found``.

    Windows are compared by a chained 64-bit hash of their words.  Their hashes are sorted with their places, so a text
    of n words costs n log n, whatever repeats in it.
    """
    hashes = F.when(F.size(found) >= size, F.transform(F.sequence(F.lit(1), F.size(found) - (size - 1)), lambda i: F.xxhash64(F.slice(found, i, size)))).otherwise(F.array().cast("array<bigint>"))
    pairs = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(p: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
        places = F.array_sort(F.transform(F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
        start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(size), i - a["last"])).alias("n")), lambda a: a["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs(h), covered)))


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the base columns of every row of docs(doc_id, text, source)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        "doc_id", "source",
        let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), n_repeated(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    out = counted.select("doc_id", "source", F.col("w.n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def host_verdicts(counts: DataFrame, max_odds: float = MAX_ODDS) -> DataFrame:
    """(source, n_docs, n_failed, rate, bad) by host.

    The prior beta(a, b) has the mean of all documents and the variance between the hosts' rates that is left after
    their binomial variance; its weight a + b stays between 1 and 10000.  ``bad`` compares odds: r / (1 - r) with those of the mean.
    """
    hosts = stored(counts.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    n, f, square, k = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.sum(F.col("n_docs") * rate * rate), F.count(F.lit(1))).first()
    mean = f / n if n else 0.0
    inside = mean * (1 - mean)
    between = max((square / n - mean * mean) - inside * k / n, 0.0) if n else 0.0
    weight = min(max(inside / between - 1, 1.0), 10_000.0) if between > 0 else 10_000.0
    shrunk = (F.col("n_failed") + F.lit(weight * mean)) / (F.col("n_docs") + F.lit(weight))
    bad = shrunk * (1 - mean) > max_odds * mean * (1 - shrunk)
    return hosts.select("source", "n_docs", "n_failed", shrunk.alias("rate"), bad.alias("bad"))


def quality_rules(docs: DataFrame, max_odds: float = MAX_ODDS) -> DataFrame:
    """Counts, base_failed and kept of every row of docs(doc_id, text, source)."""
    counts = stored(document_counts(docs), "counts")
    hosts = host_verdicts(counts, max_odds).filter("bad").select(F.col("source").alias("host"), "bad")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    joined = counts.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("bad").isNull()).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every row of ``documents``, whole texts."""
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT k, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT k, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)
), rep AS (
  SELECT k, count(DISTINCT i + o) AS n FROM (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, s) > 1), (SELECT unnest(generate_series(0, 7)) AS o) GROUP BY k
), c AS (
  SELECT d.k, doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep ON d.k = rep.k
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
), h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source
), g AS (SELECT sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) AS sq, count(*) / sum(n) AS kn FROM h
), v AS (SELECT m, greatest(sq - m * m - m * (1 - m) * kn, 0) AS bt FROM g
), wt AS (SELECT m, CASE WHEN bt > 0 THEN least(greatest(m * (1 - m) / bt - 1, 1), 10000) ELSE 10000 END AS wgt FROM v
), bad AS (SELECT source FROM h, wt WHERE (f + wgt * m) / (n + wgt) * (1 - m) > 4 * m * (1 - (f + wgt * m) / (n + wgt)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM b.source) AS kept FROM b
"""
