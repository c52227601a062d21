"""Duplicates of media rows, and size variants of one picture.

The best row of a key is found by aggregation: ``max_by`` keeps one row a key on the map side already, so a key that a
third of all rows share costs one small row a partition.  The input's order is the ordinal ``ord``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..functions.urls import Url, dedupe_key, domain, is_data_url, normalize, with_url

STRATEGIES = ("exact", "normalized", "path", "filename", "smart")


@dataclass(frozen=True)
class DedupeOptions:
    """``key`` replaces the strategy; unknown strategies count as ``normalized``, ``simple`` as ``exact``."""

    strategy: str = "normalized"
    keep_first: bool = True
    prefer_with_dimensions: bool = False
    preferred_domains: tuple[str, ...] = ()
    preferred_sources: tuple[str, ...] = ()
    key: Callable[[Url], Column] | None = None


def filename_key(url: Url) -> Column:
    """The lower-case last path segment; empty for folders."""
    name = F.lower(F.element_at(F.split(url.part("path"), "/"), -1))
    return F.when(is_data_url(url.raw), url.raw).when(~url.ok, F.lower(url.raw)).otherwise(name)


def smart_key(url: Url) -> Column:
    """Host, the last two folders, and the name without extension and size marks."""
    parts = F.split(F.lower(url.part("path")), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    context = F.array_join(F.slice(folders, F.greatest(F.size(folders) - 1, F.lit(1)), F.lit(2)), "/")
    base = F.regexp_replace(F.element_at(parts, -1), r"(?s)\.[^.]+\z", "")
    base = reduce(lambda c, p: F.regexp_replace(c, p, ""), T.BASE_NAME_SUFFIXES, base)
    whole = F.concat(url.part("host"), F.lit("/"), context, F.lit("/"), base)
    return F.when(is_data_url(url.raw), url.raw).when(~url.ok, normalize(url)).otherwise(whole)


def key_of(url: Url, strategy: str = "normalized") -> Column:
    if strategy in ("exact", "simple"):
        return url.raw
    return {"path": dedupe_key, "filename": filename_key, "smart": smart_key}.get(strategy, normalize)(url)


def score(options: DedupeOptions, url: Url, columns: list[str]) -> Column:
    """How good a row is; columns that are missing count as null."""
    col = lambda name: F.col(name) if name in columns else F.lit(None)
    out = F.lit(0)
    if options.prefer_with_dimensions:
        pixels = col("width").cast("double") * col("height").cast("double")
        out += F.when(pixels.isNotNull(), 10 + F.least(F.lit(20), F.floor(pixels / 100_000).cast("int"))).otherwise(0)
    for names, value, most, step in ((options.preferred_domains, domain(url), 50, 5), (options.preferred_sources, col("source"), 30, 3)):
        if names:
            rank = F.array_position(F.array(*map(F.lit, names)), value)
            out += F.when(rank > 0, most - (rank - 1) * step).otherwise(0).cast("int")
    for name in ("filename", "mime_type"):
        out += F.when(F.coalesce(col(name).cast("string"), F.lit("")) != "", 5).otherwise(0)
    out += F.when(F.coalesce(col("file_size").cast("long"), F.lit(0)) != 0, 5).otherwise(0)
    return out + F.when(col("status") == "safe", 20).when(col("status") == "quarantined", 5).otherwise(0)


def deduplicate(df: DataFrame, options: DedupeOptions | None = None, url: Url | None = None, key: str | None = None) -> DataFrame:
    """The best row of each key: highest score, then first (or last) in order.  ``key`` names a ready key column."""
    options, url = options or DedupeOptions(), url or Url("url")
    value = F.col(key) if key else options.key(url) if options.key else key_of(url, options.strategy)
    points, row = score(options, url, df.columns), F.struct(*df.columns)
    # ``ord`` may be of any ordered type, such as a struct of source, page and place
    best = F.min_by(row, F.struct((-points).alias("points"), F.col("ord"))) if options.keep_first else F.max_by(row, F.struct(points.alias("points"), F.col("ord")))
    return df.withColumn("__key", value).groupBy("__key").agg(best.alias("__row")).select("__row.*")


def find_duplicates(df: DataFrame, strategy: str = "normalized", url: Url | None = None) -> DataFrame:
    """(key, n, first) of keys with more than one row; ``duplicate_rows`` has the rows themselves."""
    groups = df.groupBy(key_of(url or Url("url"), strategy).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return groups.filter("n > 1")


def duplicate_rows(df: DataFrame, strategy: str = "normalized", url: Url | None = None) -> DataFrame:
    """The rows of keys with more than one row, with the key and the number of its rows.  The counts are joined back, so a
    key of any number of rows is never in one place."""
    keyed = df.withColumn("duplicate_key", key_of(url or Url("url"), strategy))
    groups = keyed.groupBy("duplicate_key").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    return keyed.join(groups, "duplicate_key").select(*df.columns, "duplicate_key", "n_rows")


def count_duplicates(df: DataFrame, strategy: str = "normalized", url: Url | None = None) -> DataFrame:
    """One row: how many rows are more than one a key.  Counted by groups, so no key is held in memory."""
    groups = df.groupBy(key_of(url or Url("url"), strategy).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


# ---- size variants -------------------------------------------------------------------------------------------------


def stripped_url(url: Column) -> Column:
    """The first 2048 characters without the first match of each size pattern."""
    # a lazy prefix makes a replace-all replace once
    once = lambda c, p: F.regexp_replace(c, f"(?s)^(.*?)(?:{p})", "$1")
    return reduce(once, T.VARIANT_PATTERNS, F.substring(url, 1, 2048))


def with_variant_key(df: DataFrame, url: Url | None = None) -> DataFrame:
    """Adds host and normal form of the stripped URL: variants share both."""
    url = url or Url("url")
    df = with_url(df.withColumn("__stripped", stripped_url(url.raw)), "__stripped")
    return df.withColumn("variant_host", domain(url)).withColumn("variant_key", normalize(Url("__stripped"))).drop("__stripped", "__stripped_parts", "__stripped_parts_params")


def same_ratio(a: Column, b: Column) -> Column:
    """Aspect ratios within 10 %, or one unknown."""
    return F.coalesce(F.try_divide(F.abs(a - b), F.greatest(a, b)) <= 0.1, F.lit(True))


def is_size_variant(a: Url, b: Url, width_a: Column, height_a: Column, width_b: Column, height_b: Column) -> Column:
    """Whether two URLs name one medium in two sizes.  The columns of ``a`` and ``b`` hold stripped URLs (``stripped_url``),
    parsed by ``with_url``."""
    return (domain(a) == domain(b)) & (normalize(a) == normalize(b)) & same_ratio(F.try_divide(width_a, height_a), F.try_divide(width_b, height_b))


def group_size_variants(df: DataFrame, url: Url | None = None) -> DataFrame:
    """Adds ``variant``: the ordinal of the group's first row.  In order, a row joins the first earlier group seed that it
    is a variant of.  Ratios decide within a key; rows of one key and one ratio are one entry there, so a key's work grows
    with its distinct ratios, not its rows."""
    df = with_variant_key(df, url)  # once: the joins below go back to these rows
    keys = ["variant_host", "variant_key"]
    ratio = F.coalesce(F.try_divide(F.col("width"), F.col("height")), F.lit(-1.0)).alias("ratio")
    entries = df.withColumn("__ratio", ratio).groupBy(*keys, "__ratio").agg(F.min("ord").alias("first"))

    def seeds(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("first")
        found: list[tuple[float, int]] = []
        out = []
        for r, first in zip(frame["__ratio"], frame["first"], strict=True):
            seed = next((s for q, s in found if r < 0 or q < 0 or max(r, q) == 0 or abs(r - q) / max(r, q) <= 0.1), None)
            if seed is None:
                found.append((r, first))
                seed = first
            out.append(seed)
        return frame.assign(variant=out)

    schema = f"variant_host string, variant_key string, __ratio double, first {df.schema['ord'].dataType.simpleString()}, variant {df.schema['ord'].dataType.simpleString()}"
    # keys with one ratio, nearly all, need no Python
    several = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    entries = entries.join(several, keys)
    single = entries.filter("__n = 1").select(*keys, "__ratio", F.col("first").alias("variant"))
    named = single.unionByName(entries.filter("__n > 1").drop("__n").groupBy(*keys).applyInPandas(seeds, schema).drop("first"))
    return df.withColumn("__ratio", ratio).join(named, [*keys, "__ratio"]).drop("__ratio")


def keep_largest_variants(df: DataFrame, url: Url | None = None) -> DataFrame:
    """The first row with the most pixels of each group of size variants."""
    pixels = F.coalesce(F.col("width"), F.lit(0.0)) * F.coalesce(F.col("height"), F.lit(0.0))
    grouped = group_size_variants(df, url)
    best = grouped.groupBy("variant").agg(F.max_by(F.struct(*df.columns), F.struct(pixels, -F.col("ord"))).alias("__row"))
    return best.select("__row.*")
