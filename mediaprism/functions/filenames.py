"""File names and extensions of URLs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables as T
from .urls import Url, decode_component, first_value, is_data_url, let


def lookup(table: dict[str, str], key: Column) -> Column:
    """A value of a small constant table, or null."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def last_segment(url: Url) -> Column:
    """The last non-empty segment of the decoded path; empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter(F.split(decode_component(url.part("path")), "/"), lambda s: s != ""), F.lit(-1)), F.lit(""))


def trim_all(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s﻿]+|[\s﻿]+\z", "")


def sanitize_filename(name: Column, max_length: int | Column = 200) -> Column:
    """Invalid characters become _, outer spaces and dots go, runs of _ and - become one _, reserved names get a _ in
    front; never empty."""
    most = F.lit(max_length) if isinstance(max_length, int) else max_length
    s = F.regexp_replace(F.substring(F.coalesce(name, F.lit("")), F.lit(1), most * 2), r'[<>:"/\\|?*\x00-\x1f]', "_")
    s = F.regexp_replace(F.regexp_replace(trim_all(s), r"^\.{1,100}|\.{1,100}\z", ""), r"[_-]{1,100}", "_")
    s = let(s, lambda c: F.concat(F.when(F.upper(F.substring_index(c, ".", 1)).isin(*T.RESERVED_NAMES), "_").otherwise(""), c))
    return let(F.substring(s, F.lit(1), most), lambda c: F.when(c == "", "file").otherwise(c))


def filename(url: Url) -> Column:
    """The sanitized name without its extension; ``file`` if there is none."""
    stem = let(last_segment(url), lambda x: F.when(x.rlike(r"(?s)^.+\."), F.regexp_replace(x, r"(?s)\.[^.]*\z", "")).otherwise(x))
    return F.when(is_data_url(url.raw) | ~url.ok, "file").otherwise(sanitize_filename(stem))


def extension_of_data_url(url: Column) -> Column:
    return F.coalesce(lookup(T.DATA_URL_EXTENSION, F.lower(F.regexp_extract(url, "^data:([^;,]+)", 1))), F.lit(""))


def extension(url: Url) -> Column:
    """Lower-case letters and digits after the last dot of the last segment (10 at most), else a format parameter."""
    names = F.array(*map(F.lit, ("format", "f", "ext", "type")))
    named = F.get(F.filter(F.transform(names, lambda n: first_value(url.params, n)), lambda v: v != ""), F.lit(0))
    asked = F.when(F.size(url.params) > 0, let(named, lambda v: F.when(v.rlike(r"^[A-Za-z0-9]{1,10}\z"), F.lower(v))))
    own = lambda last: F.nullif(F.lower(F.regexp_extract(last, r"(?s)^.+\.([A-Za-z0-9]{1,10})\z", 1)), F.lit(""))
    found = let(last_segment(url), lambda last: F.when(last == "", "").otherwise(F.coalesce(own(last), asked, F.lit(""))))
    return F.when(is_data_url(url.raw), extension_of_data_url(url.raw)).when(~url.ok, "").otherwise(found)


def filename_and_extension(url: Url) -> Column:
    return F.struct(filename(url).alias("filename"), extension(url).alias("extension"))


def clean_extension(ext: Column) -> Column:
    return F.lower(F.regexp_replace(ext, "[^A-Za-z0-9]", ""))


def sanitize_full_filename(name: Column, ext: Column, max_length: int = 200) -> Column:
    base, clean = sanitize_filename(name, F.lit(max_length - 1) - F.length(ext)), clean_extension(ext)
    return F.when(clean == "", base).otherwise(F.concat(base, F.lit("."), clean))


def generate_filename(url: Url) -> Column:
    return sanitize_full_filename(filename(url), extension(url))


def has_path_traversal(name: Column) -> Column:
    return F.coalesce(F.contains(name, F.lit("..")) | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")) | name.startswith("~"), F.lit(False))


def normalize_extension(ext: Column) -> Column:
    return let(F.regexp_replace(F.lower(F.coalesce(ext, F.lit(""))), r"^\.+", ""), lambda x: F.coalesce(lookup(T.EXTENSION_ALIASES, x), x))


def is_image_extension(ext: Column) -> Column:
    return normalize_extension(ext).isin(*T.IMAGE_EXTENSIONS)


def is_video_extension(ext: Column) -> Column:
    return normalize_extension(ext).isin(*T.VIDEO_EXTENSIONS)


def is_audio_extension(ext: Column) -> Column:
    return normalize_extension(ext).isin(*T.AUDIO_EXTENSIONS)


def is_document_extension(ext: Column) -> Column:
    return normalize_extension(ext).isin(*T.DOCUMENT_EXTENSIONS)


def make_unique(df: DataFrame, name: str, ext: str, order: str = "ord", out: str = "unique_name", parts: int = 64) -> DataFrame:
    """Names that are unique without regard to letter case.

    The first row of a name keeps it; later ones, by the numeric column ``order``, get _1, _2, ... before the extension.
    Where numbers up to their count are taken by other rows' own names (``a_1`` beside two ``a``), counting starts above the
    highest number taken.  Numbered names of two different names never meet, so the result is unique however many rows
    share one.  Rows are ranked within ``parts`` ranges of ``order``, whose counts are then summed up, so a name that a
    third of all rows share is spread over that many groups.
    """
    base, clean = sanitize_filename(F.col(name)), clean_extension(F.coalesce(F.col(ext), F.lit("")))
    full = lambda stem: F.when(F.col("__e") == "", stem).otherwise(F.concat(stem, F.lit("."), F.col("__e")))
    edges = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.2 / parts)  # parts numbers
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e < F.col(order))) if edges else F.lit(0)
    rows = df.withColumn("__b", base).withColumn("__e", clean)
    rows = rows.withColumns({"__own": F.lower(full(F.col("__b"))), "__part": F.coalesce(part, F.lit(0))})

    numbered = r"^(.*)_([1-9][0-9]{0,17})(\.[a-z0-9]+)?\z"
    counts = rows.groupBy("__own", "__part").agg(F.count(F.lit(1)).alias("__n"))
    number = F.expr(f"try_cast(regexp_extract(__own, r'{numbered}', 2) AS bigint)")
    taken = counts.select(F.regexp_replace("__own", numbered, "$1$3").alias("__own"), number.alias("k")).filter("k IS NOT NULL")
    taken = taken.groupBy("__own").agg(F.min("k").alias("__least"), F.max("k").alias("__most"))
    of_name = Window.partitionBy("__own")
    before = F.sum("__n").over(of_name.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__own", "__part", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(of_name).alias("__all")).join(taken, "__own", "left")
    above = F.when(F.col("__least") < F.col("__all"), F.col("__most")).otherwise(0)
    counts = counts.select("__own", "__part", "__before", F.coalesce(above, F.lit(0)).alias("__above"))

    rank = F.row_number().over(Window.partitionBy("__own", "__part").orderBy(order)) - 1
    rows = rows.withColumn("__k", rank).join(counts, ["__own", "__part"]).withColumn("__k", F.col("__k") + F.col("__before"))
    new = full(F.when(F.col("__k") == 0, F.col("__b")).otherwise(F.concat("__b", F.lit("_"), F.col("__above") + F.col("__k"))))
    return rows.select(*df.columns, new.alias(out))
