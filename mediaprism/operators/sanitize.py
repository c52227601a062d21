"""Cleaning of URLs, file names and HTML, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import filenames
from ..functions.urls import Url, barrier, decode_component, encoded_params, is_data_url, is_javascript_url, with_url

_CONTROL = r"[\x00-\x1f\x7f]"
_BIDI = r"[‎‏‪-‮⁦-⁩]"
_UNSAFE = {"<": "%3C", ">": "%3E", '"': "%22", "{": "%7B", "}": "%7D", "|": "%7C", "\\": "%5C", "^": "%5E", "`": "%60", "[": "%5B", "]": "%5D"}


def strip_tracking(url: Url) -> Column:
    """Without tracking parameters; also re-serialized.  What can't be parsed stays as it is."""
    kept = F.filter(url.params, lambda p: ~F.lower(p["k"]).isin(*T.TRACKING_PARAMS))
    p = url.part
    before = F.regexp_extract(p("href"), r"^([^?#]*)", 1)
    query = encoded_params(kept)
    stripped = F.concat(before, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), p("hash"))
    return F.when(~url.ok, url.raw).when(F.size(kept) == F.size(url.params), p("href")).otherwise(stripped)


def with_sanitized_url(df: DataFrame, url: str, out: str = "sanitized", allow_data_urls: bool = False, allow_javascript_urls: bool = False, strip: bool | None = None, max_length: int = 8192, strip_tracking: bool = True) -> DataFrame:
    """Adds the cleaned URL, or null if it is rejected: script URLs (decoded ones, too), data URLs unless allowed and well
    formed, and URLs that are too long."""
    trimmed = F.regexp_replace(filenames.trim_all(F.col(url)), _CONTROL, "")
    df = df.withColumn("__clean", F.regexp_replace(trimmed, _BIDI, ""))
    c = F.col("__clean")
    bad = (F.coalesce(F.col(url), F.lit("")) == "") | (F.length(c) > max_length)
    if not allow_javascript_urls:
        bad |= is_javascript_url(c) | is_javascript_url(decode_component(c))
    bad |= is_data_url(c) & (~c.rlike(r"(?i)^data:[a-z]+/[a-z0-9.+-]+[;,]") if allow_data_urls else F.lit(True))
    safe = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), _UNSAFE.items(), c)
    df = df.withColumn("__clean", barrier(F.when(~bad, safe)))
    if strip_tracking if strip is None else strip:
        df = with_url(df, "__clean")
        short = globals()["strip_tracking"](Url("__clean"))
        df = df.withColumn("__clean", F.when(is_data_url(F.col("__clean")), F.col("__clean")).when(F.col("__clean").isNotNull(), short)).drop("__clean_parts", "__clean_parts_params")
    return df.withColumn(out, F.col("__clean")).drop("__clean")


def sanitize_filename(name: Column, max_length: int = 255, replacement: str = "_", preserve_unicode: bool = True) -> Column:
    """The base cleaning, then control and bidi characters, collapsed and trimmed replacements, and a cap that keeps the
    extension; never empty."""
    mark = re.escape(replacement)
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    s = F.regexp_replace(F.regexp_replace(filenames.sanitize_filename(name), _CONTROL, literal), _BIDI, "")
    if not preserve_unicode:
        s = F.regexp_replace(s, r"[^\x20-\x7e]", literal)
    s = F.regexp_replace(F.regexp_replace(s, f"(?:{mark})+", literal), rf"^(?:{mark})+|(?:{mark})+\z", "")
    ext = F.regexp_extract(s, r"(?i)(\.[a-z0-9]{1,10})\z", 1)
    short = F.concat(F.substring(s, F.lit(1), F.lit(max_length) - F.length(ext)), ext)
    s = F.when(F.length(s) > max_length, short).otherwise(s)
    return F.when(s.isin("", replacement), "file").otherwise(s)


def sanitize_html(html: Column) -> Column:
    """Without dangerous tags (their content stays), attributes, and script targets.  A few large alternations, in the
    order in which single removals could feed each other."""
    tags = "|".join(T.DANGEROUS_TAGS)
    s = F.regexp_replace(html, rf"(?i)<(?:{tags})\b[^>]*>|</(?:{tags})>", "")
    attributes = "|".join(map(re.escape, T.DANGEROUS_ATTRIBUTES))
    s = F.regexp_replace(s, rf"""(?i)\s*(?:{attributes})\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*)""", "")
    s = F.regexp_replace(s, r"""(?i)(href|src|action)\s*=\s*(['"]?)\s*javascript:[^'">\s]*""", "$1=$2#blocked")
    s = F.regexp_replace(s, r"""(?i)src\s*=\s*(['"]?)\s*data:text/html[^'">\s]*""", "src=$1#blocked")
    return F.coalesce(s, F.lit(""))


def safe_urls(df: DataFrame, html: str, out: str = "url", order: str = "ord") -> DataFrame:
    """One row for each safe http(s) URL in src and href attributes of the cleaned HTML, in order."""
    found = F.regexp_extract_all(sanitize_html(F.col(html)), F.lit(r"""(?i)(?:src|href)\s*=\s*(['"]?)([^'">\s]+)\1"""), 2)
    rows = df.select("*", F.posexplode(found).alias(order, "__url"))
    rows = with_sanitized_url(rows, "__url", out, allow_data_urls=True).drop("__url")
    return rows.filter(F.col(out).startswith("http"))
