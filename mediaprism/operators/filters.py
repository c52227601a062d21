"""Filters over media rows: URL patterns, domains, dimensions, file sizes, and a fluent builder.

A media row has ``url`` with its parsed parts, and ``media_type, status, width, height, file_size`` where a filter needs
them.  Every filter is one conjunctive condition; sorting needs the ordinal ``ord``, which stands for the input's order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..functions.detect import any_pattern
from ..functions.urls import Url, domain, path, registered_domain
from .dedupe import DedupeOptions, deduplicate

Pattern = str | re.Pattern


def compile_pattern(pattern: Pattern, case_sensitive: bool = False) -> str:
    """A regular expression; strings are globs (* and ?) that may match anywhere."""
    if isinstance(pattern, re.Pattern):
        text = pattern.pattern
        insensitive = not case_sensitive or pattern.flags & re.I
    else:
        text = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
        insensitive = not case_sensitive
    return ("(?i)" if insensitive else "") + text


def matches_pattern(text: Column, pattern: Pattern, case_sensitive: bool = False) -> Column:
    return F.coalesce(text.rlike(compile_pattern(pattern, case_sensitive)), F.lit(False))


def matches_any(text: Column, patterns: Iterable[Pattern], case_sensitive: bool = False) -> Column:
    """Whether one of the patterns occurs; false for none."""
    each = [compile_pattern(p, case_sensitive) for p in patterns]
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in each)), F.lit(False)) if each else F.lit(False)


def matches_domain(url: Url, name: str) -> Column:
    """The host itself, a subdomain for ``*.name`` (and the bare name), or the registered domain."""
    host, name = domain(url), name.lower()
    base = ((host == name[2:]) | host.endswith(f".{name[2:]}")) if name.startswith("*.") else F.lit(False)
    return (host == name) | base | (registered_domain(url) == name)


def in_domains(url: Url, names: Iterable[str]) -> Column:
    return reduce(Column.__or__, (matches_domain(url, n) for n in names), F.lit(False))


@dataclass(frozen=True)
class PatternFilter:
    include: tuple[Pattern, ...] = ()
    exclude: tuple[Pattern, ...] = ()
    allowed_domains: tuple[str, ...] = ()
    blocked_domains: tuple[str, ...] = ()
    path_patterns: tuple[Pattern, ...] = ()
    case_sensitive: bool = False


def check_patterns(url: Url, rule: PatternFilter) -> Column:
    out = F.lit(True)
    if rule.allowed_domains:
        out &= in_domains(url, rule.allowed_domains)
    if rule.blocked_domains:
        out &= ~in_domains(url, rule.blocked_domains)
    if rule.exclude:
        out &= ~matches_any(url.raw, rule.exclude, rule.case_sensitive)
    if rule.include:
        out &= matches_any(url.raw, rule.include, rule.case_sensitive)
    if rule.path_patterns:
        out &= matches_any(path(url), rule.path_patterns, rule.case_sensitive)
    return out


def is_unwanted(url: Url) -> Column:
    """Tracking, user interface, adverts and placeholders."""
    return any_pattern(url.raw, tuple(p for k in ("tracking", "ui_elements", "ads", "placeholders") for p in T.EXCLUDE_PATTERNS[k]))


def has_quality(url: Url) -> Column:
    """Wanted, and marked as full size or high resolution or at least not as a thumbnail."""
    good = any_pattern(url.raw, T.INCLUDE_PATTERNS["full_size"] + T.INCLUDE_PATTERNS["high_res"])
    return ~is_unwanted(url) & (good | ~any_pattern(url.raw, T.EXCLUDE_PATTERNS["thumbnails"]))


def domain_group(url: Url) -> Column:
    """The group of a row: its registered domain, ``unknown`` without one."""
    return F.coalesce(F.nullif(registered_domain(url), F.lit("")), F.lit("unknown"))


def group_by_domain(df: DataFrame, url: Url) -> DataFrame:
    """(domain, n) by registered domain; rows keep their group as a column by ``domain_group``."""
    return df.groupBy(domain_group(url).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


# ---- dimensions and sizes ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class DimensionFilter:
    min_width: float | None = None
    min_height: float | None = None
    max_width: float | None = None
    max_height: float | None = None
    min_aspect_ratio: float | None = None
    max_aspect_ratio: float | None = None


def preset_dimensions(name: str) -> DimensionFilter:
    return DimensionFilter(**T.DIMENSION_PRESETS[name])


def combine_dimensions(*rules: DimensionFilter) -> DimensionFilter:
    """The largest of the minima (0 at least) and the smallest of the maxima."""
    out = {}
    for name in DimensionFilter.__dataclass_fields__:
        bounds = [v for r in rules if (v := getattr(r, name)) is not None]
        if bounds:
            out[name] = max(0, *bounds) if name.startswith("min") else min(bounds)
    return DimensionFilter(**out)


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.try_divide(width, height)


def pixel_count(width: Column, height: Column) -> Column:
    return width * height


def check_dimensions(width: Column, height: Column, rule: DimensionFilter) -> Column:
    """All bounds that are set; a missing side fails any bound on it."""
    ratio = aspect_ratio(width, height)
    sides = {"width": width, "height": height, "aspect_ratio": ratio}
    out = F.lit(True)
    for name in DimensionFilter.__dataclass_fields__:
        if (bound := getattr(rule, name)) is not None:
            side = sides[name[4:]]
            out &= F.coalesce(side >= bound if name.startswith("min") else side <= bound, F.lit(False))
    return out


def check_file_size(size: Column, least: int | None = None, most: int | None = None) -> Column:
    """Bounds on a known size; unknown sizes pass."""
    fits = F.lit(True)
    if least is not None:
        fits &= size >= least
    if most is not None:
        fits &= size <= most
    return size.isNull() | fits


def _pixels() -> Column:
    return F.coalesce(pixel_count(F.col("width"), F.col("height")), F.lit(0.0))


def sort_by_size(df: DataFrame, descending: bool = True) -> DataFrame:
    return df.orderBy(_pixels().desc() if descending else _pixels().asc(), "ord")


def sort_by_aspect_ratio(df: DataFrame, descending: bool = True) -> DataFrame:
    ratio = F.coalesce(aspect_ratio(F.col("width"), F.col("height")), F.lit(0.0))
    return df.orderBy(ratio.desc() if descending else ratio.asc(), "ord")


def largest(df: DataFrame) -> DataFrame:
    """The first row with the most pixels (a top-1, not a sort of all rows)."""
    return sort_by_size(df).limit(1)


def size_group(width: Column, height: Column) -> Column:
    """tiny, small, medium, large, or unknown without a width."""
    pixels = F.coalesce(pixel_count(width, height), F.lit(0.0))
    return reduce(lambda w, b: w.when(pixels < b[1], b[0]), T.SIZE_BOUNDS.items(), F.when(width.isNull(), "unknown")).otherwise("large")


# ---- all filters ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FilterConfig:
    media_types: tuple[str, ...] = ()
    security_statuses: tuple[str, ...] = ()
    filter_unwanted: bool = False
    dimensions: DimensionFilter | None = None
    min_file_size: int | None = None
    max_file_size: int | None = None
    patterns: PatternFilter | None = None
    custom: Column | None = None
    dedupe: DedupeOptions | None = None


FILTER_PRESETS = {
    "none": FilterConfig(),
    "basic": FilterConfig(dimensions=preset_dimensions("no_tiny"), dedupe=DedupeOptions(), filter_unwanted=True),
    "standard": FilterConfig(dimensions=preset_dimensions("no_small"), dedupe=DedupeOptions(), security_statuses=("safe", "unchecked"), filter_unwanted=True),
    "strict": FilterConfig(
        dimensions=preset_dimensions("medium_plus"), dedupe=DedupeOptions("smart", prefer_with_dimensions=True), security_statuses=("safe",), filter_unwanted=True,
        patterns=PatternFilter(exclude=tuple(re.compile(p) for k in ("tracking", "ui_elements", "ads", "thumbnails") for p in T.EXCLUDE_PATTERNS[k])),
    ),
    "photos": FilterConfig(media_types=("image",), dimensions=preset_dimensions("photo"), dedupe=DedupeOptions("smart", prefer_with_dimensions=True), filter_unwanted=True),
    "videos": FilterConfig(media_types=("video",), dedupe=DedupeOptions()),
    "documents": FilterConfig(media_types=("document",), dedupe=DedupeOptions()),
}


def condition(config: FilterConfig, url: Url) -> Column:
    """Everything but the dedupe, as one condition."""
    out = F.lit(True)
    if config.media_types:
        out &= F.col("media_type").isin(*config.media_types)
    if config.security_statuses:
        out &= F.col("status").isin(*config.security_statuses)
    if config.filter_unwanted:
        out &= ~is_unwanted(url)
    if config.dimensions:
        out &= check_dimensions(F.col("width"), F.col("height"), config.dimensions)
    if config.min_file_size is not None or config.max_file_size is not None:
        out &= check_file_size(F.col("file_size"), config.min_file_size, config.max_file_size)
    if config.patterns:
        out &= check_patterns(url, config.patterns)
    if config.custom is not None:
        out &= F.coalesce(config.custom, F.lit(False))
    return out


def apply_filters(df: DataFrame, config: FilterConfig, url: Url | None = None) -> DataFrame:
    """All filters at once, then the dedupe on what is left."""
    url = url or Url("url")
    out = df.filter(condition(config, url))
    return deduplicate(out, config.dedupe, url) if config.dedupe else out


def apply_preset(df: DataFrame, preset: str, url: Url | None = None) -> DataFrame:
    return apply_filters(df, FILTER_PRESETS[preset], url)


@dataclass(frozen=True)
class FilterBuilder:
    """Collects filters; every method returns a new builder, ``execute`` the lazy result."""

    df: DataFrame
    url: Url = field(default_factory=lambda: Url("url"))
    config: FilterConfig = FilterConfig()

    def _with(self, **changes) -> FilterBuilder:
        return replace(self, config=replace(self.config, **changes))

    def _pattern(self, **changes) -> FilterBuilder:
        return self._with(patterns=replace(self.config.patterns or PatternFilter(), **changes))

    def media_types(self, *types: str) -> FilterBuilder:
        return self._with(media_types=types)

    def images_only(self) -> FilterBuilder:
        return self.media_types("image")

    def videos_only(self) -> FilterBuilder:
        return self.media_types("video")

    def dimensions(self, rule: DimensionFilter) -> FilterBuilder:
        return self._with(dimensions=rule)

    def dimension_preset(self, name: str) -> FilterBuilder:
        return self.dimensions(preset_dimensions(name))

    def min_size(self, width: float, height: float) -> FilterBuilder:
        return self.dimensions(replace(self.config.dimensions or DimensionFilter(), min_width=width, min_height=height))

    def max_size(self, width: float, height: float) -> FilterBuilder:
        return self.dimensions(replace(self.config.dimensions or DimensionFilter(), max_width=width, max_height=height))

    def patterns(self, rule: PatternFilter) -> FilterBuilder:
        return self._with(patterns=rule)

    def include(self, *patterns: Pattern) -> FilterBuilder:
        return self._pattern(include=(self.config.patterns or PatternFilter()).include + patterns)

    def exclude(self, *patterns: Pattern) -> FilterBuilder:
        return self._pattern(exclude=(self.config.patterns or PatternFilter()).exclude + patterns)

    def from_domains(self, *names: str) -> FilterBuilder:
        return self._pattern(allowed_domains=names)

    def not_from_domains(self, *names: str) -> FilterBuilder:
        return self._pattern(blocked_domains=names)

    def dedupe(self, options: DedupeOptions | None = None) -> FilterBuilder:
        return self._with(dedupe=options or DedupeOptions())

    def smart_dedupe(self) -> FilterBuilder:
        return self.dedupe(DedupeOptions("smart", prefer_with_dimensions=True))

    def security_status(self, *statuses: str) -> FilterBuilder:
        return self._with(security_statuses=statuses)

    def safe_only(self) -> FilterBuilder:
        return self.security_status("safe")

    def file_size(self, least: int | None = None, most: int | None = None) -> FilterBuilder:
        changes = {k: v for k, v in (("min_file_size", least), ("max_file_size", most)) if v is not None}
        return self._with(**changes)

    def filter(self, predicate: Column) -> FilterBuilder:
        return self._with(custom=predicate if self.config.custom is None else self.config.custom & predicate)

    def remove_unwanted(self) -> FilterBuilder:
        return self._with(filter_unwanted=True)

    def execute(self) -> DataFrame:
        return apply_filters(self.df, self.config, self.url)

    def first(self) -> DataFrame:
        return self.execute().orderBy("ord").limit(1)

    def count(self) -> int:
        return self.execute().count()

    def any(self) -> bool:
        return not self.execute().isEmpty()
