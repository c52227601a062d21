"""The whole extraction: items from a source, security scan, filters, and statistics.

``Extractor`` is an immutable configuration.  Each entry point takes a DataFrame and returns ``Result``: the items, lazily,
and one row of statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..functions.detect import media_type, with_detection
from ..functions.filenames import extension, filename
from ..functions.mime import mime_of_bytes, mime_of_extension
from ..functions.urls import Url, is_absolute, normalize, with_url
from ..operators.dedupe import DedupeOptions, deduplicate
from ..operators.filters import FILTER_PRESETS, FilterConfig, apply_filters
from ..operators.security import Scanner
from ..sources.html import html_items
from ..sources.texts import file_items, first_seen, parse_urls, parse_with_embedded, payload_items

COLUMNS = ("ord", "id", "url", "source", "media_type", "confidence", "hint", "format", "filename", "mime_type", "file_size", "width", "height", "alt", "title", "link_url", "dedupe_key", "status", "risk_score", "threats")


@dataclass(frozen=True)
class Result:
    items: DataFrame
    stats: DataFrame


@dataclass(frozen=True)
class Extractor:
    """``max_items`` cuts the items in order before the filters, as a limit of the feature; 0 takes all."""

    media_types: tuple[str, ...] = T.MEDIA_TYPES
    confidence_threshold: float = 0.5
    scanner: Scanner = Scanner()
    filters: FilterConfig = FilterConfig()
    follow_embedded: bool = True
    max_items: int = 0
    deduplication: bool = True

    @staticmethod
    def secure(preset: str = "balanced") -> Extractor:
        return Extractor(scanner=Scanner.from_preset(preset))

    @staticmethod
    def filtered(preset: str = "standard") -> Extractor:
        return Extractor(filters=FILTER_PRESETS[preset])

    def configure(self, **changes) -> Extractor:
        return replace(self, **changes)

    # ---- sources ---------------------------------------------------------------------------------------------------

    def from_urls(self, df: DataFrame) -> Result:
        """df(ord, url): URLs and the URLs within them, first seen by normal form."""
        items = parse_with_embedded(df.select("ord", "url")) if self.follow_embedded else parse_urls(df.select("ord", "url")).withColumn("sub", F.lit(1))
        return self._result(self._typed(first_seen(items), threshold=True))

    def from_url(self, df: DataFrame) -> Result:
        """df(ord, url): each row by itself; URLs within it are not followed.  Rows that aren't http(s) count as invalid."""
        good = is_absolute(F.col("url"))
        items = parse_urls(df.filter(good).select("ord", "url")).withColumn("sub", F.lit(1))
        invalid = df.filter(~F.coalesce(good, F.lit(False))).agg(F.count(F.lit(1)).alias("invalid_urls"))
        return self._result(self._typed(items, threshold=True), invalid)

    def from_html(self, df: DataFrame, html: str = "html", base_url: str | None = None, key: str = "page_id", mode: str = "html") -> Result:
        """Items of each page; the threshold doesn't apply to them.  ``mode="dom"`` walks elements in document order."""
        items = html_items(df, html, base_url, key, mode=mode).filter(is_absolute(F.col("url"))).withColumn("sub", F.lit(0))
        return self._result(self._typed(items, threshold=False, carry=(key,)), carry=(key,))

    def from_payloads(self, df: DataFrame, source: str = "drop", key: str = "payload_id") -> Result:
        """Drop or paste payloads; ``source`` names the origin of files.  No filters apply."""
        items = payload_items(df, key, embedded=self.follow_embedded)
        items = items.withColumn("source", F.when(F.col("source") == "file", source).otherwise(F.col("source"))).withColumn("sub", F.lit(0))
        return self._result(self._typed(items.filter(is_absolute(F.col("url")) | (F.col("source") == source)), threshold=False, carry=(key,)), carry=(key,), filtered=False)

    def from_files(self, df: DataFrame) -> Result:
        """df(ord, name, type, size)."""
        items = file_items(df).withColumns({"url": F.concat(F.lit("file:"), "name"), "confidence": F.lit(1.0), "hint": F.lit("unknown"), "dedupe_key": F.col("name"), "sub": F.lit(0)})
        return self._result(self._typed(items, threshold=False), filtered=False)

    def extract(self, df: DataFrame) -> Result:
        """df(ord, source) and perhaps files and data: absolute URLs in ``source`` are taken as such, other strings as HTML;
        without a source, rows with ``data`` are payloads and rows with ``files`` alone are file lists.

        ``ord`` of the items is struct(row, place): the row's number and the item's place in it."""
        absolute = F.coalesce(is_absolute(F.col("source")), F.lit(False))
        given = [F.col(c).isNotNull() if c in df.columns else F.lit(False) for c in ("data", "files")]
        text = F.col("source").isNotNull() | ~(given[0] | given[1])
        urls = self.from_url(df.filter(text & absolute).select("ord", F.col("source").alias("url")))
        markup = self.from_html(df.filter(text & ~absolute).select(F.col("ord").alias("page_id"), F.col("source").alias("html")))
        parts = [(urls, None), (markup, "page_id")]
        if "data" in df.columns:
            files = F.col("files") if "files" in df.columns else F.lit(None).cast("array<struct<name:string,type:string,size:bigint>>")
            parts.append((self.from_payloads(df.filter(~text & given[0]).select(F.col("ord").alias("payload_id"), files.alias("files"), "data")), "payload_id"))
        if "files" in df.columns:
            listed = df.filter(~text & ~given[0] & given[1]).select("ord", F.posexplode("files").alias("place", "f")).select(F.struct("ord", "place").alias("ord"), "f.*")
            parts.append((self.from_files(listed), "file"))
        rows = None
        for result, key in parts:
            row, place = (F.col("ord"), F.lit(0)) if key is None else (F.col("ord.ord"), F.col("ord.place")) if key == "file" else (F.col(key), F.col("ord"))
            items = result.items.withColumn("ord", F.struct(row.cast("long").alias("row"), place.cast("long").alias("place"))).select(*COLUMNS)
            rows = items if rows is None else rows.unionByName(items)
        return Result(rows, _summed([r.stats for r, _ in parts]))

    def from_all(self, results: list[Result]) -> Result:
        """Several results in order: best of each normal form, filters once more, then the limit.

        ``ord`` becomes struct(result, the key columns of any result, ord); the results' ``ord`` must have one type."""
        keys = sorted({c for r in results for c in r.items.columns} - set(COLUMNS))
        rows = None
        for i, r in enumerate(results):
            p = r.items.withColumn("__source", F.lit(i))
            rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
        rows = rows.withColumn("ord", F.struct(F.col("__source").alias("source"), *keys, F.col("ord").alias("place"))).drop("__source")
        rows = with_url(rows, "url")
        if self.deduplication:
            rows = deduplicate(rows, DedupeOptions())
        total = _summed([r.stats for r in results])
        kept = apply_filters(rows, self.filters).drop("url_parts", "url_parts_params")
        count = lambda df, name: F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))
        kept_all = kept
        kept = kept.orderBy("ord").limit(self.max_items) if self.max_items else kept
        # items are counted after the filters and the limit; what the filters took is counted after the deduplication
        total = total.drop("items_extracted", "items_filtered").join(count(rows, "__rows")).join(count(kept_all, "__kept"))
        shown = F.least(F.col("__kept"), F.lit(self.max_items)) if self.max_items else F.col("__kept")
        total = total.withColumns({"items_extracted": shown, "items_filtered": F.col("__rows") - F.col("__kept")}).select(*results[0].stats.columns)
        return Result(kept, total)

    # ---- assembly --------------------------------------------------------------------------------------------------

    def _typed(self, items: DataFrame, threshold: bool, carry: tuple[str, ...] = ()) -> DataFrame:
        """Wanted types only, first seen by normal form, up to ``max_items``."""
        if threshold:
            low = F.col("confidence") < self.confidence_threshold
            items = items.withColumn("media_type", F.when(low, "unknown").otherwise(F.col("media_type")))
        items = items.filter(F.col("media_type").isin(*self.media_types, "unknown"))
        for name, kind in (("width", "double"), ("height", "double"), ("file_size", "bigint"), ("mime_type", "string"), ("alt", "string"), ("title", "string"), ("link_url", "string")):
            if name not in items.columns:
                items = items.withColumn(name, F.lit(None).cast(kind))
        return items.orderBy(*carry, "ord", "sub").limit(self.max_items) if self.max_items else items

    def _result(self, items: DataFrame, invalid: DataFrame | None = None, carry: tuple[str, ...] = (), filtered: bool = True) -> Result:
        both = F.col("width").isNotNull() & F.col("height").isNotNull()
        items = items.withColumns({"width": F.when(both, F.col("width")), "height": F.when(both, F.col("height"))})
        items = with_url(items.drop("url_parts", "url_parts_params"), "url")
        items = self.scanner.scan(items, Url("url"), "width", "height")
        items = items.withColumns({
            "status": F.col("security.status"), "risk_score": F.col("security.risk_score"), "threats": F.col("security.threats"),
            "mime_type": F.coalesce("mime_type", mime_of_extension(F.col("format"))), "id": F.sha2(F.concat_ws("\x1f", *carry, "source", F.col("ord").cast("string"), "url"), 256),
        })
        if filtered:
            items = apply_filters(items, self.filters)
        counts = {"urls_processed": F.count(F.lit(1)), "blocked_urls": F.count_if(F.col("status") == "blocked"), "quarantined_urls": F.count_if(F.col("status") == "quarantined")}
        stats = items.agg(*(v.alias(k) for k, v in counts.items()))
        shown = F.col("urls_processed") if self.scanner.mode == "permissive" else F.col("urls_processed") - F.col("blocked_urls")
        stats = stats.withColumns({"items_extracted": shown, "items_filtered": F.col("urls_processed") - shown, "invalid_urls": F.lit(0).cast("bigint")})
        if invalid is not None:
            stats = stats.drop("invalid_urls").join(F.broadcast(invalid)).withColumn("urls_processed", F.col("urls_processed") + F.col("invalid_urls"))
        kept = items if self.scanner.mode == "permissive" else items.filter("status <> 'blocked'")
        return Result(kept.select(*carry, *COLUMNS), stats)


def _summed(stats: list[DataFrame]) -> DataFrame:
    """One row: the sums of rows of statistics."""
    rows = stats[0]
    for s in stats[1:]:
        rows = rows.unionByName(s)
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stats[0].columns))


DEFAULT = Extractor()


def detect_urls(df: DataFrame, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """A short cut: media type, extension, file name and normal form of a URL column."""
    u = Url(url)
    df = with_detection(with_url(df, url), u)
    return df.withColumns({"media_type": media_type(F.col("detection"), threshold), "extension": extension(u), "filename": filename(u), "normalized": normalize(u)})


def quick_scan(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``security`` with the default scanner."""
    return Scanner().scan(with_url(df, url), Url(url)).drop(f"{url}_parts", f"{url}_parts_params")


def with_verdicts(df: DataFrame, url: str = "url", scanner: Scanner | None = None) -> DataFrame:
    """Adds is_blocked (lists and scripts only) and is_safe (the whole scan)."""
    scanner, u = scanner or Scanner(), Url(url)
    df = scanner.is_safe(with_url(df, url), u)
    return df.withColumn("is_blocked", scanner.is_blocked(u)).drop(f"{url}_parts", f"{url}_parts_params")


def binary_files(spark, path: str, sniff_up_to: int = 64 << 20) -> DataFrame:
    """(ord, name, type, size) of the files below a path, for ``from_files``.

    Types are those of the first bytes.  Spark's file source reads a file as a whole, so only files of ``sniff_up_to`` bytes
    or less are opened; the content of larger ones isn't read, and their type is left to the extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.coalesce(mime_of_bytes(F.substring("content", 1, 16)), F.lit(""))
    shape = lambda df, kind: df.select(F.xxhash64("path").alias("ord"), name.alias("name"), kind.alias("type"), F.col("length").alias("size"))
    return shape(files.filter(F.col("length") <= sniff_up_to), kind).unionByName(shape(files.filter(F.col("length") > sniff_up_to), F.lit("")))
