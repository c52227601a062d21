"""URLs in texts, in lists, in drop and paste payloads, and in file listings, as rows of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables as T
from ..functions.detect import with_detection
from ..functions.filenames import extension, filename
from ..functions.mime import media_type_of_mime
from ..functions.urls import Url, barrier, embedded_url, is_absolute, is_blob_url, is_data_url, is_shortener, normalize, with_redirects, with_url
from .html import html_items

_URLS = r"(?i)https?://[^\s<>\"{}|\\^`\[\]]+"


def urls_in_text(text: Column, most: int = 10) -> Column:
    """All http(s) URLs of a text in order, without up to ``most`` punctuation marks at their end (0: any number)."""
    count = f"{{1,{most}}}" if most else "+"
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_URLS), 0), lambda u: F.regexp_replace(u, rf"[.,;:!?)]{count}\z", ""))


def parse_urls(df: DataFrame, url: str = "url", media_types: tuple[str, ...] | None = T.MEDIA_TYPES) -> DataFrame:
    """Adds source, media_type, format, filename, confidence, dedupe_key, is_shortener and redirect_count; rows that are
    no http(s), data or blob URL or have an unwanted type are dropped."""
    u = Url(url)
    df = df.filter(is_absolute(F.col(url)) | is_data_url(F.col(url)) | is_blob_url(F.col(url)))
    df = with_redirects(with_url(df, url), u, "redirect_count").withColumn("format", barrier(extension(u)))
    df = with_detection(df, u, ext="format")
    if media_types is not None:
        df = df.filter(F.col("detection.type").isin(*media_types))
    source = F.when(is_data_url(u.raw), "data-url").when(is_blob_url(u.raw), "blob-url").otherwise("text-url")
    return df.withColumns({
        "source": source, "media_type": F.col("detection.type"), "filename": filename(u), "hint": F.lit("unknown"), "confidence": F.col("detection.confidence"),
        "dedupe_key": normalize(u), "is_shortener": is_shortener(u),
    })


_ITEM = ["ord", "sub", "url", "source", "media_type", "format", "filename", "hint", "confidence", "dedupe_key", "embedded_from", "is_shortener", "redirect_count"]


def _with_item(df: DataFrame, url: str, out: str, media_types: tuple[str, ...] | None, **more: Column) -> DataFrame:
    """Adds the item of a URL column as a struct, null where ``parse_urls`` would drop the row."""
    u = Url(url)
    df = with_redirects(with_url(df, url), u, f"{out}_n").withColumn(f"{out}_ext", barrier(extension(u)))
    df = with_detection(df, u, out=f"{out}_d", ext=f"{out}_ext")
    kind = F.col(f"{out}_d.type")
    keep = is_absolute(u.raw) | is_data_url(u.raw) | is_blob_url(u.raw)
    keep = keep & kind.isin(*media_types) if media_types is not None else keep
    source = F.when(is_data_url(u.raw), "data-url").when(is_blob_url(u.raw), "blob-url").otherwise("text-url")
    values = {"url": F.col(url), "source": source, "media_type": kind, "format": F.col(f"{out}_ext"), "filename": filename(u), "confidence": F.col(f"{out}_d.confidence"), "dedupe_key": normalize(u), "is_shortener": is_shortener(u), "redirect_count": F.col(f"{out}_n"), **more}
    item = F.struct(*(v.alias(k) for k, v in values.items()))
    return df.withColumn(out, barrier(F.when(keep, item))).drop(f"{out}_n", f"{out}_ext", f"{out}_d")


def parse_with_embedded(df: DataFrame, url: str = "url", media_types: tuple[str, ...] | None = T.MEDIA_TYPES, prefer_embedded: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """The URLs and the URLs within them, as rows (ord, sub, ...): the preferred one of a pair comes first.

    A URL and the one within it are parsed in the same row, so nothing is joined or read twice."""
    u = Url("__url")
    df = df.select("ord", *carry, F.col(url).alias("__url")).filter(is_absolute(F.col("__url")) | is_data_url(F.col("__url")) | is_blob_url(F.col("__url")))
    df = _with_item(df, "__url", "__main", media_types).withColumn("__inner", barrier(F.when(embedded_url(u) != u.raw, embedded_url(u))))
    df = _with_item(df.filter("__main IS NOT NULL").drop("__url_parts", "__url_parts_params"), "__inner", "__within", media_types)
    names = [x for x in _ITEM if x not in ("ord", "sub", "hint", "embedded_from", "source")]
    pick = lambda of, **fixed: F.struct(*(F.col(f"{of}.{n}").alias(n) for n in names), *(F.lit(v).alias(k) if not isinstance(v, Column) else v.alias(k) for k, v in fixed.items()))
    has = F.col("__within").isNotNull()
    main = pick("__main", sub=1, hint=F.when(has, "secondary" if prefer_embedded else "primary").otherwise("unknown"), embedded_from=F.lit(None).cast("string"), source=F.col("__main.source"))
    within = pick("__within", sub=0 if prefer_embedded else 2, hint="primary" if prefer_embedded else "secondary", embedded_from=F.col("__url"), source="embedded")
    rows = df.select("ord", *carry, F.explode(F.array_compact(F.array(main, F.when(has, within)))).alias("__item"))
    return rows.select(*carry, *(F.col(n) if n == "ord" else F.col(f"__item.{n}").alias(n) for n in _ITEM))


def first_seen(items: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each key (within a group); a group's first row becomes ``primary`` if it has no hint."""
    order = F.struct("ord", "sub")
    best = items.groupBy(*group, "dedupe_key").agg(F.min_by(F.struct(*items.columns), order).alias("r")).select("r.*")
    if group:
        best = best.join(best.groupBy(*group).agg(F.min(order).alias("__least")), list(group))
    else:
        # one row; it takes all columns, so that both sides of the join read one shuffle
        best = best.join(F.broadcast(best.agg(F.min_by(F.struct(*best.columns), order).alias("__r"))))
        best = best.withColumn("__least", F.struct(F.col("__r.ord").alias("ord"), F.col("__r.sub").alias("sub"))).drop("__r")
    start = F.struct("ord", "sub") == F.col("__least")
    return best.withColumn("hint", F.when(start & (F.col("hint") == "unknown"), "primary").otherwise(F.col("hint"))).drop("__least")


def text_items(df: DataFrame, text: str = "text", key: str = "text_id", **options) -> DataFrame:
    """Items of the URLs in each text; keys are first seen within a text."""
    rows = df.select(F.col(key), F.posexplode(urls_in_text(F.col(text))).alias("ord", "url")).withColumn("ord", F.col("ord").cast("long"))
    return first_seen(parse_with_embedded(rows, carry=(key,), **options), (key,))


def is_valid_media_url(df: DataFrame, url: str = "url", media_types: tuple[str, ...] | None = None, out: str = "is_media") -> DataFrame:
    """Adds whether the scheme is right and the type known (and wanted)."""
    u = Url(url)
    df = with_detection(with_url(df, url), u)
    kind = F.col("detection.type")
    known = kind.isin(*media_types) if media_types else kind != "unknown"
    return df.withColumn(out, (is_absolute(u.raw) | is_data_url(u.raw) | is_blob_url(u.raw)) & known).drop("detection")


# ---- payloads and files --------------------------------------------------------------------------------------------


def has_media(files: Column, data: Column) -> Column:
    """A media file, or HTML or a URI list (plain text doesn't count); files: array<struct<name,type,size>>, data: map."""
    kind = lambda f: f["type"].rlike("^(?:image|video|audio)/") | (f["type"] == "application/pdf")
    return F.coalesce(F.exists(files, kind), F.lit(False)) | F.coalesce(F.map_contains_key(data, "text/html") | F.map_contains_key(data, "text/uri-list"), F.lit(False))


def payload_preview(files: Column, data: Column) -> Column:
    has = lambda k: F.coalesce(F.map_contains_key(data, k), F.lit(False))
    n = F.coalesce(F.when(files.isNotNull(), F.size(files)), F.lit(0))
    return F.struct((n > 0).alias("has_files"), n.alias("file_count"), has("text/html").alias("has_html"), has("text/uri-list").alias("has_uri_list"), has("text/plain").alias("has_text"))


def payload_items(df: DataFrame, key: str = "payload_id", media_types: tuple[str, ...] = T.MEDIA_TYPES, embedded: bool = True) -> DataFrame:
    """Items of drop or paste payloads (key, files, data): files, then HTML, then the URI list, then plain text; first seen
    wins within a payload, its first item is ``primary``."""
    shape = [key, "branch", "ord", "sub", "url", "source", "media_type", "format", "filename", "hint", "confidence", "dedupe_key", "mime_type", "file_size"]
    none = {"mime_type": F.lit(None).cast("string"), "file_size": F.lit(None).cast("long"), "sub": F.lit(0)}
    files = df.select(key, F.posexplode("files").alias("ord", "f"))
    name = F.col("f.name")
    files = files.select(
        key, F.lit(0).alias("branch"), F.col("ord").cast("long").alias("ord"), F.lit(0).alias("sub"), F.concat(F.lit("file:"), F.col(key).cast("string"), F.lit("/"), "ord", F.lit("/"), name).alias("url"), F.lit("file").alias("source"),
        media_type_of_mime(F.col("f.type")).alias("media_type"), F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("").alias("format"),
        F.coalesce(F.nullif(F.regexp_replace(name, r"\.[^.]*\z", ""), F.lit("")), F.lit("file")).alias("filename"), F.when(F.col("ord") == 0, "primary").otherwise("unknown").alias("hint"), F.lit(1.0).alias("confidence"),
        F.concat(F.lit("file:"), F.col(key).cast("string"), F.lit("/"), "ord").alias("dedupe_key"), F.col("f.type").alias("mime_type"), F.col("f.size").cast("long").alias("file_size"),
    ).filter(F.col("media_type").isin(*media_types))
    markup = html_items(df.select(key, F.col("data")["text/html"].alias("html")).filter("html IS NOT NULL"), key=key, media_types=media_types)
    markup = markup.filter(F.col("media_type").isin(*media_types)).withColumns({"branch": F.lit(1), **none})
    lines = F.filter(F.transform(F.split(F.col("data")["text/uri-list"], r"[\r\n]+"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    listed = df.select(key, F.posexplode(lines).alias("ord", "url")).filter(is_absolute(F.col("url"))).withColumn("ord", F.col("ord").cast("long"))
    listed = parse_with_embedded(listed, media_types=media_types, prefer_embedded=True, carry=(key,)) if embedded else parse_urls(listed, media_types=media_types).withColumn("sub", F.lit(1))
    listed = listed.withColumns({"source": F.when(F.col("source") == "embedded", "embedded").otherwise("uri-list"), "hint": F.when(F.col("source") == "embedded", "primary").otherwise("unknown"), "sub": F.when(F.col("source") == "embedded", 2).otherwise(1), "branch": F.lit(2), **{k: v for k, v in none.items() if k != "sub"}})
    plain = df.select(key, F.posexplode(urls_in_text(F.col("data")["text/plain"], 0)).alias("ord", "url")).withColumn("ord", F.col("ord").cast("long"))
    plain = parse_urls(plain, media_types=media_types).withColumns({"branch": F.lit(3), **none})
    rows = files.select(*shape).unionByName(markup.select(*shape)).unionByName(listed.select(*shape)).unionByName(plain.select(*shape))
    place = F.struct("branch", "ord", "sub")
    best = rows.groupBy(key, "dedupe_key").agg(F.min_by(F.struct(*shape), place).alias("r")).select("r.*")
    start = F.row_number().over(Window.partitionBy(key).orderBy("branch", "ord", "sub"))
    best = best.withColumn("__n", start)
    return best.withColumn("hint", F.when((F.col("__n") == 1) & (F.col("hint") == "unknown"), "primary").otherwise(F.col("hint"))).withColumn("ord", F.col("__n").cast("long")).drop("__n", "branch", "sub")


def file_items(df: DataFrame, name: str = "name", mime: str = "type", size: str = "size") -> DataFrame:
    """Items of a file listing (ord, name, type, size), or of ``binaryFile`` rows; the type comes from the extension or else
    the MIME type, empty sizes and types are null."""
    u = Url("__file")
    df = with_url(df.withColumn("__file", F.concat(F.lit("http://file/"), F.url_encode(F.col(name)))), "__file")
    df = with_detection(df.withColumn("format", barrier(extension(u))), u, ext="format")
    kind = F.when(F.col("detection.confidence") >= 1.0, F.col("detection.type")).otherwise(F.lit("unknown"))
    kind = F.when(kind == "unknown", media_type_of_mime(F.col(mime))).otherwise(kind)
    return df.withColumns({"source": F.lit("file"), "media_type": kind, "filename": F.col(name), "mime_type": F.nullif(F.col(mime), F.lit("")), "file_size": F.nullif(F.col(size), F.lit(0))}).drop("__file", "__file_parts", "__file_parts_params", "detection")
