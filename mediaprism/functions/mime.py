"""MIME types, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import tables as T
from .filenames import lookup, trim_all
from .urls import let


def mime_of_extension(ext: Column) -> Column:
    return lookup(T.EXTENSION_MIME, F.regexp_replace(F.lower(ext), r"^\.", ""))


def extension_of_mime(mime: Column) -> Column:
    return lookup(T.MIME_EXTENSION, trim_all(F.lower(mime)))


def _document(low: Column) -> Column:
    return (low == "application/pdf") | low.rlike("|".join(T.DOCUMENT_MIME_WORDS))


def media_type_of_mime(mime: Column) -> Column:
    kind = lambda low: F.when(low.startswith("image/"), "image").when(low.startswith("video/"), "video").when(low.startswith("audio/"), "audio").when(_document(low), "document").otherwise("unknown")
    return let(trim_all(F.lower(F.coalesce(mime, F.lit("")))), kind)


def media_type_of_extension(ext: Column) -> Column:
    """By the extension's MIME type; every known extension has one, so txt and rtf are unknown."""
    return media_type_of_mime(mime_of_extension(ext))


def is_image_mime(mime: Column) -> Column:
    return F.coalesce(F.lower(mime).startswith("image/"), F.lit(False))


def is_video_mime(mime: Column) -> Column:
    return F.coalesce(F.lower(mime).startswith("video/"), F.lit(False))


def is_audio_mime(mime: Column) -> Column:
    return F.coalesce(F.lower(mime).startswith("audio/"), F.lit(False))


def is_document_mime(mime: Column) -> Column:
    return F.coalesce(_document(F.lower(mime)), F.lit(False))


def is_supported_mime(mime: Column) -> Column:
    return is_image_mime(mime) | is_video_mime(mime) | is_audio_mime(mime) | is_document_mime(mime)


def mime_of_data_url(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, "^data:([^;,]+)", 1)), F.lit(""))


def media_type_of_data_url(url: Column) -> Column:
    return media_type_of_mime(mime_of_data_url(url))


def mime_of_bytes(data: Column) -> Column:
    """By the first signature that fits; null below 8 bytes."""
    out = F.when(F.length(data) < 8, None)
    for signature, mime in T.MAGIC:
        n = len(signature) // 2
        fits = F.hex(F.substring(data, 1, n)) == signature
        if mime == "image/webp":
            fits = fits & ((F.length(data) < 12) | (F.hex(F.substring(data, 9, 4)) == "57454250"))
        out = out.when(fits, mime)
    return out


def media_type_of_bytes(data: Column) -> Column:
    return media_type_of_mime(mime_of_bytes(data))


def supported_extensions(media_type: str) -> list[str]:
    """Extensions of a type, in the table's order; none for unknown types."""
    if media_type == "document":
        return list(T.DOCUMENT_EXTENSIONS)
    return [e for e, m in T.EXTENSION_MIME.items() if m.startswith(f"{media_type}/")] if media_type in T.MEDIA_TYPES else []


def is_safe_mime(mime: Column) -> Column:
    return F.coalesce(trim_all(F.substring_index(F.lower(mime), ";", 1)).isin(*T.SAFE_MIME_TYPES), F.lit(False))


def content_type(text: Column) -> Column:
    """struct(safe, mime_type, charset) of a Content-Type; of several charsets the last counts."""
    parts = F.transform(F.split(text, ";"), trim_all)
    named = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: p.startswith("charset="))
    charset = F.regexp_replace(F.substring(F.try_element_at(named, F.lit(-1)), 9, 1 << 30), "['\"]", "")
    some = F.coalesce(text, F.lit("")) != ""
    return F.struct(is_safe_mime(text).alias("safe"), F.when(some, F.lower(F.get(parts, F.lit(0)))).alias("mime_type"), F.when(some, charset).alias("charset"))


def any_of(*conditions: Column) -> Column:
    return reduce(Column.__or__, conditions)
