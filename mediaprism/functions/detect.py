"""Media type detection: a confidence for each type, and the type with the best one.

All patterns of a kind are one alternation, so a URL is scanned once for each kind.  ``with_detection`` adds the result as
a struct; the single scores are there as functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from . import mime as M
from .filenames import extension, is_audio_extension, is_document_extension, is_image_extension, is_video_extension
from .urls import Url, barrier, decode_component, domain, first_value, is_absolute, is_blob_url, is_data_url, let, param


def any_pattern(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns occurs, in any letter case; false for no patterns."""
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def _short(url: Url, patterns: tuple[str, ...]) -> Column:
    return (F.length(url.raw) <= T.MAX_PATTERN_URL) & any_pattern(url.raw, patterns)


def _platform(url: Url, platforms) -> Column:
    """One pattern over ``host`` newline ``path and query``: the host part ignores letter case."""
    one = lambda h, p: f"(?:(?i:{h[:-1]})\\n" + (f"[\\s\\S]*(?:{'|'.join(p)})" if p else "") + ")"
    whole = F.concat(domain(url), F.lit("\n"), url.part("path"), url.part("query"))
    return F.coalesce(whole.rlike("|".join(one(h, p) for h, p in platforms)), F.lit(False))


def _data(url: Url, kind) -> Column:
    return is_data_url(url.raw) & kind(M.mime_of_data_url(url.raw))


# ---- images --------------------------------------------------------------------------------------------------------


def has_image_extension(url: Url) -> Column:
    return is_image_extension(extension(url))


def is_image_data_url(url: Url) -> Column:
    return _data(url, M.is_image_mime)


def matches_image_pattern(url: Url) -> Column:
    return any_pattern(url.raw, T.IMAGE_URL_PATTERNS)


def has_image_params(url: Url) -> Column:
    """A format parameter that names an image type, or two parameters of image operations."""
    images = M.supported_extensions("image")
    named = F.exists(F.array(*map(F.lit, T.IMAGE_FORMAT_PARAMS)), lambda n: F.coalesce(F.lower(first_value(url.params, n)).isin(*images), F.lit(False)))
    operations = F.size(F.array_intersect(F.transform(url.params, lambda p: p["k"]), F.array(*map(F.lit, T.IMAGE_OPERATION_PARAMS))))
    return (F.size(url.params) > 0) & (named | (operations >= 2))


def _lower_path(url: Url) -> Column:
    return decode_component(F.lower(url.part("path")))


def _has_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(text.rlike("|".join(words)), F.lit(False))


def _scored(url: Url, data: Column, blob: float) -> Column:
    return F.when(is_data_url(url.raw), F.when(data, 1.0).otherwise(0.0)).when(is_blob_url(url.raw), blob).when(~is_absolute(url.raw), 0.0)


def image_score(url: Url, ext: Column | None = None) -> Column:
    by_path = lambda path: F.when(_has_word(path, T.IMAGE_PATH_WORDS), 0.5).when(path.rlike(r"(?s)/[^/.]+\z"), 0.3).otherwise(0.0)
    return (
        _scored(url, is_image_data_url(url), 0.5).when(is_image_extension(ext if ext is not None else extension(url)), 1.0)
        .when(matches_image_pattern(url), F.when(has_image_params(url), 0.9).otherwise(0.7)).when(has_image_params(url), 0.6)
        .otherwise(let(_lower_path(url), by_path))
    )


def is_tracking_pixel_size(width: Column, height: Column) -> Column:
    return F.coalesce((width <= 1) & (height <= 1), F.lit(False))


def is_ui_element_size(width: Column, height: Column, most: int = 32) -> Column:
    return F.coalesce((width <= most) & (height <= most), F.lit(False))


def is_ui_element_url(url: Url) -> Column:
    return _has_word(_lower_path(url), T.UI_PATH_WORDS)


# ---- video ---------------------------------------------------------------------------------------------------------


def has_video_extension(url: Url) -> Column:
    return is_video_extension(extension(url))


def is_streaming_manifest(url: Url) -> Column:
    return extension(url).isin(*T.STREAMING_EXTENSIONS)


def is_video_data_url(url: Url) -> Column:
    return _data(url, M.is_video_mime)


def is_video_platform(url: Url) -> Column:
    return _platform(url, T.VIDEO_PLATFORMS)


def matches_video_pattern(url: Url) -> Column:
    return _short(url, T.VIDEO_URL_PATTERNS)


def video_id(url: Url) -> Column:
    """The id in a YouTube or Vimeo URL, or null."""
    host, path = domain(url), url.part("path")
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(
        F.when(host.rlike(r"youtube\.com$"), F.coalesce(some(param(url, "v")), some(F.regexp_extract(path, "/embed/([a-zA-Z0-9_-]+)", 1)))),
        F.when(host.rlike(r"youtu\.be$"), some(F.regexp_extract(path, "^/([a-zA-Z0-9_-]+)", 1))),
        F.when(host.rlike(r"vimeo\.com$"), some(F.regexp_extract(path, r"/(\d+)", 1))),
    )


def video_score(url: Url, ext: Column | None = None) -> Column:
    ext = ext if ext is not None else extension(url)
    return _scored(url, is_video_data_url(url), 0.4).when(is_video_extension(ext), 1.0).when(ext.isin(*T.STREAMING_EXTENSIONS), 0.95).when(is_video_platform(url), 0.9).when(matches_video_pattern(url), 0.85).otherwise(0.0)


# ---- audio ---------------------------------------------------------------------------------------------------------


def has_audio_extension(url: Url) -> Column:
    return is_audio_extension(extension(url))


def is_audio_data_url(url: Url) -> Column:
    return _data(url, M.is_audio_mime)


def is_audio_platform(url: Url) -> Column:
    return _platform(url, T.AUDIO_PLATFORMS)


def matches_audio_pattern(url: Url) -> Column:
    return _short(url, T.AUDIO_URL_PATTERNS)


def is_streaming_audio(url: Url) -> Column:
    return any_pattern(url.raw, T.AUDIO_STREAM_PATTERNS)


def audio_score(url: Url, ext: Column | None = None) -> Column:
    ext = ext if ext is not None else extension(url)
    return _scored(url, is_audio_data_url(url), 0.4).when(is_audio_extension(ext), 1.0).when(is_audio_platform(url), 0.9).when(matches_audio_pattern(url), 0.85).when(is_streaming_audio(url), 0.7).otherwise(0.0)


# ---- documents -----------------------------------------------------------------------------------------------------


def has_document_extension(url: Url) -> Column:
    return is_document_extension(extension(url))


def is_document_data_url(url: Url) -> Column:
    return _data(url, M.is_document_mime)


def is_document_platform(url: Url) -> Column:
    return _platform(url, T.DOCUMENT_PLATFORMS)


def matches_document_pattern(url: Url) -> Column:
    return _short(url, T.DOCUMENT_URL_PATTERNS)


def has_document_path(url: Url) -> Column:
    return _has_word(F.lower(url.part("path")), T.DOCUMENT_PATH_WORDS)


def document_score(url: Url, ext: Column | None = None) -> Column:
    ext = ext if ext is not None else extension(url)
    return (
        _scored(url, is_document_data_url(url), 0.4).when(is_document_extension(ext), 1.0).when(is_document_platform(url), 0.9)
        .when(matches_document_pattern(url), F.when(has_document_path(url), 0.85).otherwise(0.7)).when(has_document_path(url), 0.5).otherwise(0.0)
    )


def is_pdf(url: Url) -> Column:
    return (extension(url) == "pdf") | F.coalesce(M.mime_of_data_url(url.raw) == "application/pdf", F.lit(False))


# ---- all types -----------------------------------------------------------------------------------------------------

SCORES = {"image": image_score, "video": video_score, "audio": audio_score, "document": document_score}


def with_detection(df: DataFrame, url: Url, out: str = "detection", ext: str | None = None) -> DataFrame:
    """Adds struct(type, confidence, scores): the best type, the earlier one of equals; ``unknown`` with confidence 1 if no
    score is above 0.  ``ext`` names a column that already holds the extension; otherwise it is computed once here."""
    made = ext is None
    if made:
        ext, df = f"__{out}_ext", df.withColumn(f"__{out}_ext", barrier(extension(url)))
    df = df.withColumn(f"__{out}", barrier(F.struct(*(f(url, F.col(ext)).alias(k) for k, f in SCORES.items()))))
    scores = F.col(f"__{out}")
    best = F.greatest(*(scores[k] for k in SCORES))
    kind = reduce(lambda w, k: w.when(scores[k] == best, k), SCORES, F.when(best <= 0, "unknown"))
    df = df.withColumn(out, F.struct(kind.alias("type"), F.when(best <= 0, 1.0).otherwise(best).alias("confidence"), scores.alias("scores")))
    return df.drop(f"__{out}", *([ext] if made else []))


def media_type(detection: Column, threshold: float = 0.5) -> Column:
    return F.when(detection["confidence"] >= threshold, detection["type"]).otherwise("unknown")


def is_media_type(url: Url, kind: str, threshold: float = 0.5) -> Column:
    """By the type's own score, whatever the others; ``unknown`` is never true."""
    return SCORES[kind](url) >= threshold if kind in SCORES else F.lit(False)


def is_supported(detection: Column, threshold: float = 0.5) -> Column:
    return (detection["type"] != "unknown") & (detection["confidence"] >= threshold)


def filter_by_type(df: DataFrame, url: Url, kind: str, threshold: float = 0.5) -> DataFrame:
    return df.filter(is_media_type(url, kind, threshold))


def group_by_type(df: DataFrame, detection: str = "detection", threshold: float = 0.5) -> DataFrame:
    """(media_type, n) with a row for each of the five types, empty ones included."""
    kinds = df.sparkSession.createDataFrame([(k,) for k in (*SCORES, "unknown")], "media_type string")
    counts = df.groupBy(media_type(F.col(detection), threshold).alias("media_type")).count()
    return kinds.join(counts, "media_type", "left").select("media_type", F.coalesce("count", F.lit(0)).alias("n"))
