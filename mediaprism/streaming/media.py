"""The same expressions on streams: first-seen media and counts by type in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import media_type, with_detection
from ..functions.urls import Url, normalize, with_url


def first_seen(stream: DataFrame, url: str = "url", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The first event of each normal form within the watermark; older state is dropped with it."""
    parsed = with_url(stream, url).withColumn("dedupe_key", normalize(Url(url))).drop(f"{url}_parts", f"{url}_parts_params")
    return parsed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["dedupe_key"])


def counts_by_type(stream: DataFrame, url: str = "url", ts: str = "ts", window: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(window, media_type, n) in tumbling or sliding windows."""
    typed = with_detection(with_url(stream.withWatermark(ts, delay), url), Url(url)).withColumn("media_type", media_type(F.col("detection")))
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    return typed.groupBy(span.alias("window"), "media_type").agg(F.count(F.lit(1)).alias("n"))
