"""Short cuts for common questions, each over a DataFrame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import detect as D
from .functions import whatwg
from .functions.urls import Url, _udf, is_absolute, is_blob_url, is_data_url, with_url
from .plans.pipeline import DEFAULT, Extractor, Result, binary_files, detect_urls, quick_scan, with_verdicts
from .sources.html import background_url, parse_srcset


def extract_from_urls(df: DataFrame) -> Result:
    """df(ord, url) through the default pipeline."""
    return DEFAULT.from_urls(df)


def extract_from_html(df: DataFrame, html: str = "html", base_url: str | None = None, key: str = "page_id") -> Result:
    return DEFAULT.from_html(df, html, base_url, key)


def extract_from_elements(df: DataFrame, html: str = "html", base_url: str | None = None, key: str = "page_id") -> Result:
    """As ``extract_from_html``, in document order."""
    return DEFAULT.from_html(df, html, base_url, key, mode="dom")


def extract_from_payloads(df: DataFrame, source: str = "drop", key: str = "payload_id") -> Result:
    return DEFAULT.from_payloads(df, source, key)


def extract_from_files(df: DataFrame) -> Result:
    return DEFAULT.from_files(df)


def detect_distinct(df: DataFrame, url: str = "url") -> DataFrame:
    """(url, detection) for each distinct URL."""
    return D.with_detection(with_url(df.select(url).distinct(), url), Url(url)).select(url, "detection")


def _resolved(urls: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([whatwg.resolve(u or "", b) for u, b in zip(urls, bases, strict=True)], dtype=object)


def with_resolved(df: DataFrame, url: str, base: str, out: str = "resolved") -> DataFrame:
    """Adds the absolute form of a reference, null if there is none.  Absolute, data: and blob: URLs stay as they are
    written and don't reach the Arrow UDF."""
    done = F.coalesce(is_absolute(F.col(url)) | is_data_url(F.col(url)) | is_blob_url(F.col(url)), F.lit(False))
    found = _udf(_resolved, "string")(F.when(~done, F.col(url)), F.when(~done, F.col(base)))
    return df.withColumn(out, F.when(done, F.col(url)).otherwise(found))


__all__ = [
    "Extractor", "Result", "background_url", "binary_files", "detect_distinct", "detect_urls", "extract_from_elements", "extract_from_files", "extract_from_html", "extract_from_payloads",
    "extract_from_urls", "parse_srcset", "quick_scan", "with_resolved", "with_verdicts",
]
