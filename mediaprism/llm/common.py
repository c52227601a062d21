"""Helpers that the operators of this subpackage share.

A *word* is a maximal run of characters other than space and U+0009 to U+000D.  On UTF-8 bytes that is exactly
``bytes.split()``, and ``bytes.lower()`` changes A-Z only, so the Python operators work on encoded text.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

#: Java form of the word separators.
SEPARATORS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_made: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``, which the cluster's machines share.

    Only a local master, as in tests, may do without that setting; it gets a temporary folder.
    """
    key = spark.sparkContext.applicationId
    if key not in _made:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _made[key] = f"{(base or tempfile.mkdtemp(prefix='mediaprism-')).rstrip('/')}/mediaprism-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _made[key])
    return _made[key]


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes the session's own folder when the driver ends, if the JVM still answers."""
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    That cuts the lineage: a later job reads the files, whichever executors are lost, and nothing is computed twice.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what ``stored`` wrote so far; for long sessions, once the results that read it are written."""
    folder = _made.get(spark.sparkContext.applicationId)
    if folder:
        _remove(spark, folder)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task holds for a batch of long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, whatever Catalyst inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)
