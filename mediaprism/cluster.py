"""What a cluster's machines need from the driver."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python workers can import it."""
    key = spark.sparkContext.applicationId
    if key in _shipped:
        return
    _shipped.add(key)
    package = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp()}/{package.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)


def spread(df: DataFrame) -> DataFrame:
    """Deals a small input with fewer partitions than cores over all cores; large inputs, which have more, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
