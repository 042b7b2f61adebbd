"""Versions of a stored structure: which of the files in its folder belong to it.

A version is a small table, written whole under its number after the data that it names. Readers take the last one, so data
of a writer that failed is never seen, and of two writers of the same version the second fails.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def current(spark: SparkSession, path: str) -> tuple[int, list[Row]]:
    """(number, rows) of the last version; 0 and none where nothing was published."""
    try:
        versions = spark.read.parquet(f"{path}/versions")
    except AnalysisException:  # nothing is there
        return 0, []
    last = versions.agg(F.max("version")).first()[0]
    return (0, []) if last is None else (int(last), [r for r in versions.where(F.col("version") == last).collect() if r["name"] is not None])


def publish(spark: SparkSession, path: str, version: int, rows: DataFrame) -> None:
    """rows (name and others) as the version of this number, which must not be there yet. Of an empty version one row without a name stays."""
    rows.coalesce(1).write.mode("error").parquet(f"{path}/versions/version={version}")


def written(spark: SparkSession, path: str) -> bool:
    return current(spark, path)[0] > 0
