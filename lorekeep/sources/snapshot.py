"""Tables that change: a base in buckets by key, a log of what happened since, and a merge of the two.

Reading folds the log over the base. A merge folds once for all: it rewrites the buckets that the log touches and no others,
and publishes them, with how far the log is merged, as the next version. A merge that failed leaves the version as it was,
and one that is run again with nothing new writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.sources import versions

#: What a fold is: (rows of the base, rows of the log that are not merged yet) -> rows as they are now, in the base's columns.
Fold = Callable[[DataFrame, DataFrame], DataFrame]


class Snapshot:
    """The table in a folder. Base and log carry the key; log rows carry seq, a number that rises from write to write."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._load()

    def _load(self) -> None:
        self.version, self.parts = versions.current(self.spark, self.path)
        self.merged = max((r["upto"] for r in self.parts), default=None)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def create(self, base: DataFrame, upto: int = -1) -> Snapshot:
        """Writes the first version; there must be none yet. upto: the log's rows up to this seq are in base already."""
        if self.version:
            raise ValueError(f"{self.path} has a version already")
        self._write(base, range(self.buckets), [], upto)
        return self

    def append(self, log: DataFrame) -> None:
        """Adds rows to the log. What was written for a version that was never published does not count."""
        log.write.mode("append").parquet(f"{self.path}/log")

    def base(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the last version, of some buckets or of all."""
        own = [r["name"] for r in self.parts if buckets is None or r["bucket"] in buckets]
        every = own or [self.parts[0]["name"]]  # for the columns
        rows = self.spark.read.parquet(*[f"{self.path}/{name}" for name in every])
        return rows if own else rows.where("false")

    def pending(self) -> DataFrame | None:
        """The log's rows that are not merged yet; None where there never was a log."""
        try:
            log = self.spark.read.parquet(f"{self.path}/log")
        except AnalysisException:
            return None
        return log.where(F.col("seq") > self.merged)

    def read(self, fold: Fold) -> DataFrame:
        """The table as it is now."""
        log = self.pending()
        return self.base() if log is None else fold(self.base(), log)

    def merge(self, fold: Fold) -> int:
        """Folds the log into the base; how many buckets were rewritten."""
        log = self.pending()
        if log is None:
            return 0
        last = log.agg(F.max("seq")).first()[0]
        if last is None:
            return 0
        log = log.where(F.col("seq") <= last)  # what comes meanwhile is left to the next merge
        touched = sorted(r["b"] for r in log.select(self._bucket().alias("b")).distinct().collect())  # a row a bucket at most
        stay = [(r["name"], r["bucket"]) for r in self.parts if r["bucket"] not in touched]
        return self._write(fold(self.base(touched), log), touched, stay, last)

    def _write(self, rows: DataFrame, buckets, stay: list, upto: int) -> int:
        name = f"base/v{self.version + 1}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{name}")
        there = {r["_bucket"] for r in self.spark.read.parquet(f"{self.path}/{name}").select("_bucket").distinct().collect()} if not rows.isEmpty() else set()
        parts = [*stay, *((f"{name}/_bucket={b}", b) for b in buckets if b in there)] or [(name, -1)]
        table = self.spark.createDataFrame([(n, b, upto) for n, b in parts], "name string, bucket int, upto long")
        versions.publish(self.spark, self.path, self.version + 1, table)
        self._load()
        return len(list(buckets))
