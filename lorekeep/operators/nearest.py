"""A stored vector index with exact nearest neighbours under filters and by collection.

Vectors are cut into cells by their nearest pivot and laid out in order of (collection, cell, distance to it), so that each
stored part is a thin shell around a pivot. Of each part the least and greatest distance to every pivot is kept. By the
triangle inequality a part whose distances to a pivot lie in [lo, hi] is at least max(lo - d, d - hi) from a query at distance
d of that pivot; parts that cannot reach a query's k-th neighbour are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators.search import MOST_PROBES, squared_l2
from lorekeep.session import checkpointed, shared_folder
from lorekeep.sources import versions

#: Pivots at most, and bytes of the sample that they are chosen from.
MOST_PIVOTS, SAMPLE_BYTES = 256, 64 << 20
#: Rows that a stored part holds, about.
PART_ROWS = 250_000
#: Vectors whose distances are taken together.
SLICE = 512
#: A part is left out only if it is farther by more than what rounding can do.
SLACK = 1e-9


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all vectors to all pivots, in slices that a core's cache holds; by differences, as sums of squares would cancel."""
    out = np.empty((len(vectors), len(pivots)))
    for at in range(0, len(vectors), SLICE):
        some = vectors[at : at + SLICE]
        for j, p in enumerate(pivots):
            apart = some - p
            out[at : at + SLICE, j] = np.einsum("ij,ij->i", apart, apart)
    return np.sqrt(out, out=out)


def _nearest_mean(sample: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Of each vector of the sample a mean that is nearest but for rounding: pivots may be any points, so products of matrices do."""
    own = np.empty(len(sample), np.int64)
    for at in range(0, len(sample), 64 * SLICE):
        own[at : at + 64 * SLICE] = ((means**2).sum(axis=1) - 2 * (sample[at : at + 64 * SLICE] @ means.T)).argmin(axis=1)
    return own


def _choose(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """n means of the sample by Lloyd's rounds from evenly spread rows; a mean that loses all rows stays where it is."""
    means = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(rounds):
        own = _nearest_mean(sample, means)
        order = np.argsort(own, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        means[own[order[begin]]] = np.add.reduceat(sample[order], begin, axis=0) / np.diff(np.r_[begin, len(order)])[:, None]
    return means


@dataclass
class Found:
    """Hits, and how many of how many parts were read for them."""

    hits: DataFrame
    parts_read: int
    parts: int


@dataclass
class VectorIndex:
    """Columns id, vector, collection (null where there is none) and those of the table, in parts under path."""

    spark: SparkSession
    path: str

    @property
    def there(self) -> bool:
        return versions.written(self.spark, self.path)

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", collection: str | None = None, part_rows: int = PART_ROWS) -> VectorIndex:
        """Stores vectors; rows whose vector is null, of another length than most, or with null or non-finite entries are left out.

        A part holds part_rows, or as many as the square root of all rows, so that parts are no more than that root. Pivots come from a sample of SAMPLE_BYTES; every row is stored.
        """
        v = F.col(vector)
        rows = vectors.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).withColumns({
            "_id": F.col(id_col), "_vector": v, "_collection": F.lit(None).cast("string") if collection is None else F.col(collection).cast("string")})
        sizes = rows.groupBy(F.size("_vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
        width, n = (sizes[0]["width"], sizes[0]["count"]) if sizes else (0, 0)
        rows = rows.where(F.size("_vector") == width)
        most = max(MOST_PIVOTS, SAMPLE_BYTES // (8 * max(1, width)))
        picked = rows.select("_vector", F.xxhash64("_id").alias("_h")).orderBy("_h").limit(most).select("_vector").toArrow()["_vector"].combine_chunks()
        sample = np.asarray(picked.flatten(), dtype=np.float64).reshape(len(picked), width) if len(picked) else np.zeros((0, width))
        sample = np.unique(sample, axis=0)
        pivots = _choose(sample, min(len(sample), MOST_PIVOTS, max(1, int(n**0.5) // 2))) if len(sample) else sample

        @F.pandas_udf("struct<cell int, far double>")
        def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for b in batches:
                d = _distances(np.stack(b.to_numpy()).astype(np.float64), pivots)
                cell = d.argmin(axis=1)
                yield pd.DataFrame({"cell": cell.astype("int32"), "far": d[np.arange(len(d)), cell]})

        rows = rows.withColumn("_p", place("_vector")).select("*", F.col("_p.cell").alias("_cell"), F.col("_p.far").alias("_far")).drop("_p")
        order = ["_collection", "_cell", "_far", "_id"]
        laid = rows.repartitionByRange(max(1, -(-n // max(part_rows, int(n**0.5)))), *order).withColumn("_part", F.spark_partition_id())
        laid.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/parts")
        if n:
            self._ranges(pivots).write.mode("overwrite").parquet(f"{self.path}/ranges")
        numbered = [(f"p{i}", [float(x) for x in p]) for i, p in enumerate(pivots)]
        pivot_rows = self.spark.createDataFrame(numbered, "name string, pivot array<double>") if numbered else self.spark.createDataFrame([(None, None)], "name string, pivot array<double>")
        versions.publish(self.spark, self.path, 1, pivot_rows)
        return self

    def _ranges(self, pivots: np.ndarray) -> DataFrame:
        """part, collection, n, lo, hi: by part and collection, distances to every pivot; a task sends a row for each of its own."""

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for b in batches:
                d = _distances(np.stack(b["_vector"].to_numpy()).astype(np.float64), pivots)
                for key, at in b.groupby(["_part", "_cell", "_collection"], dropna=False).indices.items():
                    key = tuple(None if pd.isna(x) else x for x in key)
                    n, lo, hi = held.get(key, (0, np.inf, -np.inf))
                    held[key] = n + len(at), np.minimum(lo, d[at].min(axis=0)), np.maximum(hi, d[at].max(axis=0))
            yield pd.DataFrame([(*k, n, lo, hi) for k, (n, lo, hi) in held.items()], columns=["part", "cell", "collection", "n", "lo", "hi"])

        stored = self._stored().select("_part", "_cell", "_collection", "_vector")
        parts = stored.mapInPandas(measure, "part int, cell int, collection string, n long, lo array<double>, hi array<double>")
        least = lambda f, c: F.array(*[f(F.col(c)[j]) for j in range(len(pivots))]).alias(c)
        return parts.groupBy("part", "cell", "collection").agg(F.sum("n").alias("n"), least(F.min, "lo"), least(F.max, "hi"))

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/parts")

    def search(self, queries: DataFrame, k: int, where: Column | None = None, by_collection: bool = False, collections: list[str] | None = None) -> Found:
        """(query, collection if by_collection, id, distance, rank): the k nearest of each query (query, vector) by squared distance, ties to the smaller id.

        where, on the table's columns, and collections say which rows may be found; with by_collection each collection is
        searched for itself. Queries, MOST_PROBES at most, whose vector is null or of another length find nothing.
        """
        keys = ["query", "collection"] if by_collection else ["query"]
        pivots = [r["pivot"] for r in versions.current(self.spark, self.path)[1]]
        asked = queries.select("query", "vector").limit(MOST_PROBES + 1).collect()
        if len(asked) > MOST_PROBES:
            raise ValueError(f"more than {MOST_PROBES} queries; ask in parts")
        asked = [(r["query"], [float(x) for x in r["vector"]]) for r in asked if pivots and r["vector"] is not None and len(r["vector"]) == len(pivots[0]) and None not in r["vector"]]
        query_type = queries.schema["query"].dataType.simpleString()
        probes = self.spark.createDataFrame(list(enumerate(v for _, v in asked)), "_n int, _probe array<double>")
        names = self.spark.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], f"_n int, query {query_type}")
        stored = self._stored().withColumnRenamed("_collection", "collection") if pivots else None
        if stored is None or not asked:
            id_type = "long" if stored is None else stored.schema["_id"].dataType.simpleString()
            cols = f"query {query_type}, " + ("collection string, " if by_collection else "") + f"id {id_type}, distance double, rank int"
            return Found(self.spark.createDataFrame([], cols), 0, 0)
        if collections is not None:
            stored = stored.where(F.col("collection").isin(collections))
        if where is not None:
            stored = stored.where(where)
        bounds = checkpointed(self._bounds(np.array([v for _, v in asked]), np.array(pivots), collections))
        total = bounds.select("part").distinct().count()
        inner = ["_n", *keys[1:]]
        near = Window.partitionBy(*inner).orderBy("bound", "part", "cell", "collection").rowsBetween(Window.unboundedPreceding, -1)
        # the rows that lie before a shell in a query's order; a round reads shells of rows up to a budget, the next eight times as many
        pending = bounds.withColumn("_before", F.coalesce(F.sum("n").over(near), F.lit(0)))
        hits, read, budget = None, set(), max(k, 1)
        while True:
            now = checkpointed(pending.where(F.col("_before") < budget))
            found = self._nearest(stored, now, probes, k, inner)
            hits = checkpointed(found if hits is None else self._best(hits.drop("rank").unionByName(found.drop("rank")), k, inner))
            read |= {r["part"] for r in now.select("part").distinct().collect()}
            # a k-th hit bounds what else must be read, and all of it is; a query with fewer goes on by budget
            reach = hits.where(F.col("rank") == k).select(*[F.col(c).alias(f"_r{c}") for c in inner], F.sqrt("distance").alias("_reach"))
            same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in inner]
            left = pending.where(F.col("_before") >= budget).join(F.broadcast(reach), same, "left")
            left = left.where(F.col("_reach").isNull() | (F.col("bound") <= F.col("_reach") * (1 + SLACK) + SLACK))
            pending = checkpointed(left.withColumn("_before", F.when(F.col("_reach").isNotNull(), 0).otherwise(F.col("_before"))).drop("_reach", *[f"_r{c}" for c in inner]))
            if pending.isEmpty():
                break
            budget *= 8
        out = hits.join(F.broadcast(names), "_n").select(*keys, "id", "distance", "rank")
        return Found(out, len(read), total)

    def _bounds(self, queries: np.ndarray, pivots: np.ndarray, collections: list[str] | None) -> DataFrame:
        """_n, collection, part, cell, n, bound: how near a shell's rows of a collection can be to each query."""
        to_pivots = _distances(queries, pivots)

        def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    least = np.maximum(np.maximum(np.asarray(r.lo) - to_pivots, to_pivots - np.asarray(r.hi)).max(axis=1), 0.0)
                    yield pd.DataFrame({"_n": np.arange(len(least), dtype="int32"), "collection": r.collection, "part": r.part, "cell": r.cell, "n": r.n, "bound": least})

        ranges = self.spark.read.parquet(f"{self.path}/ranges")
        if collections is not None:
            ranges = ranges.where(F.col("collection").isin(collections))
        return ranges.mapInPandas(bound, "_n int, collection string, part int, cell int, n long, bound double")

    def _nearest(self, stored: DataFrame, shells: DataFrame, probes: DataFrame, k: int, inner: list[str]) -> DataFrame:
        """The k nearest among the rows of the named shells; parts that no shell names are pruned by their folder."""
        parts = sorted(r["part"] for r in shells.select("part").distinct().collect())
        asked = shells.select("_n", F.col("collection").alias("_c"), F.col("part").alias("_part"), F.col("cell").alias("_cell"))
        rows = stored.where(F.col("_part").isin(parts)).join(asked, ["_part", "_cell"]).where(F.col("collection").eqNullSafe(F.col("_c"))).join(F.broadcast(probes), "_n")
        return self._best(rows.select(*inner, F.col("_id").alias("id"), squared_l2(F.col("_vector"), F.col("_probe")).alias("distance")), k, inner)

    def _best(self, rows: DataFrame, k: int, inner: list[str]) -> DataFrame:
        w = Window.partitionBy(*inner).orderBy("distance", "id")
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def kept(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", collection: str | None = None, part_rows: int = PART_ROWS) -> VectorIndex:
    """The index of vectors, read from files, in the shared folder; built where these files have none yet."""
    spark = vectors.sparkSession
    files = vectors.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    one = files.agg(F.sum(F.xxhash64("file_path", "file_size", F.col("file_modification_time").cast("string")).cast("decimal(20,0)")).alias("h"), F.count("*").alias("n")).first()
    name = hashlib.md5(repr((str(one["h"]), one["n"], id_col, vector, collection, part_rows)).encode()).hexdigest()
    index = VectorIndex(spark, f"{shared_folder(spark)}/vector-index/{name}")
    return index if index.there else index.build(vectors, id_col, vector, collection, part_rows)
