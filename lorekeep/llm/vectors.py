"""Approximate nearest neighbours with balanced posting lists.

Centroids come from k-means over a bounded sample. A vector joins the list of
its nearest centroid and, at a boundary, of others about as near. Lists are
balanced by splitting: a long one is as many blocks as it needs, and a query
reads them all. Centroids are found by walking a graph of them in memory. A
query reads its nearest lists until they hold enough candidates, and those within a
ratio of the last one's distance, and scores their original vectors in double
precision. A query that still finds too few reads every list. Lists are of vectors of one length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import Shared, durable, join_hot

#: Vectors that the centroids are fitted on at most, and how many centroids there are at most.
SAMPLE, MAX_LISTS = 20_000, 4096
#: Vectors a list should have in a small table; in a large one lists and their vectors both grow with the square root of their product.
LIST = 128
#: Vectors of a list, and queries of it, that meet in one task, at most about.
BLOCK, ASKS = 4096, 4096
#: Lists that a vector joins, and how much farther their centroids may be than the nearest.
COPIES, BOUNDARY = 4, 1.1
#: Lists that a query reads at first, and how much farther their centroids may be than the last one it needs.
PROBES, RATIO = 48, 1.6
K = 10


class CentroidGraph:
    """Centroids, each linked to its nearest ones and to a few far ones."""

    def __init__(self, centroids: np.ndarray, links: int = 16):
        self.x = centroids
        n = len(centroids)
        d = squared(centroids, centroids)
        near = np.argsort(d, axis=1, kind="stable")[:, : min(n, links + 1)]
        far = np.random.default_rng(1).integers(0, n, (n, 4))
        self.links = np.column_stack([near, far])
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 24)).astype(int))

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(number, distance) of about the k nearest centroids of each row of q, nearest first, by best-first walks for all rows at once."""
        n, width = len(self.x), min(len(self.x), max(k, 32))
        seen = np.zeros((len(q), n), bool)
        found, dist = np.tile(self.entry, (len(q), 1)), squared(q, self.x[self.entry])
        seen[:, self.entry] = True
        done = np.zeros(found.shape, bool)
        rows = np.arange(len(q))
        for _ in range(4 * width):
            step = np.where(done, np.inf, dist)
            best = step.argmin(axis=1)
            if not np.isfinite(step[rows, best]).any():
                break
            go = np.isfinite(step[rows, best])
            done[rows, best] = True
            nxt = self.links[found[rows, best]]
            fresh = go[:, None] & ~seen[rows[:, None], nxt]
            # a link named twice counts once
            order = np.sort(nxt, axis=1)
            twice = (order[:, 1:] == order[:, :-1]).any()
            if twice:
                for c in range(1, nxt.shape[1]):
                    fresh[:, c] &= ~(nxt[:, :c] == nxt[:, c : c + 1]).any(axis=1)
            seen[rows[:, None], nxt] = True
            diff = self.x[nxt] - q[:, None, :]
            d = np.where(fresh, np.einsum("ijk,ijk->ij", diff, diff), np.inf)
            found, dist = np.column_stack([found, nxt]), np.column_stack([dist, d])
            done = np.column_stack([done, ~fresh])
            if found.shape[1] > width:
                top = np.argpartition(dist, width - 1, axis=1)[:, :width]
                found, dist, done = (np.take_along_axis(a, top, axis=1) for a in (found, dist, done))
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(found, order, axis=1), np.sqrt(np.take_along_axis(dist, order, axis=1))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids of the distinct rows of x; an empty one moves to a row far from its own."""
    x = np.unique(x, axis=0)
    r = np.random.default_rng(0)
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own, gap = np.empty(len(x), int), np.empty(len(x))
        for at in range(0, len(x), 4096):
            d = squared(x[at : at + 4096], c)
            own[at : at + 4096], gap[at : at + 4096] = d.argmin(1), d.min(1)
        n = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        have = np.flatnonzero(n)
        c[have] = np.add.reduceat(x[order], (np.cumsum(n) - n)[have]) / n[have, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-gap, kind="stable")[: len(empty)]]
    return c


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(row, vec_id, v, dim): rows with a finite vector other than zero, numbered."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return durable(rows.where(fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _fit(rows: DataFrame) -> tuple[dict, int]:
    """({length: (first list, graph)}, number of lists) from a bounded sample; a length that the sample lacks has one list, -length."""
    n = rows.count()
    if not n:
        return {}, 0
    share = min(1.0, SAMPLE / n)
    chance = F.xxhash64("row", "vec_id")
    sample = rows.where(F.pmod(chance, F.lit(1 << 30)) < F.lit(share * (1 << 30))).orderBy(chance, "row").limit(2 * SAMPLE).select("v").collect()
    of: dict = {}
    for r in sample:
        of.setdefault(len(r["v"]), []).append(r["v"])
    graphs, lists = {}, 0
    for dim, own in sorted(of.items()):
        have = n * len(own) / len(sample)
        k = max(1, min(MAX_LISTS, math.ceil(max(min(have / LIST, 1024), math.sqrt(have))), len(own)))
        graph = CentroidGraph(kmeans(np.array(own), k))
        graphs[dim] = (lists, graph)
        lists += len(graph.x)
    return graphs, lists


def nearest_neighbours(vectors: DataFrame, queries, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id fits queries (a Column over vec_id).

    Distances are Euclidean over the original vectors in double precision, ties go to the smaller vec_id. Vectors that are
    null, zero or not finite take no part, nor does a null vec_id. A vector's neighbours are vectors of its own length.
    Repeated rows are candidates of their own, but a query finds no row with its own vec_id, and rows that share a vec_id
    ask as one query. With fewer candidates than k all found are returned; an empty table gives no rows.
    """
    rows = _usable(vectors, vec_id, embedding)
    graphs, lists = _fit(rows)
    if not graphs:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = Shared(vectors.sparkSession, graphs)

    def near(copies: int, ratio: float, held: np.ndarray | None = None):
        def run(batches):
            graphs = shared.value
            for b in batches:
                dims = b.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    own = b.filter(pa.array(dims == dim))
                    for at in range(0, own.num_rows, 1024):
                        yield lists_of(own.slice(at, 1024), dim, graphs.get(dim))

        def lists_of(part, dim, found):
            if found is None:
                row, number, home = np.arange(part.num_rows), np.full(part.num_rows, -dim), np.ones(part.num_rows, bool)
            else:
                number, d = found[1].nearest(_matrix(part.column("v")), copies)
                number = number + found[0]
                most = d[:, :1]
                if held is not None:  # the distance within which lists hold k vectors beside the query's own
                    enough = np.cumsum(np.where(np.isfinite(d), held[number], 0), axis=1) > k
                    most = np.where(enough.any(axis=1), d[np.arange(len(d)), enough.argmax(axis=1)], np.inf)[:, None]
                row, col = np.nonzero(np.isfinite(d) & (d <= most * ratio))
                number, home = number[row, col], col == 0
            at = pa.array(row)
            return pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("row", "vec_id", "v", "dim")), pa.array(number.astype(np.int32)), pa.array(home)], ["row", "vec_id", "v", "dim", "list", "home"])

        return run

    schema = "row long, vec_id long, v array<double>, dim int, list int, home boolean"
    members = durable(rows.mapInArrow(near(COPIES, BOUNDARY), schema))
    # a long list is split into blocks by a hash; all of a list's blocks are read, and so are the queries that read it
    sizes = members.groupBy("list").agg(F.count("*").alias("count"), F.count_distinct(F.when(F.col("home"), F.col("vec_id"))).alias("ids"), F.first("dim").alias("dim"))
    sizes = durable(sizes.select("list", "dim", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"), "ids"))
    held = np.zeros(lists, np.int64)  # distinct vec_ids whose nearest list it is: boundary copies do not count
    for r in sizes.where("list >= 0").collect():
        held[r["list"]] = r["ids"]
    wanted = rows.where(queries)

    def score(a: pa.Table, m: pa.Table) -> pa.Table:
        qi, mi, mr = a.column("vec_id").to_numpy(), m.column("vec_id").to_numpy(), m.column("row").to_numpy()
        out = []
        if len(qi) and len(mi):
            q, x = _matrix(a.column("v").combine_chunks()), _matrix(m.column("v").combine_chunks())
            for i in range(len(qi)):
                other = np.flatnonzero(mi != qi[i])
                d = np.sqrt(((x[other] - q[i]) ** 2).sum(axis=1))
                if len(other) > 4 * k:  # ties with the k-th distance stay
                    stay = d <= np.partition(d, k - 1)[k - 1]
                    other, d = other[stay], d[stay]
                top = np.lexsort((mr[other], mi[other], d))[:k]
                out += [(int(qi[i]), int(mr[other[t]]), int(mi[other[t]]), float(d[t])) for t in top]
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.table({n: pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in zip(("query_id", "row", "vec_id", "score"), cols)})

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id", "row"))

    def best(asks: DataFrame, members: DataFrame) -> DataFrame:
        asks = durable(asks)
        split = sizes.join(asks.groupBy("list").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts")), "list").select("list", "blocks", "parts")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        dealt = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int")
        asks = join_hot(asks, split, "list").withColumns({"part": dealt("parts"), "block": every("blocks")})
        members = join_hot(members, split, "list").withColumns({"block": dealt("blocks"), "part": every("parts")})
        keys = ["list", "block", "part"]
        side = lambda df: df.select(*[F.col(c).alias(c) for c in (*keys, "row", "vec_id", "v")]).groupBy(keys)
        found = side(asks).cogroup(side(members)).applyInArrow(score, "query_id long, row long, vec_id long, score double").distinct()
        return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = durable(best(wanted.mapInArrow(near(PROBES, RATIO, held), schema), members))
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = durable(wanted.join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return found
    # these are few, unless the table itself is small; every list of vectors of their length is read for them
    again = best(short.join(sizes.select("dim", "list"), "dim").withColumn("home", F.lit(True)).select("row", "vec_id", "v", "dim", "list", "home"), members.where("home"))
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(again)


def op9(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """nearest_neighbours of every vector whose id 100 divides; nulls, repeated rows, ties and empty tables as there."""
    return nearest_neighbours(vectors, F.col("vec_id") % 100 == 0)
