"""The stored vector index against plain loops: filters, collections, copies, bad rows, and how much it reads."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators.nearest import VectorIndex

SCHEMA = "vec_id long, embedding array<float>, topic string, weight int"


@pytest.fixture(scope="module")
def rows():
    """Twelve clusters, a third of all rows the same vector, and rows that cannot take part."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 20
    out = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=6)], [None, "x", "y"][i % 3], i % 7) for i in range(800)]
    out += [(1000 + i, out[5][1], "x", i % 7) for i in range(400)]
    return out + [(2000, None, "x", 1), (2001, [1.0] * 5 + [float("nan")], "x", 1), (2002, [1.0] * 5 + [None], "y", 1), (2003, [1.0, 2.0], "y", 1), (2004, [1.0] * 5 + [math.inf], "y", 1)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return VectorIndex(spark, str(tmp_path_factory.mktemp("index"))).build(spark.createDataFrame(rows, SCHEMA).repartition(3), collection="topic", part_rows=50)


def brute(rows, queries, k, keep=lambda r: True, by=None):
    out, good = [], [r for r in rows if r[1] is not None and len(r[1]) == 6 and all(x is not None and math.isfinite(x) for x in r[1]) and keep(r)]
    for q, v in queries:
        for c in {by(r) for r in good} if by else [None]:
            near = sorted((sum((a - b) ** 2 for a, b in zip(r[1], v)), r[0]) for r in good if by is None or by(r) == c)[:k]
            out += [(q, c, i, round(d, 6), n) for n, (d, i) in enumerate(near, 1)]
    return sorted(out, key=repr)


def got(found, by=False):
    return sorted(((r["query"], r["collection"] if by else None, r["id"], round(r["distance"], 6), r["rank"]) for r in found.hits.collect()), key=repr)


QUERIES = [("near", 3), ("copies", 5), ("other", 40)]


def asked(spark, rows):
    some = [(name, rows[i][1]) for name, i in QUERIES] + [("far", [1000.0, 0.0, 0.0, -1000.0, 0.0, 0.0])]
    return some, spark.createDataFrame([*some, ("none", None), ("short", [1.0])], "query string, vector array<double>")


def test_all(spark, index, rows):
    some, df = asked(spark, rows)
    assert got(index.search(df, 7)) == brute(rows, some, 7)


def test_filter_and_collections(spark, index, rows):
    some, df = asked(spark, rows)
    assert got(index.search(df, 5, where=(F.col("weight") == 2) & (F.col("topic") == "y"))) == brute(rows, some, 5, lambda r: r[3] == 2 and r[2] == "y")
    assert got(index.search(df, 5, where=F.col("vec_id") < 3)) == brute(rows, some, 5, lambda r: r[0] < 3)  # fewer than asked
    assert got(index.search(df, 4, by_collection=True), True) == brute(rows, some, 4, by=lambda r: r[2])
    assert got(index.search(df, 4, collections=["x"])) == brute(rows, some, 4, lambda r: r[2] == "x")
    assert index.search(df, 4, where=F.col("weight") == 99).hits.count() == 0


def test_reads_few_parts(spark, index, rows):
    found = index.search(spark.createDataFrame([("q", rows[3][1])], "query string, vector array<double>"), 5)
    assert found.hits.count() == 5 and 0 < found.parts_read <= found.parts // 3
    files = found.hits.inputFiles()
    assert not files  # the hits are cut from their lineage


def test_hot_vector_is_dealt_out(spark, index):
    sizes = [r["count"] for r in index._stored().groupBy("_part").count().collect()]
    assert max(sizes) < 200  # 401 rows are the same vector


def test_empty(spark, tmp_path):
    empty = VectorIndex(spark, str(tmp_path / "e")).build(spark.createDataFrame([], SCHEMA))
    assert empty.there and empty.search(spark.createDataFrame([("q", [1.0])], "query string, vector array<double>"), 3).hits.count() == 0


def test_parts_are_no_more_than_the_root_of_all_rows(spark, rows, tmp_path):
    """However few rows a part may hold: a file for every few rows would make the files grow as the table does."""
    small = VectorIndex(spark, str(tmp_path / "s")).build(spark.createDataFrame(rows, SCHEMA), collection="topic", part_rows=2)
    assert 20 <= small._stored().select("_part").distinct().count() <= 36  # 1200 rows
    some, df = asked(spark, rows)
    assert got(small.search(df, 5, where=F.col("weight") == 2)) == brute(rows, some, 5, lambda r: r[3] == 2)
    assert got(small.search(df, 4, by_collection=True), True) == brute(rows, some, 4, by=lambda r: r[2])
