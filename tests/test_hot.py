"""Hot keys: all events under one person (and a few of others, and of nobody) give what an ordinary window gives, in many tasks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.operators import budget, fold, readmodels, rollup, scan, state, temporal
from lorekeep.plans.knowledge import _feelings
from lorekeep.sources import adapters as ad

NEVER, SOON = 10**9, 40


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", 64)


@pytest.fixture(scope="module")
def events(spark, sf):
    """Nearly all rows belong to one person, thirty each to another and to a null one; some times are null or equal."""
    rows = ad.messages(spark, sf)
    who = F.when(F.col("id") % 33 == 1, "b").when(F.col("id") % 33 != 2, "a")
    ts = F.when(F.col("id") % 41 == 0, None).when(F.col("id") % 17 == 0, F.date_trunc("day", "ts").cast("timestamp_ntz")).otherwise(F.col("ts"))
    return rows.withColumns({"person": who, "ts": ts})


def rows_of(df, digits=7):
    """Rows with rounded numbers: chunks add in another order."""
    one = lambda v: round(v, digits) + 0.0 if isinstance(v, float) else v
    cols = sorted(df.columns)
    return sorted((tuple(one(r[c]) for c in cols) for r in df.collect()), key=repr)


def same(make):
    want, got = rows_of(make(NEVER)), rows_of(make(SOON))
    assert want and got == want


def test_gap_groups(events):
    for hours, inclusive in ((2.0, True), (0.5, False), (1000.0, False)):
        same(lambda n: temporal.gap_groups(events, ["person"], "ts", hours, "session", inclusive, hot_rows=n))
    same(lambda n: temporal.sessions(events, hot_rows=n))


def test_segments(events):
    same(lambda n: temporal.segments(events, 7, 0.5, hot_rows=n))
    same(lambda n: temporal.segments(events, 30, 10_000.0, hot_rows=n))


@pytest.mark.parametrize("window", [50, 3])
def test_rolling_health(events, window):
    readings = events.select("person", "ts", "id", (F.col("id") * 31 % 97 / 97).alias("health"))
    same(lambda n: temporal.rolling_health(readings, window, hot_rows=n))


def test_feelings_of_one_person(spark, sf):
    rows = _feelings(spark, sf).withColumn("person", F.when(F.col("id") % 20 > 0, "a"))
    same(lambda n: state.emotion_fold(rows, hot_rows=n))
    same(lambda n: state.mood_history(rows, hot_rows=n))
    assert state.mood_history(rows, last=5, hot_rows=SOON).count() == 10


def test_knapsack_in_rounds(spark):
    items = spark.range(3000).select("id", F.lit("k").alias("tag"), (F.col("id") * 7919 % 1000 / 1000).alias("salience"), (F.col("id") * 104729 % 97 + 1).alias("tokens"))
    items = items.unionByName(spark.range(50).select("id", F.lit("few").alias("tag"), F.lit(0.5).alias("salience"), (F.col("id") + 30).alias("tokens")))
    for most in (5000, 100, 1, 10**7):
        want = rows_of(budget.knapsack(items, most, ("tag",), hot_rows=NEVER))
        assert want == rows_of(budget.knapsack(items, most, ("tag",), hot_rows=SOON))


def test_numbers_are_those_of_a_window(events):
    got = scan.numbered(events, ["person"], ["ts", "id"])
    want = events.withColumn("nth", F.row_number().over(Window.partitionBy("person").orderBy("ts", "id")))
    assert {(r["id"], r[scan.NTH]) for r in got.collect()} == {(r["id"], r["nth"]) for r in want.collect()}
    chunks = scan.in_chunks(got, halo=5)
    assert chunks.where(scan.HALO).groupBy(scan.KEY, scan.AT).count().agg(F.max("count")).first()[0] == 5
    assert chunks.where(~F.col(scan.HALO)).groupBy(scan.KEY, scan.AT).count().agg(F.max("count")).first()[0] == 64


def test_no_hot_key_adds_nothing(events):
    assert scan.hot_keys(events, ["person"], NEVER) is None
    assert {r[scan.KEY]["person"] for r in scan.hot_keys(events, ["person"], SOON).collect()} == {"a"}


def test_long_chain_of_links(spark):
    links = spark.range(1, 1500).select("id", (F.col("id") - 1).alias("parent"))
    got = rollup.lineage(links)
    assert got.count() == 1499 * 1500 // 2 and got.where("id - ancestor <> depth").count() == 0


def test_links_that_go_round(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 6), (7, None), (8, 7)], "id long, parent long")
    got = {(r["id"], r["ancestor"], r["depth"]) for r in rollup.lineage(links).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (2, 1, 2), (3, 1, 1), (3, 2, 2), (4, 3, 1), (4, 1, 2), (4, 2, 3), (5, 4, 1), (5, 3, 2), (5, 1, 3), (5, 2, 4), (8, 7, 1)}
    assert rollup.lineage(links.where("false")).count() == 0


@pytest.mark.parametrize("unit", [1, 3600, 40_000])
def test_due_runs(events, unit):
    """Waits from none to longer than many chunks; levels without a wait, null levels, repeated rows."""
    level = F.when(F.col("id") % 3 == 0, "slow").when(F.col("id") % 3 == 1, "quick").when(F.col("id") % 5 == 0, "now").when(F.col("id") % 5 != 1, "other")
    checks = events.select(F.col("person").alias("key"), "ts", "id", level.alias("level"))
    checks = checks.unionByName(checks.where("id % 50 = 0"))
    interval = {"slow": 10 * unit, "quick": 2 * unit, "now": 0}
    same(lambda hot: readmodels.due_runs(checks, interval, hot_rows=hot))


def test_a_fold_after_a_join_deals_its_own_rows(spark):
    """A fold deals rows itself, also where a join on the same keys has dealt them."""
    left = spark.range(0, 20_000, 1, 8).select((F.col("id") % 3).alias("k"), "id")
    right = spark.range(50_000).groupBy((F.col("id") % 3).alias("k")).agg(F.count("*").alias("one"))
    count = fold.ordered_fold(left.join(right.hint("merge"), "k", "left"), ["k"], ["id"], ["id"], lambda: 0, lambda n, i: (n + 1, ()), lambda n: [(n,)], "n long")
    assert "REPARTITION_BY_COL" in count._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["k"], r["n"]) for r in count.collect()) == [(0, 6667), (1, 6667), (2, 6666)]


def test_due_runs_of_one_key(spark):
    """Checks a minute apart under one key: those ten minutes after the last due one are due, in whatever chunk they stand."""
    rows = spark.range(3000).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), "id", F.lit("slow").alias("level"))
    got = {r["id"]: r["due"] for r in readmodels.due_runs(rows, {"slow": 600}, hot_rows=SOON).collect()}
    assert got == {i: i % 10 == 0 for i in range(3000)}
    assert readmodels.due_runs(rows.where("false"), {"slow": 600}, hot_rows=SOON).count() == 0


def test_mode_durations(events):
    """Modes that last for a row, for many chunks, and some that are null."""
    i = F.col("id")
    mode = F.when(i % 29 == 0, None).when(i % 7 < 3, "a").when(i > 500, "b").otherwise(F.concat(F.lit("m"), (i % 3).cast("string")))
    same(lambda hot: temporal.mode_durations(events.withColumn("mode", mode), hot_rows=hot))
    same(lambda hot: temporal.mode_durations(events.withColumn("mode", F.when(i > 700, "late").otherwise("early")), hot_rows=hot))
