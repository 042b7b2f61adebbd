"""Ordered analytics: sessions by gaps, segments, clusters, and rolling windows over a person's readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import ladder
from lorekeep.operators import scan


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def gap_groups(df: DataFrame, keys: list[str], ts: str, hours: float, name: str, inclusive: bool = False, order: tuple[str, ...] = ("id",), hot_rows: int | None = None) -> DataFrame:
    """df with name, counted from 0 within keys: a gap over hours (or of hours, if inclusive) starts the next one. A null time is no gap."""
    return _gaps(df, keys, ts, hours, name, inclusive, order, hot_rows).drop("_place")


def _gaps(df: DataFrame, keys: list[str], ts: str, hours: float, name: str, inclusive: bool, order: tuple[str, ...], hot_rows: int | None) -> DataFrame:
    """gap_groups, with _place, each row's place in its group, from 0. A hot key's rows are read in chunks."""
    limit = int(hours * 3_600_000_000)

    def new(w) -> Column:
        gap = F.coalesce(micros(ts) - F.lag(micros(ts)).over(w), F.lit(0))
        return F.when(gap >= limit if inclusive else gap > limit, 1).otherwise(0)

    def cold(rows):
        w = Window.partitionBy(*keys).orderBy(ts, *order)
        rows = rows.withColumn("_new", new(w)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
        return rows.withColumn("_place", (F.row_number().over(Window.partitionBy(*keys, name).orderBy(ts, *order)) - 1).cast("long"))

    def hot(rows):
        rows = scan.in_chunks(scan.numbered(rows, keys, [ts, *order]), halo=1)
        rows = scan.without_halo(rows.withColumn("_new", new(scan.in_order())))
        begins = F.when((F.col("_new") == 1) | (F.col(scan.NTH) == 1), F.col(scan.NTH))
        rows = scan.running(rows.withColumn("_begins", begins), {name: (F.sum, "_new"), "_first": (F.max, "_begins")})
        return scan.plain(rows.withColumn("_place", F.col(scan.NTH) - F.col("_first")), "_new", "_begins", "_first")

    return scan.by_heat(df, keys, cold, hot, hot_rows)


def sessions(messages: DataFrame, hours: float = 2.0, hot_rows: int | None = None) -> DataFrame:
    """person, session, started, ended, message_count; a gap of hours ends a session."""
    grouped = gap_groups(messages, ["person"], "ts", hours, "session", inclusive=True, hot_rows=hot_rows)
    return grouped.groupBy("person", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("message_count"))


def segments(messages: DataFrame, size: int = 30, hours: float = 2.0, hot_rows: int | None = None) -> DataFrame:
    """messages with session and part: a gap over hours or size messages start the next part."""
    grouped = _gaps(messages, ["person"], "ts", hours, "session", False, ("id",), hot_rows)
    return grouped.withColumn("part", F.floor(F.col("_place") / size).cast("long")).drop("_place")


def rolling_health(readings: DataFrame, window: int = 50, hot_rows: int | None = None) -> DataFrame:
    """readings (person, ts, id, health) with recent_health, trend and recovery_rate over the last window readings."""

    def rolled(rows: DataFrame, w, nth: Column) -> DataFrame:
        recent, before = F.avg("health").over(w.rowsBetween(-4, 0)), F.avg("health").over(w.rowsBetween(-9, -5))
        diff = recent - before
        trend = F.when(diff > 0.05, "improving").when(diff < -0.05, "declining").otherwise("stable")
        last = F.lag("health").over(w)
        rise = F.when((last < 0.5) & (F.col("health") > last), F.col("health") - last)
        out = rows.withColumns({"nth": nth, "recent_health": recent, "trend": trend, "_rise": rise})
        # within the last window readings there are window - 1 steps
        rate = F.coalesce(F.avg("_rise").over(w.rowsBetween(2 - window, 0)), F.lit(0.0))
        return out.withColumn("recovery_rate", F.when(F.col("nth") < 3, 0.0).otherwise(rate)).drop("_rise")

    def cold(rows):
        w = Window.partitionBy("person").orderBy("ts", "id")
        return rolled(rows, w, F.row_number().over(w).cast("long"))

    def hot(rows):
        rows = scan.in_chunks(scan.numbered(rows, ["person"], ["ts", "id"]), halo=max(window, 10))
        return scan.plain(scan.without_halo(rolled(rows, scan.in_order(), F.col(scan.NTH))))

    return scan.by_heat(readings, ["person"], cold, hot, hot_rows)


def last_k(df: DataFrame, k: int, keys: tuple[str, ...] = ("person",), order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """The last k rows of each key, with back (1 the newest) and kept (how many of the key there are)."""
    w = Window.partitionBy(*keys)
    top = df.withColumn("back", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).where(F.col("back") <= k)
    return top.withColumn("kept", F.count("*").over(w))


def confidence_report(df: DataFrame, value: str = "confidence", k: int = 10) -> DataFrame:
    """By person, over the last k values: average, trend of the later half against the earlier, and how many are high or low."""
    top = last_k(df, k)
    early = F.col("back") > F.col("kept") - F.floor(F.col("kept") / 2)  # the earlier half is the smaller
    agg = top.groupBy("person").agg(
        F.avg(value).alias("a"), F.avg(F.when(early, F.col(value))).alias("first"), F.avg(F.when(~early, F.col(value))).alias("second"), F.count("*").alias("n"),
        F.count(F.when(F.col(value) > 0.7, 1)).alias("high"), F.count(F.when(F.col(value) < 0.4, 1)).alias("low"),
    )
    trend = ladder(((F.col("n") >= 4) & (F.col("second") > F.col("first") + 0.1), "increasing"), ((F.col("n") >= 4) & (F.col("second") < F.col("first") - 0.1), "decreasing"), otherwise="stable")
    return agg.select("person", F.round("a", 4).alias("average"), trend.alias("trend"), "high", "low")


def solidification(df: DataFrame, value: str = "belief", k: int = 10) -> DataFrame:
    """By person: average of all and of the last k values, whether these are better, whether they are solid, and how many
    readings were no longer aligned (a drift of 0.5 or more)."""
    rank = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("ts"), F.desc("id")))
    agg = df.withColumn("_back", rank).groupBy("person").agg(F.count("*").alias("total"), F.avg(value).alias("a"), F.avg(F.when(F.col("_back") <= k, F.col(value))).alias("r"), F.count(F.when(1 - F.col(value) >= 0.5, 1)).alias("reinforcements_needed"))
    return agg.select(
        "person", "total", F.round("a", 4).alias("average_belief"), F.round("r", 4).alias("recent_average"), F.when(F.col("r") > F.col("a") + 1e-12, "improving").otherwise("stable").alias("trend"),
        F.when(F.col("r") > 0.8, "solid").otherwise("developing").alias("status"), "reinforcements_needed",
    )


def belief_evolution(df: DataFrame, value: str = "belief", k: int = 50) -> DataFrame:
    """By person: how many values there were, their average, least and greatest, and the last k of them, oldest first."""
    newest = Window.partitionBy("person").orderBy(F.desc("ts"), F.desc("id"))
    rows = df.withColumn("_back", F.row_number().over(newest))
    scores = F.transform(F.array_sort(F.collect_list(F.when(F.col("_back") <= k, F.struct("ts", "id", F.col(value).alias("v"))))), lambda x: x["v"])
    return rows.groupBy("person").agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("average"), F.round(F.min(value), 4).alias("least"), F.round(F.max(value), 4).alias("greatest"), scores.alias("scores"))


def stability(events: DataFrame, k: int = 10) -> DataFrame:
    """By person: mean size of the last k valence and arousal changes, in words; under 5 events say nothing."""
    agg = last_k(events, k).groupBy("person").agg(F.avg(F.abs("valence_delta") + F.abs("arousal_delta")).alias("m"), F.count("*").alias("n"))
    m = F.col("m")
    word = ladder((F.col("n") < 5, "insufficient_data"), (m < 0.1, "very_stable"), (m < 0.2, "stable"), (m < 0.4, "moderate"), otherwise="volatile")
    return agg.select("person", F.round("m", 6).alias("mean_change"), word.alias("stability"))


def value_trend(df: DataFrame, value: str, k: int = 5) -> DataFrame:
    """By person: the last of the last k values against the first of them."""
    top = last_k(df, k).groupBy("person").agg(F.max_by(value, F.col("back")).alias("first"), F.min_by(value, F.col("back")).alias("last"), F.count("*").alias("n"))
    d = F.col("last") - F.col("first")
    return top.select("person", ladder((F.col("n") < 2, "insufficient_data"), (d > 0.1, "improving"), (d < -0.1, "declining"), otherwise="stable").alias("trend"))


def mode_durations(transitions: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """person, mode, started, ended, seconds of each stay; setting the mode that is on changes nothing, and the last stay is open.

    A person with more than hot_rows transitions is read in chunks that overlap by a row: once to find the changes, and once
    backwards over the changes alone to find where each stay ends.
    """
    changed = "_was is null or _was <> mode"

    def cold(rows):
        w = Window.partitionBy("person").orderBy("ts", "id")
        return rows.withColumn("_was", F.lag("mode").over(w)).where(changed).withColumn("ended", F.lead("ts").over(w)).drop("_was")

    def before(rows, order, column, name):
        """The column of the row before, in the order; rows of hot people."""
        chunks = scan.in_chunks(scan.numbered(rows, ["person"], order), halo=1)
        return scan.plain(scan.without_halo(chunks.withColumn(name, F.lag(column).over(scan.in_order()))))

    def hot(rows):
        changes = before(rows, [F.col("ts"), F.col("id")], "mode", "_was").where(changed).drop("_was")
        return before(changes, [F.desc("ts"), F.desc("id")], "ts", "ended")

    stays = scan.by_heat(transitions.select("person", "mode", "ts", "id"), ["person"], cold, hot, hot_rows)
    return stays.select("person", "mode", F.col("ts").alias("started"), "ended", F.round((micros("ended") - micros("ts")) / 1e6, 1).alias("seconds"))
