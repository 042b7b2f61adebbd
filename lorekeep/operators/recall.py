"""Scans with filters and top-k. Every order ends in the id, so that ties are settled alike everywhere.

A top-k over a whole table is TakeOrdered (each task keeps k rows); one for each group is a ranked window that Spark
limits before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators import scan
from lorekeep.session import checkpointed


def _all(*conditions: Column | None) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out if c is None else out & c
    return out


def _is(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == value


def _between(column: str, since, until) -> Column:
    return _all(None if since is None else F.col(column) >= F.lit(since), None if until is None else F.col(column) <= F.lit(until))


def get_messages(df: DataFrame, person=None, since=None, until=None, limit: int = 50, min_salience: float = 0.0) -> DataFrame:
    return df.where(_all(F.col("salience") >= min_salience, _is("person", person), _between("ts", since, until))).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def get_events(df: DataFrame, kind: str | None = None, person: str | None = None, limit: int = 50) -> DataFrame:
    """The newest events of a type, of a person, or of both."""
    return df.where(_all(_is("event_type", kind), _is("person", person))).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def by_id(df: DataFrame, ids: list) -> DataFrame:
    """Rows with these ids, looked up by the scan's own filter."""
    return df.where(F.col("id").isin(list(ids)))


def tagged(tags: Iterable[str]) -> Column:
    """Whether any of a row's tags is one of tags, whatever the case; null tags are none."""
    return F.coalesce(F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(t.lower()) for t in tags])), F.lit(False))


def get_traces(df: DataFrame, tags=None, kind=None, min_salience: float = 0.0, limit: int = 50) -> DataFrame:
    """The most salient limit rows, and of these the tagged ones; so there may be fewer."""
    top = df.where(_all(F.col("salience") >= min_salience, _is("kind", kind))).orderBy(F.desc("salience"), "id").limit(limit)
    return top.where(tagged(tags)) if tags else top


def get_by_salience(df: DataFrame, person: str | None = None, limit: int = 30) -> DataFrame:
    """Of the 3 * limit most salient rows the first limit that carry person as a tag."""
    top = df.orderBy(F.desc("salience"), "id").limit(3 * limit)
    return (top.where(tagged([person])) if person else top).orderBy(F.desc("salience"), "id").limit(limit)


def recent_per_person(df: DataFrame, k: int = 20, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """The last k rows of each person, with pos from 1 in the order of time."""
    newest = Window.partitionBy("person").orderBy(*[F.desc(c) for c in order])
    oldest = Window.partitionBy("person").orderBy(*order)
    top = df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= k).drop("_rank")
    return top.withColumn("pos", F.row_number().over(oldest))


def in_range(df: DataFrame, since, until, column: str = "ts", person=None, limit: int = 100) -> DataFrame:
    return df.where(_all(_between(column, since, until), _is("person", person))).orderBy(column, "id").limit(limit)


def traces_in_range(df: DataFrame, since, until, limit: int = 50) -> DataFrame:
    return df.where(_between("created", since, until)).orderBy(F.desc("salience"), "id").limit(limit)


def sessions_in_range(sessions: DataFrame, since, until, person=None, limit: int | None = 20) -> DataFrame:
    """Sessions that overlap [since, until]; an open one has no end."""
    fit = _all(F.col("started") <= F.lit(until), (F.col("ended") >= F.lit(since)) | F.col("ended").isNull(), _is("person", person))
    out = sessions.where(fit)
    return out if limit is None else out.orderBy(F.desc("started"), "person").limit(limit)


#: Buckets of one size that a session lies in at most; a longer one is dealt to buckets so many times as long.
MOST_BUCKETS = 32
LEVELS = 4


def overlap_join(sessions: DataFrame, windows: DataFrame, bucket_hours: int = 24) -> DataFrame:
    """Sessions with each window (since, until) that they overlap; a session without an end is still open.

    Both sides are dealt to time buckets, and a pair is kept in its first common one. Long sessions lie in longer buckets,
    so that each is a few rows; windows, the few, are dealt to the buckets of every length.
    """
    sizes = F.array(*[F.lit(bucket_hours * 3600 * MOST_BUCKETS**k).cast("long") for k in range(LEVELS)])
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    last = windows.agg(F.max("until").alias("_last"))  # one row: an open session reaches to the last window's end
    a = sessions.crossJoin(F.broadcast(last)).withColumn("_end", F.coalesce("ended", F.greatest("_last", "started")))
    length = second("_end") - second("started")
    level = sum(((length > bucket_hours * 3600 * MOST_BUCKETS ** (k + 1)).cast("int") for k in range(LEVELS - 1)), F.lit(0))
    a = a.withColumn("_level", level).withColumn("_size", F.element_at(sizes, F.col("_level") + 1))
    at = lambda c: F.floor(second(c) / F.col("_size"))
    a = a.withColumn("_a", at("started")).withColumn("_b", F.explode(F.sequence("_a", at("_end")))).drop("_size")
    w = windows.select("*", F.posexplode(sizes).alias("_level", "_size")).withColumn("_c", at("since")).withColumn("_b", F.explode(F.sequence("_c", at("until"))))
    hit = a.join(w, ["_level", "_b"]).where("started <= until and _end >= since and _b = greatest(_a, _c)")
    return hit.drop("_a", "_b", "_c", "_end", "_last", "_level", "_size")


#: What happens at one instant, in the order in which it counts: a window begins, sessions start, sessions end, a window ends.
BEGINS, STARTS, ENDS, CLOSES = range(4)


def overlap_counts(sessions: DataFrame, windows: DataFrame) -> DataFrame:
    """(wid, n, n_ended): of each window (wid, since, until) that sessions overlap, how many do, and how many of these have an end.

    As counting the pairs of overlap_join, but no pair is made: the sessions that started by a window's end are counted, less
    those that ended before it began. Both numbers are running sums over all starts and ends in the order of time, which are
    dealt to tasks by ranges of time. Neither sessions nor windows end before they begin.
    """
    one, none, closed = F.lit(1).cast("long"), F.lit(0).cast("long"), F.col("ended").isNotNull().cast("long")
    point = lambda at, kind, started, closed, over: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"), started.alias("started"), closed.alias("closed"), over.alias("over"))
    turn = sessions.where("started is not null").select(F.explode(F.array(point("started", STARTS, one, closed, none), point("ended", ENDS, none, none, one))).alias("p"))
    turn = turn.select("p.*").where("at is not null").groupBy("at", "kind").agg(*[F.sum(c).alias(c) for c in ("started", "closed", "over")])
    edge = windows.where("since is not null and until is not null").select("wid", F.explode(F.array(point("since", BEGINS, none, none, none), point("until", CLOSES, none, none, none))).alias("p")).select("wid", "p.*")
    rows = turn.withColumn("wid", F.lit(None).cast(windows.schema["wid"].dataType)).unionByName(edge).repartitionByRange("at", "kind", "wid")
    rows = checkpointed(rows.withColumns({scan.KEY: F.lit(0), scan.AT: F.spark_partition_id(), scan.NTH: F.struct("at", "kind", "wid")}))
    rows = scan.running(rows, {"n_started": (F.sum, "started"), "n_closed": (F.sum, "closed"), "n_over": (F.sum, "over")})
    last = F.col("kind") == CLOSES
    n = lambda c: F.sum(F.when(last, F.col(c)).otherwise(-F.col("n_over")))
    return rows.where(F.col("kind").isin(BEGINS, CLOSES)).groupBy("wid").agg(n("n_started").alias("n"), n("n_closed").alias("n_ended")).where("n > 0")


def with_metadata(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.get_json_object("metadata", f"$.{key}").isNotNull())


def unarchived(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.get_json_object("metadata", "$.archived").cast("int"), F.lit(0)) == 0)


def unconsolidated(df: DataFrame, kinds: list[str], limit: int | None = None) -> DataFrame:
    """Rows of these kinds without a parent, oldest first."""
    free = df.where(F.col("kind").isin(kinds) & F.get_json_object("metadata", "$.consolidated_into").isNull())
    return free if limit is None else free.orderBy("created", "id").limit(limit)


def active_session(sessions: DataFrame) -> DataFrame:
    """The latest open session of each person."""
    return sessions.where("ended is null").groupBy("person").agg(F.max("started").alias("started"))


def recent_sessions(sessions: DataFrame, person: str | None = None, limit: int = 10) -> DataFrame:
    """The sessions that started last, of a person or of all."""
    return sessions.where(_all(_is("person", person))).orderBy(F.desc("started"), "person").limit(limit)


def corrections(traces: DataFrame) -> DataFrame:
    """(id, original, was): traces whose metadata says what they correct, with that trace's salience, null where it is gone."""
    links = traces.select("id", F.get_json_object("metadata", "$.corrects").cast("long").alias("original")).where("original is not null")
    return links.join(traces.select(F.col("id").alias("original"), F.col("salience").alias("was")), "original", "left").select("id", "original", "was")


def tail(df: DataFrame, person: str | None = None, n: int = 20) -> DataFrame:
    """The last n entries of a log, of a person whatever the case, oldest first."""
    own = None if person is None else F.lower("person") == person.lower()
    return df.where(_all(own)).orderBy(F.desc("ts"), F.desc("id")).limit(n).orderBy("ts", "id")
