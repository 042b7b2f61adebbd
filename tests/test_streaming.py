"""Streams over the events table give what the batch operators give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import state, temporal
from lorekeep.plans.knowledge import _feelings
from lorekeep.sources import adapters as ad
from lorekeep.streaming import jobs


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"select * from {name}")


def stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def test_closed_sessions(spark, sf):
    rows = stream(spark, sf).select(F.expr("concat('u', user_id)").alias("person"), F.col("ts").cast("timestamp").alias("ts"))
    got = drain(jobs.closed_sessions(rows), "closed", "append")
    last = ad.messages(spark, sf).agg(F.max("ts")).first()[0]
    batch = temporal.sessions(ad.messages(spark, sf)).where(F.col("ended") <= F.lit(last) - F.expr("interval 4 hours"))  # two of the gap, two of the watermark
    want = {(r["person"], r["started"], r["message_count"]) for r in batch.collect()}
    assert want and want == {(r["person"], r["started"], r["message_count"]) for r in got.collect()}


def test_emotion_stream_equals_fold(spark, sf):
    e = F.col("event_id")
    rows = stream(spark, sf).select(
        F.expr("concat('u', user_id)").alias("person"), F.col("ts").cast("timestamp").alias("ts"), e.alias("id"), (e % 9 / 4 - 1).alias("dv"), (e % 5 / 4 - 0.5).alias("da"), (e % 7 / 6 - 0.5).alias("dd"), (e % 3 / 2).alias("intensity")
    )
    got = {r["person"]: r for r in drain(jobs.emotion_stream(rows), "emotion", "update").collect()}
    want = {r["person"]: r for r in state.emotion_fold(_feelings(spark, sf)).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k]["n"] == r["n"] and got[k]["valence"] == pytest.approx(r["valence"], abs=1e-6) and got[k]["arousal"] == pytest.approx(r["arousal"], abs=1e-6)


def test_windowed_health(spark, sf):
    rows = stream(spark, sf).select(F.col("event_id").alias("id"), F.expr("concat('u', user_id)").alias("person"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 7 / 7).alias("health"))
    got = {(r["person"], r["since"], r["until"]): (round(r["health"], 9), r["n"]) for r in drain(jobs.windowed_health(rows), "health", "append").collect()}
    events = [(f"u{r['user_id']}", r["ts"], r["event_id"] % 7 / 7) for r in ad.table(spark, sf, "events").collect()]
    late, want = max(t for _, t, _ in events) - dt.timedelta(hours=2), {}
    for person, t, health in events:
        first = t.replace(minute=0, second=0, microsecond=0) - dt.timedelta(hours=t.hour % 2)
        for since in (first - dt.timedelta(hours=h) for h in (0, 2, 4)):
            if since + dt.timedelta(hours=6) <= late:
                want.setdefault((person, since, since + dt.timedelta(hours=6)), []).append(health)
    assert got == {k: (round(sum(v) / len(v), 9), len(v)) for k, v in want.items()}
