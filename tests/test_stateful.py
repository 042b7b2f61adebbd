"""Stateful streams over shuffled files of events give what the batch operators give, also after a restart and from a snapshot."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import readmodels, state, temporal
from lorekeep.streaming import stateful

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "person string, ts timestamp, id long, x double, word string"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    for k, v in stateful.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in stateful.STATE_STORE:
        spark.conf.unset(k)


@pytest.fixture(scope="module")
def rows():
    """(person, ts, id, x, word): gaps of exactly two hours among them, ties of time, and a row that comes twice."""
    rng, out, at = random.Random(5), [], {p: BASE for p in "abc"}
    for i in range(240):
        p = rng.choice("abc")
        at[p] += rng.choice([dt.timedelta(0), dt.timedelta(minutes=7), dt.timedelta(hours=2), dt.timedelta(hours=2, microseconds=-1), dt.timedelta(hours=3)])
        out.append((p, at[p], i, rng.randrange(10**6) / 10**6, rng.choice(["idle", "active", "sleep", "w1", "w2", "w3", "w4", "w5", "w6"])))
    return sorted(out, key=lambda r: r[1])


def deliver(rows, folder, names):
    """Files of neighbouring rows, each with a few rows of its neighbours, all within the lateness."""
    n = len(names)
    blocks = [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]
    for b in blocks:
        random.Random(1).shuffle(b)
    for name, b in zip(names, blocks):
        pd.DataFrame(b + b[:1], columns=["person", "ts", "id", "x", "word"]).to_json(f"{folder}/{name}.json", orient="records", lines=True, date_format="iso", date_unit="us")


def drain(spark, folder, job, out, checkpoint):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
    q = job(source).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination(300)


def run(spark, tmp_path, rows, job, runs=1):
    """The stream's rows; a last row far ahead moves the watermark over all others. runs > 1 stops and starts it again."""
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    os.makedirs(folder)
    for i in range(runs):
        part = rows[i * len(rows) // runs : (i + 1) * len(rows) // runs]
        deliver(part, folder, [f"{i}_{k}" for k in range(2)])
        if i == runs - 1:
            deliver([("zz", rows[-1][1] + dt.timedelta(days=9), 10**6, 0.0, "idle")], folder, ["last"])
        drain(spark, str(folder), job, out, mark)
    return [r for r in spark.read.parquet(out).collect() if r[0] != "zz"]


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def feelings(df):
    return df.select("person", "ts", "id", (F.col("x") - 0.5).alias("dv"), (F.col("x") / 3).alias("da"), (0.4 - F.col("x")).alias("dd"), F.lit(0.5).alias("intensity"))


LATE = "12 hours"


def test_sessions_and_restart(spark, tmp_path, rows):
    got = run(spark, tmp_path, rows, lambda s: stateful.session_stream(s, late=LATE), runs=2)
    want = temporal.sessions(batch(spark, rows)).select("person", "started", "ended", "message_count").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 20


def test_workspace(spark, tmp_path, rows):
    steps = lambda s: s.select("person", "ts", "id", F.concat("word", F.col("id") % 5).alias("item"), F.col("x").alias("priority"))
    got = run(spark, tmp_path, rows, lambda s: stateful.workspace_stream(steps(s), late=LATE, capacity=3))
    rank = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[0], r[1], r[2])))}
    renumbered = [(p, t, rank[i], x, w) for p, t, i, x, w in rows]
    steps_of = {rank[r[2]]: r[2] for r in rows}
    b = spark.createDataFrame([(p, i, f"{w}{steps_of[i] % 5}", x) for p, _, i, x, w in renumbered], "person string, id long, item string, priority double")
    want = state.workspace_fold(b, capacity=3).where("reason is not null").collect()
    key = lambda r: (r["person"], r["nth"], r["reason"], r["item"], round(r["priority"], 9), r["age"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and want


def test_due_from_snapshot(spark, tmp_path, rows):
    """A batch sees the first half, its last due checks begin the stream, which sees the rest."""
    wait = {"idle": 3600, "active": 600, "sleep": 0, "w1": 9000}
    checks = lambda s: s.select(F.col("person").alias("key"), "ts", "id", F.col("word").alias("level"))
    half = rows[: len(rows) // 2]
    whole = {r["id"]: r["due"] for r in readmodels.due_runs(checks(batch(spark, rows)), wait).collect()}
    last = {}
    for p, t, i, _, _ in half:
        if whole[i]:
            last[p] = max(last.get(p, t), t)
    first = spark.createDataFrame([(p, t) for p, t in last.items()], "key string, t timestamp").select("key", F.unix_micros("t").alias("last"))
    got = run(spark, tmp_path, rows[len(rows) // 2 :], lambda s: stateful.due_stream(checks(s), wait, late=LATE, first=first))
    assert {r["id"]: r["due"] for r in got} == {r[2]: whole[r[2]] for r in rows[len(rows) // 2 :]}


def test_modes(spark, tmp_path, rows):
    modes = lambda s: s.select("person", "ts", "id", F.substring("word", 1, 1).alias("mode"))
    got = run(spark, tmp_path, rows, lambda s: stateful.mode_stream(modes(s), late=LATE))
    want = temporal.mode_durations(modes(batch(spark, rows))).where("ended is not null").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_moods(spark, tmp_path, rows):
    got = {r["id"]: r for r in run(spark, tmp_path, rows, lambda s: stateful.mood_stream(feelings(s), late=LATE))}
    want = {r["id"]: r for r in state.mood_history(feelings(batch(spark, rows))).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k]["n"], got[k]["mood"]) == (w["n"], w["mood"]) and got[k]["valence"] == pytest.approx(w["valence"], abs=1e-9)
