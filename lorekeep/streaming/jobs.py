"""Structured Streaming forms: closed sessions, windowed health, and emotion kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def closed_sessions(messages: DataFrame, gap: str = "2 hours", late: str = "2 hours") -> DataFrame:
    """person, started, last_seen_by, message_count of sessions that the watermark has passed; ts is a timestamp."""
    windowed = messages.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "person")
    return windowed.agg(F.count("*").alias("message_count")).select("person", F.col("w.start").alias("started"), F.col("w.end").alias("last_seen_by"), "message_count")


def windowed_health(readings: DataFrame, size: str = "6 hours", slide: str = "2 hours", late: str = "2 hours") -> DataFrame:
    """person, since, until, health, n over sliding windows; readings later than the watermark are dropped, repeated ids count once."""
    rows = readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    out = rows.groupBy(F.window("ts", size, slide).alias("w"), "person").agg(F.avg("health").alias("health"), F.count("*").alias("n"))
    return out.select("person", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "health", "n")


def emotion_stream(events: DataFrame, decay: tuple[float, float, float] = (0.9, 0.7, 0.8)) -> DataFrame:
    """person, n, valence, arousal, dominance after each batch's events (person, ts, id, dv, da, dd, intensity).

    The same steps as the batch fold; a batch's events of a person are put in order, and the state holds four numbers and a time.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, v, a, d, at = state.get if state.exists else (0, 0.0, 0.5, 0.5, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for e in rows.itertuples():
            now = e.ts.value / 1e9
            hours = 0.0 if at is None else max(0.0, (now - at) / 3600)
            v, a, d = v * decay[0] ** hours, 0.5 + (a - 0.5) * decay[1] ** hours, 0.5 + (d - 0.5) * decay[2] ** hours
            v, a, d = max(-1.0, min(1.0, v + e.dv * e.intensity)), max(0.0, min(1.0, a + e.da * e.intensity)), max(0.0, min(1.0, d + e.dd * e.intensity))
            n, at = n + 1, now
        state.update((n, v, a, d, at))
        yield pd.DataFrame({"person": [key[0]], "n": [n], "valence": [v], "arousal": [a], "dominance": [d]})

    return events.groupBy("person").applyInPandasWithState(
        update, "person string, n long, valence double, arousal double, dominance double", "n long, v double, a double, d double, at double", "update", GroupStateTimeout.NoTimeout
    )
