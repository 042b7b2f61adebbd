"""Salience over time: decay, pruning, and reinforcement as a fold over a log of adjustments.

Plain Parquet has no UPDATE, so the state of a trace is its base row and the adjustments since, applied in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import clamp
from lorekeep.operators.fold import clamped_sum
from lorekeep.operators.temporal import micros

LASTING = ["summary", "thread", "arc"]


def decay(df: DataFrame, as_of: str, half_life: float = 168.0, coherence: float = 0.5, passes: int = 1) -> DataFrame:
    """df with decayed: salience after the hours since the last access; access counts and lasting kinds resist.

    A null time, no hours, or a change of up to 1e-6 leaves it. The last access does not move, so passes compound.
    """
    hours = (F.unix_micros(F.lit(as_of).cast("timestamp")) - micros("last_accessed")) / 3.6e9
    resist = F.lit(1.0) / (F.coalesce("access_count", F.lit(0)) * 0.1 + 1) * F.when(F.col("kind").isin(LASTING), 0.2).otherwise(1.0)
    rate = F.ln(F.lit(2.0)) / max(half_life, 0.1) * (0.5 + min(1.0, max(0.0, coherence)))
    value: Column = F.col("salience").cast("double")
    for _ in range(passes):
        new = value * F.exp(-rate * hours * resist)
        value = F.when(hours.isNull() | (hours <= 0) | (F.abs(value - new) <= 1e-6), value).otherwise(new)
    return df.withColumn("decayed", value)


def half_life(hours: float, coherence: Column) -> Column:
    return F.lit(hours) / (clamp(coherence) + 0.5)


def prune(df: DataFrame, salience: str = "salience", least: float = 0.01) -> DataFrame:
    """Rows to keep: those not below least, and lasting kinds."""
    return df.where((F.col(salience) >= least) | F.col("kind").isin(LASTING) | F.col(salience).isNull())


def hebbian(exchanges: DataFrame, reinforce_above: float = 0.7, weaken_below: float = 0.4, up: float = 0.05, down: float = 0.03, cited_bonus: float = 0.025) -> DataFrame:
    """A log (trace_id, exchange_id, step, delta) from exchanges (exchange_id, health, trace_ids, cited_ids): cited traces first, whatever the health."""
    cited = exchanges.select("exchange_id", F.explode("cited_ids").alias("trace_id"), F.lit(0).alias("step"), F.lit(cited_bonus).alias("delta"))
    change = F.when(F.col("health") > reinforce_above, F.lit(up)).when(F.col("health") < weaken_below, F.lit(-down))
    loaded = exchanges.select("exchange_id", F.explode("trace_ids").alias("trace_id"), F.lit(1).alias("step"), change.alias("delta")).where("delta is not null")
    return cited.unionByName(loaded).select("trace_id", "exchange_id", "step", "delta")


def apply_adjustments(base: DataFrame, log: DataFrame, order: tuple[str, ...] = ("exchange_id", "step")) -> DataFrame:
    """base (id, salience) with adjusted: deltas applied one after another, each result kept within 0 and 1; and how many there were."""
    steps = clamped_sum(log, "trace_id", list(order), "delta")
    start = F.col("salience").cast("double")
    moved = F.least("high", F.greatest("low", start + F.col("shift")))
    joined = base.join(steps, base["id"] == steps["trace_id"], "left")
    return joined.withColumn("adjusted", F.when(F.col("n").isNull(), start).otherwise(moved)).withColumn("n_adjustments", F.coalesce("n", F.lit(0)).cast("int")).drop("trace_id", "shift", "low", "high", "n")


def forget(salience: Column, least: float = 0.01) -> Column:
    """What weakening by the distance to least leaves: least, or, of less than that, the distance again lower, but not below 0."""
    return F.greatest(F.lit(0.0), salience - F.abs(salience - least))


def decay_multiplier(hours: Column, coherence: Column, half: float = 168.0) -> Column:
    """The share of salience that is left after hours; 0.5 where the time is not known, 1 for none."""
    return F.when(hours.isNull(), 0.5).when(hours <= 0, 1.0).otherwise(F.exp(-F.ln(F.lit(2.0)) * hours / half_life(half, coherence)))


def should_prune(salience: Column, least: float = 0.01) -> Column:
    return salience < least


def access_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("trace_id").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))


def memory_stats(messages: DataFrame, traces: DataFrame, events: DataFrame, max_traces: int = 50_000) -> DataFrame:
    """One row: counts, average salience of traces (0 without any), and pressure."""
    t = traces.agg(F.count("*").alias("traces"), F.coalesce(F.round(F.avg("salience"), 4), F.lit(0.0)).alias("avg_salience"))
    one = messages.agg(F.count("*").alias("messages")).crossJoin(t).crossJoin(events.agg(F.count("*").alias("events")))
    return one.withColumn("pressure", F.round(F.least(F.lit(1.0), F.col("traces") / max(1, max_traces)), 6)).withColumn("status", F.when(F.col("pressure") > 0.9, "critical").when(F.col("pressure") > 0.7, "warning").otherwise("ok"))


def pressure_level(n: Column, most: Column) -> Column:
    use = n / F.greatest(F.lit(1), most)
    return F.when(use >= 0.8, "critical").when(use >= 0.6, "elevated").otherwise("normal")
