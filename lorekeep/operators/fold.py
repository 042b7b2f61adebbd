"""Ordered folds over a key's rows that never hold a key in memory.

Rows are dealt by key and sorted within tasks; a task reads them as they come and carries one small state. Where steps
compose (clamped sums do), chunks of a hot key are folded in many tasks first.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Rows of a key that are folded together before chunks are composed.
CHUNK = 4096


def ordered_fold(df: DataFrame, keys: list[str], order: list, values: list[str], start: Callable, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """keys and schema's columns: what step and finish give, by key.

    start() -> state; step(state, *values) -> (state, rows to emit); finish(state) -> rows to emit after the key's last row.
    The functions run in tasks, so they use nothing but their arguments and builtins. A null key is a key like any other.
    """
    out = StructType([StructField(k, df.schema[k].dataType) for k in keys] + _parse_datatype_string(schema).fields)
    arrow = to_arrow_schema(out)
    # dealt by a hash of the keys: a repartition by the keys themselves may be dropped after a join on them, and a key then be in several tasks
    rows = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).select(*keys, *values)
    n = len(keys)

    def run(batches):
        own, state, held = None, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                key = row[:n]
                if key != own:
                    if own is not None:
                        held += [own + r for r in finish(state)]
                    own, state = key, start()
                state, some = step(state, *row[n:])
                held += [key + r for r in some]
            if len(held) >= 4096:
                yield batch(held)
                held = []
        if own is not None:
            held += [own + r for r in finish(state)]
        yield batch(held)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return rows.mapInArrow(run, out)


def clamped_sum(df: DataFrame, key: str, order: list[str], delta: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(key, shift, low, high, n): a key's clamped additions in order, as one: x becomes min(high, max(low, x + shift)).

    A step x -> min(b, max(a, x + d)) followed by another is again such a step, so chunks of a key's rows, cut from ranges of
    the sorted log, are composed each for themselves, and then a key's chunks with one another.
    """
    rows = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    one = F.struct(F.col("_at").alias("at"), F.col(delta).cast("double").alias("s"), F.lit(low).alias("a"), F.lit(high).alias("b"), F.lit(1).cast("long").alias("n"))
    chunks = rows.groupBy(key, F.floor(F.col("_at") / CHUNK).alias("_chunk")).agg(_composed(F.collect_list(one)).alias("c"))
    whole = chunks.groupBy(key).agg(_composed(F.collect_list(F.struct(F.col("_chunk").alias("at"), "c.s", "c.a", "c.b", "c.n"))).alias("c"))
    return whole.select(key, F.col("c.s").alias("shift"), F.col("c.a").alias("low"), F.col("c.b").alias("high"), F.col("c.n").alias("n"))


def _composed(steps: Column) -> Column:
    inf = F.lit(float("inf"))
    start = F.struct(F.lit(0.0).alias("s"), (-inf).alias("a"), inf.alias("b"), F.lit(0).cast("long").alias("n"))
    within = lambda x, e: F.least(e["b"], F.greatest(e["a"], x + e["s"]))
    join = lambda f, e: F.struct((f["s"] + e["s"]).alias("s"), within(f["a"], e).alias("a"), within(f["b"], e).alias("b"), (f["n"] + e["n"]).alias("n"))
    return F.aggregate(F.array_sort(steps), start, join)
