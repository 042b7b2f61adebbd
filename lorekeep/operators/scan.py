"""Ordered analytics of hot keys: a key whose rows are too many for one task is numbered over all tasks and read in chunks.

Keys with few rows go through an ordinary window. A hot key's rows are put in order by ranges over all tasks; each row gets
its number within the key from its place in its range and the counts of the ranges before, of which there are as many as
tasks. Rows are then dealt to chunks of equal length. A window that looks back over n rows is taken within a chunk that
also holds the last n rows of the one before; a sum or maximum from the beginning is taken within chunks, and what the chunks
before amount to, a row a chunk, is carried to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import checkpointed

#: Rows of a key that one task may hold, and rows of a chunk.
HOT_ROWS, CHUNK = 1_000_000, 100_000
KEY, NTH, AT, HALO = "_key", "_nth", "_chunk", "_halo"


def _key(keys: list[str]) -> Column:
    """The keys as one value, in which nulls equal one another."""
    return F.struct(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame | None:
    """(_key): keys with more than hot_rows rows, one for each hot_rows of the table at most; None where there is none."""
    counts = df.groupBy(_key(keys).alias(KEY)).agg(F.count("*").alias("_n"))
    hot = checkpointed(counts.where(F.col("_n") > (HOT_ROWS if hot_rows is None else hot_rows)).select(KEY))
    return None if hot.isEmpty() else hot


def by_heat(df: DataFrame, keys: list[str], cold: Callable, hot: Callable, hot_rows: int | None = None) -> DataFrame:
    """cold(rows of ordinary keys), united with hot(rows of hot keys) where there are such; both give the same columns."""
    found = hot_keys(df, keys, hot_rows)
    if found is None:
        return cold(df)
    rows = df.withColumn(KEY, _key(keys))
    few = F.broadcast(found)
    return cold(rows.join(few, KEY, "left_anti").drop(KEY)).unionByName(hot(rows.join(few, KEY, "left_semi").drop(KEY)))


def numbered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df with _key and _nth, each row's number in the order within its key, from 1. Rows should not tie."""
    rows = df.withColumn(KEY, _key(keys)).repartitionByRange(*keys, *order)
    rows = checkpointed(rows.withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(KEY, "_part").agg(F.count("*").alias("_n"))  # a row for each task and, beside these, each hot key
    offset = counts.select(KEY, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    nth = F.col("_offset") + F.row_number().over(Window.partitionBy(KEY, "_part").orderBy(*order))
    return rows.join(F.broadcast(offset), [KEY, "_part"]).withColumn(NTH, nth).drop("_part", "_offset")


def in_chunks(rows: DataFrame, halo: int = 0, size: int | None = None) -> DataFrame:
    """rows with _chunk and _halo: each row in its chunk, and the last halo rows of each chunk (halo is no more than size) in the next one too."""
    size = max(halo, CHUNK if size is None else size)
    own = F.floor((F.col(NTH) - 1) / size)
    twice = F.when((F.col(NTH) - 1) % size >= size - halo, F.array(F.struct(own.alias("c"), F.lit(False).alias("h")), F.struct((own + 1).alias("c"), F.lit(True).alias("h"))))
    placed = rows.withColumn("_p", F.explode(F.coalesce(twice, F.array(F.struct(own.alias("c"), F.lit(False).alias("h"))))) if halo else F.struct(own.alias("c"), F.lit(False).alias("h")))
    return placed.withColumns({AT: F.col("_p.c"), HALO: F.col("_p.h")}).drop("_p")


def in_order() -> Window:
    """Within a chunk, in the order of the key."""
    return Window.partitionBy(KEY, AT).orderBy(NTH)


def without_halo(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col(HALO)).drop(HALO)


def running(rows: DataFrame, columns: dict[str, tuple[Callable, str]]) -> DataFrame:
    """rows in chunks (without halo) with columns: name -> (F.sum or F.max, value): that of a key's rows up to each row. Nulls add nothing."""
    w = in_order().rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(KEY).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(KEY, AT).agg(*[how(value).alias(f"_t_{name}") for name, (how, value) in columns.items()])
    carried = totals.select(KEY, AT, *[how(f"_t_{name}").over(before).alias(f"_b_{name}") for name, (how, _) in columns.items()])
    own = rows.withColumns({f"_o_{name}": how(value).over(w) for name, (how, value) in columns.items()}).join(carried, [KEY, AT])
    both = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.max: lambda a, b: F.greatest(a, b)}
    out = own.withColumns({name: both[how](F.col(f"_b_{name}"), F.col(f"_o_{name}")) for name, (how, _) in columns.items()})
    return out.drop(*[f"{p}{name}" for name in columns for p in ("_o_", "_b_")])


def plain(rows: DataFrame, *more: str) -> DataFrame:
    """rows without the columns of this module."""
    return rows.drop(KEY, NTH, AT, HALO, *more)
