"""Mixing sources to target weights by the cube method.

Every source gets a target number of words. A document is taken whole
floor(target / source size) times, and once more with the fractional rest as
its inclusion probability. Which documents get the extra copy is drawn by
balanced sampling: probabilities move along directions that leave the sum of
probabilities (documents) and of probability times size (words) unchanged,
until all but two in a block are 0 or 1. The undecided ones of many blocks meet
in the blocks of the next level; only the last level lands, on two documents a source.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import durable, join_hot, ranked

#: Weights of the sources, in order, and how often a source may be repeated.
WEIGHTS = (5, 2, 1)
CAP = 3.0
#: Documents in a block of the flight phase.
BLOCK = 4096
#: Equal rows that are numbered together.
COPIES = 10_000
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Moves the probabilities p to 0 or 1, all but two at most; keeps sum(p) and sum(p * size)."""
    p, draw = p.astype(float).tolist(), iter(np.random.default_rng(seed).random(2 * len(p) + 8).tolist())
    x, queue = size.astype(float).tolist(), [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    queue.reverse()
    hand: list[int] = []
    while True:
        while len(hand) < 3 and queue:
            hand.append(queue.pop())
        if len(hand) < 2:
            break
        if len(hand) == 3:
            a, b, c = (x[i] for i in hand)
            u = (b - c, c - a, a - b)
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif x[hand[0]] == x[hand[1]]:
            u = (1.0, -1.0)
        else:
            break
        up = min((1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(hand, u) if d)
        down = min(p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(hand, u) if d)
        step = up if next(draw) * (up + down) < down else -down
        for i, d in zip(hand, u):
            p[i] += step * d
        hand = [i for i in hand if EPS < p[i] < 1 - EPS]
    return np.array([0.0 if v <= EPS else 1.0 if v >= 1 - EPS else v for v in p])


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last fractional probabilities (two at most after a flight) become 0 or 1, whichever keeps the words nearest."""
    p, left = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    goal, best = float((p[left] * size[left]).sum()), None
    for bits in range(1 << len(left)):
        pick = np.array([bits >> k & 1 for k in range(len(left))], float)
        off = abs(float((pick * size[left]).sum()) - goal)
        if best is None or off < best[0]:
            best = (off, pick)
    p[left] = best[1]
    return p


def _fly(last: bool):
    def block(t: pa.Table) -> pa.Table:
        # long documents first: those left undecided at the end are short ones, and landing moves few words
        size, order, p = (t.column(k).to_numpy() for k in ("size", "order", "p"))
        by = np.lexsort((order, -size))
        moved = flight(p[by], size[by], int(np.bitwise_xor.reduce(order)) & 0x7FFFFFFF)
        moved = land(moved, size[by]) if last else moved
        return t.take(pa.array(by)).set_column(t.column_names.index("p"), "p", pa.array(moved))

    return block


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size).

    Targets share the total of all sizes by weight, stop at cap times their source's size, and what is over is shared
    again by weight, until none is above. Only sums over sources come to the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    per = durable(ranked(per, [F.col("source").asc_nulls_last()], "pos").withColumn("w", w).drop("pos"))
    limit, rate, n_full = F.col("source_size") * cap, 0.0, -1
    while True:
        full = F.col("w") * rate > limit
        total, room, free, n = per.agg(
            F.sum("source_size"), F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w"))), F.sum(full.cast("long"))
        ).first()
        if n == n_full or not free:
            break
        rate, n_full = (total - room) / free, n
    return per.select("source", "source_size", "n_docs", F.least(limit.cast("double"), F.col("w") * rate).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, one row per row of docs (columns doc_id, text, source; others are not looked at).

    size counts words, 0 for a null or empty text; taken is how many words the mix takes, repeats counted. A null source is a
    source, the last one. Draws depend on doc_id and size alone, so reruns agree; rows that agree in these are documents of
    their own, told apart by a running number. An empty table gives no rows. Only ids and sizes are shuffled, in blocks of a
    few thousand, so that a hot source, and a third of all rows with one id, are many blocks.
    """
    block = max(8, block)  # two of a block stay open, so that each level has a quarter of the blocks at most
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = durable(docs.select("doc_id", "source", size.alias("size")))
    targets = durable(source_targets(sized, weights, cap))
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # a null source is a key too
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_alike")).withColumn("_key", key)
    # rows that agree in all that is looked at: a number for each, dealt out COPIES at a time
    many = F.col("n_alike") > COPIES
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_alike") - 1, F.lit(COPIES).cast("long"))).alias("_start")
    parts = alike.where(many).select("*", start).repartition(F.xxhash64("doc_id", "_start")).unionByName(alike.where(~many).withColumn("_start", F.lit(0).cast("long")))
    each = F.explode(F.sequence(F.col("_start"), F.least(F.col("n_alike"), F.col("_start") + COPIES) - 1)).alias("copy")
    rows = durable(parts.select("doc_id", "source", "size", "_key", each))
    rows = join_hot(rows, targets.withColumn("_key", key).drop("source"), "_key").drop("_key")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio + 1e-12).cast("double")).withColumn("p", F.when(F.col("size") > 0, F.greatest(ratio - F.col("whole"), F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("order", F.xxhash64("doc_id", "size", "copy")).drop("copy").withColumn("blocks", F.ceil(F.col("n_docs") / block).cast("long"))

    names, done, blocks = rows.columns, None, max(1, math.ceil(most / block))
    while True:
        last = blocks == 1
        keyed = rows.withColumn("block", F.pmod(F.xxhash64("order"), F.col("blocks")))
        flown = keyed.groupBy("source", "block").applyInArrow(_fly(last), keyed.schema).select(names)
        if last:
            done = flown if done is None else done.unionByName(flown)
            break
        flown = durable(flown)
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done = flown.where(~open_) if done is None else done.unionByName(flown.where(~open_))
        rows = flown.where(open_).withColumn("blocks", F.ceil(F.col("blocks") * 2 / block).cast("long"))
        blocks = math.ceil(blocks * 2 / block)
    taken = (F.col("size") * (F.col("whole") + F.col("p"))).cast("long")
    return done.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """mix_sources with the fixed weights and cap; nulls, ties, repeated rows and empty tables as there."""
    return mix_sources(docs)
