"""Selection under a token budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import compress, tokens
from lorekeep.operators import scan
from lorekeep.operators.fold import ordered_fold
from lorekeep.session import checkpointed

#: Tokens that each message costs beside its text.
OVERHEAD = 4


def fit_messages(messages: DataFrame, budget: int | Column, keys: tuple[str, ...] = ("person",), order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The newest messages of each key until one would go over budget, with used, the tokens up to and with each."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], F.desc("content"))
    used = F.sum(tokens(F.col("content")) + OVERHEAD).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("used", used).where(F.col("used") <= budget)


def knapsack(items: DataFrame, budget: int | Column, keys: tuple[str, ...], candidates: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Of each key the items (id, salience, tokens) taken densest first, those that do not fit being passed over; nth from 1.

    What fits depends on all before it, so a key's items are read in order; a hot key's are taken in rounds, see _in_rounds.
    Only ids and numbers are moved, not texts. An item over the budget can never be taken and is left out before. A budget
    may be a column, the same for all items of a key. candidates keeps the densest of a key only.
    """
    most = F.lit(budget) if isinstance(budget, int) else budget
    fit = items.where(F.col("tokens") <= most).withColumns({"_density": F.col("salience") / F.col("tokens"), "_budget": most.cast("long")})
    if candidates is not None:
        fit = fit.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_density"), "id"))).where(F.col("_rank") <= candidates)

    def step(state, item, size, budget):
        nth, used = state
        return (state, ()) if used + size > budget else ((nth + 1, used + size), [(nth + 1, item, used + size)])

    rows = fit.select(*keys, "_density", F.col("id").cast("long").alias("id"), F.col("tokens").cast("long").alias("tokens"), "_budget")
    order = [F.desc("_density"), "id"]

    def cold(rows):
        return ordered_fold(rows, list(keys), order, ["id", "tokens", "_budget"], lambda: (0, 0), step, lambda s: (), "nth int, id long, used long")

    return scan.by_heat(rows, list(keys), cold, lambda r: _in_rounds(r, list(keys), order), hot_rows)


def _in_rounds(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The knapsack of hot keys: each round takes the longest run of items that fits, by running sums over chunks.

    What is then larger than the rest of the budget is dropped, and the next round goes on with the items after those taken.
    The first item left always fits, so each round takes one at least, and mostly all but what the smallest items would fill.
    """
    left = checkpointed(scan.in_chunks(scan.numbered(rows, keys, order)).drop(scan.HALO).withColumns({"_used": F.lit(0).cast("long"), "_taken": F.lit(0)}))
    found = []
    while not left.isEmpty():
        summed = scan.running(left, {"_sum": (F.sum, "tokens"), "_count": (F.sum, F.lit(1))})
        fits = F.col("_used") + F.col("_sum") <= F.col("_budget")
        # sizes are positive, so the items that fit are those before the first that does not
        summed = checkpointed(summed.withColumn("_fits", fits))
        took = summed.where("_fits")
        found.append(took.select(*keys, (F.col("_taken") + F.col("_count")).cast("int").alias("nth"), "id", (F.col("_used") + F.col("_sum")).alias("used")))
        state = took.groupBy(scan.KEY).agg(F.max(F.col("_used") + F.col("_sum")).alias("_used"), F.max(F.col("_taken") + F.col("_count")).cast("int").alias("_taken"))
        rest = summed.where(~F.col("_fits")).drop("_used", "_taken", "_sum", "_count", "_fits").join(F.broadcast(state), scan.KEY)  # a row a hot key
        left = checkpointed(rest.where(F.col("tokens") <= F.col("_budget") - F.col("_used")))
    return reduce(DataFrame.unionByName, found)


def fit_prefix(items: DataFrame, budget: int | Column, keys: tuple[str, ...], order: tuple[str, ...], least: int = 20) -> DataFrame:
    """Items in order until one goes over budget; that one is cut to what remains, if more than least tokens do."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    w = Window.partitionBy(*keys).orderBy(*order)
    size = tokens(F.col("content"))
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = items.withColumns({"_before": before, "_size": size, "_most": most}).where(F.col("_before") <= F.col("_most"))
    whole = F.col("_before") + F.col("_size") <= F.col("_most")
    left = F.col("_most") - F.col("_before")
    rows = rows.withColumn("cut", ~whole).withColumn("content", F.when(whole, F.col("content")).otherwise(compress(F.col("content"), left)))
    return rows.where(~F.col("cut") | (left > least)).drop("_before", "_size", "_most")
