"""Roll-ups: messages to summaries, episodes to threads, threads to arcs, and the links between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.temporal import gap_groups, segments
from lorekeep.session import checkpointed

#: Tags that name no person.
PROCESS_TAGS = ["consolidation", "compaction", "test"]


def person_of(tags: Column) -> Column:
    """The first tag that is no process tag."""
    return F.coalesce(F.get(F.filter(tags, lambda t: ~F.lower(t).isin(PROCESS_TAGS)), F.lit(0)), F.lit("_unknown"))


def _joined(order: Column, line: Column, sep: str = "\n") -> Column:
    """Lines of a group in order; a group is a few lines, chosen before."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), sep)


def compact(messages: DataFrame, least: int = 40, keep_recent: int = 20, size: int = 30, hours: float = 2.0, top: int = 5) -> DataFrame:
    """person, session, part, summary, n_messages, since, until: for people with least messages, all but the last keep_recent.

    A summary is the top most salient messages of a segment in the order of time, 300 characters of each. With keep_recent 0 nothing is compacted.
    """
    w = Window.partitionBy("person")
    old = messages.withColumn("_n", F.count("*").over(w)).withColumn("_back", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("id"))))
    old = old.where((F.col("_n") >= least) & (F.col("_back") > keep_recent) & F.lit(keep_recent > 0)).drop("_n", "_back")
    parts = segments(old, size, hours)
    keys = ["person", "session", "part"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("salience"), "ts", "id"))
    line = F.when(F.col("_rank") <= top, F.concat(F.lit("["), "speaker", F.lit("]: "), F.substring("content", 1, 300)))
    grouped = parts.withColumn("_rank", rank).withColumn("_line", line).groupBy(*keys)
    lines = F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("ts", "id", "_line"))))
    return grouped.agg(F.array_join(F.transform(lines, lambda x: x["_line"]), "\n").alias("summary"), F.count("*").alias("n_messages"), F.min("ts").alias("since"), F.max("ts").alias("until"))


def consolidate_threads(episodes: DataFrame, hours: float = 72.0, least: int = 5, top: int = 5, salience: float = 0.75) -> DataFrame:
    """person, cluster, n, content, time_range, child_ids, salience from episodes (id, tags, created, salience, content)."""
    rows = gap_groups(episodes.withColumn("person", person_of(F.col("tags"))), ["person"], "created", hours, "cluster")
    keys = ["person", "cluster"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("salience"), "created", "id"))
    rows = rows.withColumn("_line", F.when(rank <= top, F.struct("created", "id", F.concat(F.lit("- "), F.substring("content", 1, 250)).alias("l"))))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("_line")), lambda x: x["l"]), "\n").alias("content"),
        F.min("created").alias("since"), F.max("created").alias("until"), F.sort_array(F.collect_list("id")).alias("child_ids"),
    )
    return out.where(F.col("n") >= least).withColumn("salience", F.lit(salience))


def consolidate_arcs(threads: DataFrame, least: int = 3, salience: float = 0.85) -> DataFrame:
    """person, n, content, since, until from threads (person, content, since): people with least threads, 300 characters of each in the order of time."""
    out = threads.groupBy("person").agg(
        F.count("*").alias("n"), _joined(F.struct("since", "cluster"), F.substring("content", 1, 300), "\n\n").alias("content"), F.min("since").alias("since"), F.max("until").alias("until")
    )
    return out.where(F.col("n") >= least).withColumn("salience", F.lit(salience))


def lineage(links: DataFrame) -> DataFrame:
    """(id, ancestor, depth) from links (id, parent), up to the root; a row that is its own parent has none.

    Each round reaches twice as far: the ancestors of those at the farthest depth known are added to them, so a chain of n
    links takes as many rounds as n has binary digits. Links that go round name each other row once, by the shortest way.
    """
    known = checkpointed(links.where("parent is not null and parent <> id").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    reach = 1
    while True:
        far = known.where(F.col("depth") == reach).select("id", F.col("ancestor").alias("_at"))
        above = known.select(F.col("id").alias("_at"), "ancestor", (F.col("depth") + reach).alias("depth"))
        more = far.join(above, "_at").where("id <> ancestor").select("id", "ancestor", "depth")
        known = checkpointed(known.unionByName(more).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
        reach *= 2
        if known.where(F.col("depth") == reach).isEmpty():
            return known


def with_key(df: DataFrame, key: str, value: Column) -> DataFrame:
    """df with value under key in its JSON metadata where value is not null; what is there else stays, with its types.

    Numbers, booleans, nulls, lists and objects stay what they are, and value is written by its own type. Metadata that is no
    JSON object counts as empty. The other keys come out in the order of their names.
    """
    empty = F.expr("cast(map() as map<string, variant>)")
    old = F.coalesce(F.try_variant_get(F.try_parse_json("metadata"), "$", "map<string, variant>"), empty)
    new = F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("variant")))
    return df.withColumn("metadata", F.when(value.isNotNull(), F.to_json(new)).otherwise(F.col("metadata")))


def mark(df: DataFrame, ids: DataFrame, key: str, value: Column) -> DataFrame:
    """df with value under key in its metadata, for the rows whose id is in ids."""
    hit = ids.select(F.col("id").alias("_hit")).distinct()
    return with_key(df.join(hit, df["id"] == hit["_hit"], "left"), key, F.when(F.col("_hit").isNotNull(), value)).drop("_hit")


def mark_consolidated(df: DataFrame, parents: DataFrame) -> DataFrame:
    """df with each child's parent in its metadata, from parents (id, child_ids); of several parents the smallest."""
    own = parents.select(F.col("id").alias("_parent"), F.explode("child_ids").alias("_child")).groupBy("_child").agg(F.min("_parent").alias("_parent"))
    return with_key(df.join(own, df["id"] == own["_child"], "left"), "consolidated_into", F.col("_parent")).drop("_parent", "_child")


def time_range(since: Column, until: Column) -> Column:
    """"a to b" in words of dates; one date where both are the same, null without dates."""
    a, b = (F.date_format(c, "yyyy-MM-dd") for c in (since, until))
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(" to "), b))


def format_traces(traces: DataFrame, keys: list[str], cap: int = 15_000) -> DataFrame:
    """keys, text: each key's traces as numbered blocks in the order of time, cut at cap characters; a block starts before the cut or is left out."""
    w = Window.partitionBy(*keys).orderBy("created", "id")
    block = F.format_string("[%d] (%s, sal:%.2f, %s)\n%s\n\n", F.row_number().over(w), "kind", F.col("salience").cast("double"), F.date_format("created", "yyyy-MM-dd"), "content")
    rows = traces.withColumn("_block", block).withColumn("_before", F.coalesce(F.sum(F.length("_block")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_before", "created", "id", F.substring("_block", 1, cap).alias("b")))), lambda x: x["b"]), "")
    return rows.where(F.col("_before") < cap).groupBy(*keys).agg(F.substring(text, 1, cap).alias("text"))
