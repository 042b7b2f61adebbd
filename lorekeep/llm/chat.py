"""Chat formatting: every dialogue from the point of view of each of its participants.

For each participant the whole dialogue is rendered once more, with that
speaker as the assistant and the others as named users. Only what the chosen
speaker says is trained on (mask = true). System turns stay system turns and
give no point of view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import durable, shuffle_partitions

SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    r"""text in which no marker can be read: a backslash more in every run of < and backslashes before |. Taking one out again gives text back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn and point of view: conv_id, perspective, ord, speaker, chat_role, segment, mask, start, content_start, end.

    Segments of a point of view, joined in the order of ord, are the rendered dialogue; start and end are their
    character offsets in it, and [content_start, end) is what the mask speaks of. Turns go by (turn, speaker, text), nulls
    first; repeated rows stay as turns of their own. A null role is a user without a name and gives no point of view;
    a null text is empty. A dialogue without participants gives no rows. Extra columns are not looked at. Markers inside
    texts and names are escaped, and a line break in a name is a blank, so that no text can pass for a turn.

    Turns are range-partitioned in their order, so a long dialogue, or all turns without a conv_id, is many tasks' work;
    places and offsets are counted in each partition and moved by the sums of the partitions before it.
    """
    base = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))  # a null conv_id is a dialogue too
    base = base.withColumn("_conv", key).repartitionByRange(shuffle_partitions(turns.sparkSession), "conv_id", "turn", "speaker", "text", F.monotonically_increasing_id())
    base = durable(base.withColumn("_part", F.spark_partition_id()))
    named = F.col("speaker").isNotNull() & (F.col("speaker") != SYSTEM)
    people = base.where(named).select("_conv", F.col("speaker").alias("perspective")).distinct()
    here = base.select("_conv", "_part").distinct().join(people, "_conv")
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    name = F.when(~own & named, F.concat(F.lit(" name="), escaped(F.translate("speaker", "\n\r", "  ")))).otherwise(F.lit(""))
    chat_role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    rows = base.join(here, ["_conv", "_part"])
    rows = rows.withColumns({"chat_role": chat_role, "head": F.concat(F.lit(OPEN), chat_role, name, F.lit("\n")), "mask": own})
    rows = rows.withColumn("segment", F.concat("head", escaped(F.col("text")), F.lit(CLOSE)))
    size = F.length("segment").cast("long")
    sums = rows.groupBy("_conv", "perspective", "_part").agg(F.count("*").alias("_n"), F.sum(size).alias("_size"))
    before = Window.partitionBy("_conv", "perspective").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sums = sums.select("_conv", "perspective", "_part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in ("_n", "_size")])
    order = Window.partitionBy("_conv", "_part", "perspective").orderBy("turn", "speaker", "text")
    rows = rows.withColumns({"ord": F.row_number().over(order), "end": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.join(sums, ["_conv", "_part", "perspective"]).withColumns({"ord": (F.col("ord") + F.col("_n")).cast("int"), "end": F.col("end") + F.col("_size")})
    start = F.col("end") - F.length("segment")
    return rows.select("conv_id", "perspective", "ord", "speaker", "chat_role", "segment", "mask", start.alias("start"), (start + F.length("head")).alias("content_start"), "end")


def render_dialogues(turns: DataFrame, **columns) -> DataFrame:
    """(conv_id, perspective, text, spans): whole dialogues with the [start, end) spans to train on.

    A dialogue becomes one value here; keep to rotate_perspectives where one may not fit in a row. Nulls, repeated rows and
    empty tables are as there.
    """
    rows = rotate_perspectives(turns, **columns)
    whole = rows.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(F.struct("ord", "segment", "mask", "content_start", "end"))).alias("s"))
    spans = F.transform(F.filter("s", lambda x: x["mask"]), lambda x: F.struct(x["content_start"].alias("start"), x["end"].alias("end")))
    return whole.select("conv_id", "perspective", F.concat_ws("", F.col("s.segment")).alias("text"), spans.alias("spans"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text,
  regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS said, regexp_replace(translate(role, chr(10) || chr(13), '  '), '<(\\*)\|', '<\1\\|', 'g') AS known FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND speaker <> 'system'),
r AS (SELECT t.*, perspective, speaker IS NOT DISTINCT FROM perspective AS mask FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
c AS (SELECT *, CASE WHEN mask THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS chat_role FROM r),
h AS (SELECT *, '<|im_start|>' || chat_role || CASE WHEN NOT mask AND speaker IS NOT NULL AND speaker <> 'system' THEN ' name=' || known ELSE '' END || chr(10) AS head FROM c),
g AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS segment FROM h),
w AS (SELECT *, row_number() OVER o AS ord, sum(length(segment)) OVER (o ROWS UNBOUNDED PRECEDING) AS e FROM g
  WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text))
SELECT conv_id, perspective, ord::INT AS ord, speaker, chat_role, segment, mask, (e - length(segment))::BIGINT AS start,
  (e - length(segment) + length(head))::BIGINT AS content_start, e::BIGINT AS "end" FROM w
"""
