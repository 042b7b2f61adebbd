"""Readers of the file-backed memories, and the writers of tables.

Text, JSON and JSON-lines files are read by Spark's own sources, in parallel and from any store that Spark reads. YAML
has none: files are read whole as text and parsed row by row, each a small document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import tokens

# What a trace may be.
TRACE_KINDS = (
    "episode realization emotion correction relational mood factual identity_core uncertainty anticipation creative_journey reflection emotional_thread promise "
    "confidence summary thread arc temporal utility introspection workspace_eviction belief_evolution dissociation_event emotional_state personality_change"
).split()


def name_of_file() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """name, content, description of each file; the description is the first line that is not blank, without heading marks."""
    rows = spark.read.text(path, wholetext=True).select(name_of_file().alias("name"), F.col("value").alias("content"))
    first = F.regexp_extract("content", r"(?m)^[# \t]*(\S[^\n]*?)[ \t]*$", 1)
    return rows.withColumn("description", first)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """filename, date, topic, body, preview of journal files, whose head ends in a line ---."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("v"))
    body = F.regexp_replace(F.regexp_extract("v", r"(?s)\n---\n(.*)$", 1), r"^\s+|\s+$", "")
    return rows.select("filename", F.regexp_extract("filename", r"^(\d{4}-\d\d-\d\d)", 1).alias("date"), F.regexp_extract("v", r"(?mi)^\**topic:?\**:?\s*(.+)$", 1).alias("topic"), body.alias("body")).withColumn(
        "preview", F.substring("body", 1, 200)
    )


def read_jsonl(spark: SparkSession, path: str, schema: str, last_files: int | None = None) -> DataFrame:
    """Rows of JSON-lines files, of the last files by name where last_files is given; lines that are not JSON are left out."""
    bad = "_bad_line"
    rows = spark.read.schema(f"{schema}, {bad} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file")).where(F.col(bad).isNull()).drop(bad)
    if last_files is None:
        return rows
    newest = spark.read.text(path).select(F.col("_metadata.file_name").alias("file")).distinct().orderBy(F.desc("file")).limit(last_files)
    return rows.join(newest, "file", "left_semi")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """State files, each one JSON value; a file that is not JSON gives nulls."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """name and the file's value as JSON text; null where the file is empty or not YAML."""
    rows = spark.read.text(path, wholetext=True).select(name_of_file().alias("name"), F.col("value").alias("text"))

    @F.pandas_udf("string")
    def to_json(texts):
        import json

        import yaml

        def one(t):
            try:
                value = yaml.safe_load(t)
            except yaml.YAMLError:
                return None
            return None if value is None else json.dumps(value, default=str)

        return texts.map(one)

    return rows.select("name", to_json("text").alias("json"))


def append_traces(df: DataFrame, path: str) -> None:
    """Appends traces, with tokens and access count filled in; a kind that is not known fails the write."""
    ok = F.assert_true(F.col("kind").isin(TRACE_KINDS), F.concat(F.lit("unknown trace kind: "), F.coalesce("kind", F.lit("null"))))
    rows = df.withColumns({"tokens": tokens(F.col("content")), "access_count": F.lit(0).cast("long"), "_ok": ok})
    rows.where("_ok is null").drop("_ok").write.mode("append").partitionBy("kind").parquet(path)


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an append-only table: what an update in place would have left."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def alias_conflicts(people: DataFrame) -> DataFrame:
    """alias, owners: aliases (person, alias) that more than one person claims, whatever the case."""
    return people.groupBy(F.lower("alias").alias("alias")).agg(F.sort_array(F.collect_set("person")).alias("owners")).where(F.size("owners") > 1)
