"""The memory directory: what is pushed to the listing equals reading all files and filtering; streams give each version of a file once."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

from lorekeep.sources.files import read_jsonl
from lorekeep.sources.memoryfiles import MemoryFiles, json_lines, memory_files


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "memory"
    for kind in ("journal", "skills", "introspection"):
        os.makedirs(root / kind)
    for d in range(1, 10):
        (root / "journal" / f"2024-01-0{d}_note.md").write_text(f"**Topic:** day {d}\n\n# Day {d}  \nText ünd more\n")
        (root / "introspection" / f"2024-01-0{d}.jsonl").write_text(f'{{"thought": "t{d}", "confidence": 0.{d}}}\nnot json\n\n{{"thought": "u{d}"}}\n')
    (root / "journal" / "2024-13-77.md").write_text("")
    (root / "skills" / "bake.md").write_bytes(b"plain \xff text")
    (root / "soul.md").write_text("## Who I am\nx")
    (root / "skills" / "picture.png").write_bytes(b"x")
    (root / "skills" / ".hidden.md").write_text("x")
    return str(root)


CONDITIONS = [
    "true", "kind = 'journal'", "kind = 'journal' and date >= '2024-01-04' and date < '2024-01-07'", "name in ('bake.md', 'soul.md')", "name like '2024-01-0%' and kind <> 'journal'",
    "date is null", "date > '2024-01-08' or kind = 'skills'", "kind = ''", "title = 'Day 3'", "kind = 'none'",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_conditions(spark, folder, condition):
    every = spark.createDataFrame(memory_files(spark, folder).collect(), memory_files(spark, folder).schema)
    assert every.count() == 21
    rows = lambda df: sorted((r["kind"], r["name"], r["date"], r["title"], r["bytes"], r["content"]) for r in df.where(condition).collect())
    as_key = lambda rs: sorted(map(repr, rs))
    assert as_key(rows(memory_files(spark, folder, partitionBytes=40))) == as_key(rows(every))


def test_pushed(spark, folder):
    reader = MemoryFiles({"path": folder, "partitionBytes": "1"}).reader(None)
    left = list(reader.pushFilters([EqualTo(("kind",), "journal"), GreaterThan(("date",), dt.date(2024, 1, 6)), StringContains(("content",), "x")]))
    assert left == [StringContains(("content",), "x")]
    assert [e.name for p in reader.partitions() for e in p.entries] == [f"2024-01-0{d}_note.md" for d in (7, 8, 9)] and len(reader.partitions()) == 3
    plan = memory_files(spark, folder).where("kind = 'journal' and bytes > 3")._jdf.queryExecution().executedPlan().toString()
    print(plan)
    assert "journal" not in plan.split("Filter (")[1].split("BatchScan")[0] and "bytes" in plan  # the condition on bytes alone is left to Spark


def test_titles(spark, folder):
    got = {r["name"]: r["title"] for r in memory_files(spark, folder, endings="md").collect()}
    assert got["2024-01-03_note.md"] == "Day 3" and got["bake.md"] is None and got["soul.md"] == "Who I am"
    topics = memory_files(spark, folder, title=r"^\**Topic:\**\s*(.+)$").where("kind = 'journal' and title is not null")
    assert topics.count() == 9


def test_last_comes_before_conditions(spark, folder):
    last = memory_files(spark, folder, last=2)
    assert sorted(r["name"] for r in last.where("kind = 'introspection'").collect()) == ["2024-01-08.jsonl", "2024-01-09.jsonl"]
    assert last.where("kind = 'introspection' and date < '2024-01-08'").count() == 0
    assert memory_files(spark, folder, last=0).count() == 0


def test_lines_equal_the_reader(spark, folder):
    schema = "thought string, confidence double"
    got = json_lines(memory_files(spark, folder, last=3).where("kind = 'introspection'"), schema)
    want = read_jsonl(spark, f"{folder}/introspection", schema, last_files=3)
    assert sorted(map(repr, got.select("name", "thought", "confidence").collect())) == sorted(map(repr, want.select(F.col("file").alias("name"), "thought", "confidence").collect()))
    assert got.count() == 6


def test_stream(spark, folder, tmp_path):
    spark.dataSource.register(MemoryFiles)

    def drain():
        q = spark.readStream.format("memory_files").option("path", folder).option("settleSeconds", "0").load().select("kind", "name", "content").writeStream
        q = q.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    assert drain().count() == 21
    time.sleep(0.05)
    with open(f"{folder}/skills/bake.md", "w") as f:
        f.write("new text")
    with open(f"{folder}/skills/knit.md", "w") as f:
        f.write("knit")
    got = drain()
    assert got.count() == 23 and {r["content"] for r in got.where("name = 'bake.md'").collect()} == {"plain � text", "new text"}
