"""The memory directory as a data source, memory_files: journals, skills, profiles and logs, a file a row.

    spark.dataSource.register(MemoryFiles)
    spark.read.format("memory_files").option("path", folder).option("last", 3).load().where("kind = 'journal' and date >= '2024-01-05'")

Conditions on kind, name and date (=, in, <, <=, >, >=, starts with) are applied to the listing, so other files are not opened;
Spark does the rest. last keeps the last files by name of each kind before any condition. Only the listing is the driver's; files
are read in tasks, each of files of some bytes together. readStream gives files as they appear or are rewritten.

A file that is gone when it is read is left out; bytes that are no UTF-8 are replaced. date is null where a name does not begin with
one, title where no line fits the pattern, kind is empty at the top of the directory.
"""

from __future__ import annotations

import datetime as dt
import re
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

SCHEMA = "kind string, name string, date date, title string, bytes long, modified timestamp, content string"
#: Without it Spark keeps all conditions to itself.
PUSHDOWN = {"spark.sql.python.filterPushdown.enabled": "true"}

DATE = re.compile(r"(\d{4}-\d\d-\d\d)(?!\d)")
TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, StringStartsWith: lambda x, v: x.startswith(v), IsNotNull: lambda x, v: True,
}


@dataclass(frozen=True)
class Entry:
    """A file of the listing."""

    path: str
    kind: str
    name: str
    date: dt.date | None
    bytes: int
    modified_ns: int


class FilesOf(InputPartition):
    def __init__(self, entries: list[Entry]):
        self.entries = entries


class _Directory:
    """Options of the source, the listing, and the rows of files."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.last = int(options["last"]) if "last" in options else None
        self.endings = tuple("." + e.strip() for e in options.get("endings", "md,json,jsonl,yaml,txt").split(","))
        self.title = options.get("title", r"^#+\s+(.*\S)\s*$")
        self.most_bytes, self.settle = int(options.get("partitionBytes", 16 << 20)), float(options.get("settleSeconds", 1))

    def system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def listing(self) -> list[Entry]:
        from pyarrow import fs

        system, root = self.system()
        out = []
        for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
            below = f.path[len(root) :].lstrip("/")
            if f.type == fs.FileType.File and f.base_name.endswith(self.endings) and not f.base_name.startswith((".", "_")):
                kind, _, _ = below.rpartition("/")
                out.append(Entry(f.path, kind.split("/")[0], f.base_name, _date(f.base_name), f.size, f.mtime_ns or 0))
        out.sort(key=lambda e: (e.kind, e.name, e.path))
        if self.last is not None:
            kinds: dict[str, list[Entry]] = {}
            for e in out:
                kinds.setdefault(e.kind, []).append(e)
            out = [e for group in kinds.values() for e in (group[-self.last :] if self.last > 0 else [])]
        return out

    def dealt(self, entries: list[Entry]) -> list[FilesOf]:
        parts, held = [], 0
        for e in entries:
            if not parts or held + e.bytes > self.most_bytes:
                parts.append([])
                held = 0
            parts[-1].append(e)
            held += e.bytes
        return [FilesOf(p) for p in parts]

    def rows(self, part: FilesOf) -> Iterator[tuple]:
        system, _ = self.system()
        heading = re.compile(self.title, re.MULTILINE)
        for e in part.entries:
            try:
                with system.open_input_stream(e.path) as f:
                    text = f.read().decode("utf-8", errors="replace")
            except FileNotFoundError:
                continue
            found = heading.search(text)
            modified = dt.datetime.fromtimestamp(e.modified_ns // 1000 / 1e6, dt.timezone.utc)
            yield e.kind, e.name, e.date, (found.group(1) if found and found.re.groups else found.group() if found else None), e.bytes, modified, text


def _date(name: str) -> dt.date | None:
    found = DATE.match(name)
    try:
        return dt.date.fromisoformat(found.group(1)) if found else None
    except ValueError:  # no day of the calendar
        return None


class MemoryFiles(DataSource):
    """Options: path; last (files of each kind, by name); endings; title (a pattern, its first group); partitionBytes; settleSeconds."""

    @classmethod
    def name(cls) -> str:
        return "memory_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Directory(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Directory(dict(self.options)))


class _Reader(DataSourceReader):
    def __init__(self, directory: _Directory):
        self.directory, self.conditions = directory, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute in (("kind",), ("name",), ("date",)):
                self.conditions.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[FilesOf]:
        fits = lambda e: all((x := getattr(e, c)) is not None and TESTS[kind](x, v) for c, kind, v in self.conditions)
        return self.directory.dealt([e for e in self.directory.listing() if fits(e)])

    def read(self, partition: FilesOf) -> Iterator[tuple]:
        return self.directory.rows(partition) if isinstance(partition, FilesOf) else iter(())  # Spark asks for one empty partition of an empty listing


class _StreamReader(DataSourceStreamReader):
    """Offsets are times of change. Files changed within settleSeconds wait, so that none with an earlier time comes after."""

    def __init__(self, directory: _Directory):
        self.directory = directory
        self.seen = 0

    def initialOffset(self) -> dict:
        return {"modified_ns": 0}

    def latestOffset(self) -> dict:
        quiet = time.time_ns() - int(self.directory.settle * 1e9)
        self.seen = max((e.modified_ns for e in self.directory.listing() if e.modified_ns <= quiet), default=self.seen)
        return {"modified_ns": self.seen}

    def partitions(self, start: dict, end: dict) -> list[FilesOf]:
        return self.directory.dealt([e for e in self.directory.listing() if start["modified_ns"] < e.modified_ns <= end["modified_ns"]])

    def read(self, partition: FilesOf) -> Iterator[tuple]:
        return self.directory.rows(partition)


def memory_files(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """kind, name, date, title, bytes, modified, content of the directory's files; the session then pushes conditions down."""
    spark.dataSource.register(MemoryFiles)
    for k, v in PUSHDOWN.items():
        spark.conf.set(k, v)
    return spark.read.format("memory_files").options(path=path, **options).load()


def json_lines(files: DataFrame, schema: str) -> DataFrame:
    """kind, name, line (from 1) and the fields of schema, of each line that is a JSON object; others are left out."""
    rows = files.select("kind", "name", F.posexplode(F.split("content", "\r?\n")).alias("_at", "_text"))
    rows = rows.select("kind", "name", (F.col("_at") + 1).alias("line"), F.from_json("_text", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("_v"))
    return rows.where("_v is not null and _v._bad is null").select("kind", "name", "line", "_v.*").drop("_bad").where(_any_field(schema))


def _any_field(schema: str) -> Column:
    """A blank line parses to an object without fields."""
    from pyspark.sql.types import StructType

    return reduce(Column.__or__, [F.col(f"`{c}`").isNotNull() for c in StructType.fromDDL(schema).names])
