"""Which pieces of text have stood earlier in the corpus, found with one shuffle by content.

A piece has a core (a hash of what any equal piece shares with it), a content
(a digest of all of it, 128 bits with more or with the core), and a place:
document number and byte offset. Pieces go
in packed blocks to the bucket of their core. There the earliest piece of each
content stays and the later ones are removed spans. A core with several
contents makes its earliest pieces open: they go on to a finer division.

Each task combines its own pieces first, so that a piece repeated in a third
of all documents sends one entry a task. Buckets are sized by the input's bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import durable, ranked, short_batches, shuffle_partitions, text_chunks

BUCKET_BYTES = 8 << 20
#: Pieces, and bytes of text, that a task holds before it sends them on.
HELD_PIECES, HELD_BYTES = 300_000, 8 << 20

ENTRY = {"core": "u8", "content": "u8", "more": "u8", "doc": "i8", "lo": "i8", "size": "i4", "off": "u1", "open": "u1"}
OPEN = {"doc": "i8", "lo": "i8", "size": "i4", "off": "u1"}
SPAN = {"doc": "i8", "lo": "i8", "hi": "i8"}
PIECES = "bucket int, entries binary, open binary, spans binary"
FLAGS = "bucket int, open binary, spans binary"


def pack(fields: dict, columns: dict, pick=slice(None)) -> bytes:
    """Columns as bytes, the first bytes of all values together, then the second ones: what is mostly zero compresses well."""
    out = [np.ascontiguousarray(columns[k][pick].astype(t)) for k, t in fields.items()]
    return b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in out)


def unpack(fields: dict, blobs) -> dict:
    width = sum(np.dtype(t).itemsize for t in fields.values())
    parts: dict = {k: [np.zeros(0, t)] for k, t in fields.items()}
    for blob in blobs:
        n, at = len(blob or b"") // width, 0
        for k, t in fields.items():
            w = np.dtype(t).itemsize
            if n:
                planes = np.frombuffer(blob, np.uint8, n * w, at).reshape(w, n)
                parts[k].append(np.ascontiguousarray(planes.T).view(t).ravel())
            at += n * w
    return {k: np.concatenate(v) for k, v in parts.items()}


def scatter(bucket: np.ndarray):
    """(bucket number, its rows) for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for b, rows in zip(found.tolist(), np.split(order, first[1:])):
        yield b, rows


def of_key(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(11)) % np.uint64(n)).astype(np.int64)


def of_doc(doc: np.ndarray, n: int) -> np.ndarray:
    x = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(17)) % np.uint64(n)).astype(np.int64)


def judge(e: dict, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order, state) of entries: 0 earliest of its content, 1 later, 2 earliest but open. last: contents of a core are of no interest."""
    order = np.lexsort((e["lo"], e["doc"], e["more"], e["content"], e["core"]))
    core, content, more = e["core"][order], e["content"][order], e["more"][order]
    new_core, n = np.ones(len(order), bool), len(order)
    new_core[1:] = core[1:] != core[:-1]
    new = new_core.copy()
    new[1:] |= (content[1:] != content[:-1]) | (more[1:] != more[:-1])
    state = np.where(new, 0, 1)
    if not last and n:
        group = np.cumsum(new_core) - 1
        many = (np.bincount(group, weights=new) > 1) | (np.bincount(group, weights=e["open"][order]) > 0)
        state[new & many[group]] = 2
    return order, state


def by_bucket(schema: str, *parts) -> pa.RecordBatch:
    """One row a bucket with the packed rows of each part, which is (fields, columns, rows' buckets); schema names bucket and the parts."""
    names = [f.split()[0] for f in schema.split(", ")]
    rows: dict = {}
    for k, (fields, columns, bucket) in enumerate(parts):
        for b, w in scatter(bucket):
            rows.setdefault(b, [None] * len(parts))[k] = pack(fields, columns, w)
    cols = [list(rows), *(zip(*rows.values()) if rows else [[]] * len(parts))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(cols)], names)


def picked(columns: dict, rows) -> dict:
    return {k: v[rows] for k, v in columns.items()}


def joined(parts: list[dict]) -> dict:
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}


def send(e: dict, n: int, last: bool, spans: dict | None = None) -> pa.RecordBatch:
    """A task's pieces, combined, as rows of PIECES. What is decided already (spans, open pieces) goes by document and spreads evenly."""
    order, state = judge(e, last)
    go = {k: v[order] for k, v in e.items()}
    later = state == 1
    decided = {"doc": go["doc"][later], "lo": go["lo"][later], "hi": go["lo"][later] + go["size"][later]}
    if spans:
        decided = joined([decided, spans])
    go["open"] = np.where(state == 2, 1, go["open"]).astype(np.uint8)
    # of an open core one piece, the earliest, goes to the core's bucket; the others are known to be open
    witness = state == 0
    rest = np.flatnonzero(state == 2)
    if len(rest):
        rest = rest[np.lexsort((go["lo"][rest], go["doc"][rest], go["core"][rest]))]
        first = np.ones(len(rest), bool)
        first[1:] = go["core"][rest][1:] != go["core"][rest][:-1]
        witness[rest[first]] = True
        rest = rest[~first]
    entries, rest = picked(go, witness), picked(go, rest)
    return by_bucket(PIECES, (ENTRY, entries, of_key(entries["core"], n)), (OPEN, rest, of_doc(rest["doc"], n)), (SPAN, decided, of_doc(decided["doc"], n)))


def resolve(pieces: DataFrame, n: int, last: bool) -> DataFrame:
    """Rows of FLAGS, by documents' buckets: removed spans and open pieces."""

    def bucket(t: pa.Table) -> pa.Table:
        e = unpack(ENTRY, t.column("entries").to_pylist())
        order, state = judge(e, last)
        later, still = order[state == 1], order[state == 2]
        span = {"doc": e["doc"][later], "lo": e["lo"][later], "hi": e["lo"][later] + e["size"][later]}
        op = joined([unpack(OPEN, t.column("open").to_pylist()), {k: e[k][still] for k in OPEN}])
        span = joined([unpack(SPAN, t.column("spans").to_pylist()), span])
        return pa.Table.from_batches([by_bucket(FLAGS, (OPEN, op, of_doc(op["doc"], n)), (SPAN, span, of_doc(span["doc"], n)))])

    return pieces.groupBy("bucket").applyInArrow(bucket, FLAGS)


def numbered(docs: DataFrame) -> DataFrame:
    """docs (_id, _text and more) with _doc, a number that orders documents: _id where that is a number, unique and never null.

    Otherwise rows are ranked by _id (null last), then text; equal rows are documents one after another.
    """
    whole = docs.schema["_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if whole and not docs.groupBy("_id").count().where("_id is null or count > 1").limit(1).count():
        return docs.withColumn("_doc", F.col("_id").cast("long"))
    return durable(ranked(docs, [F.col("_id").asc_nulls_last(), F.col("_text")], "_doc"))


class Corpus:
    """Documents packed into blocks by bucket of their number, to be met there by what is found out about them.

    keep: columns to have beside text, in the struct _row, so that no name of theirs can clash with one used here.
    """

    def __init__(self, docs: DataFrame, keep: list[str]):
        self.spark = docs.sparkSession
        short_batches(self.spark)
        row = F.struct(*[F.col(f"`{k}`") for k in keep if k != "text"])
        self.docs = numbered(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), row.alias("_row"))).select("_doc", "_text", "_row")
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n = max(shuffle_partitions(self.spark), math.ceil(size / BUCKET_BYTES))
        n = self.n

        def blocks(batches):
            held, size = [], 0
            for b in batches:
                for part, data, _ in text_chunks(b, "_text"):
                    held.append(part)
                    size += len(data)
                    if size >= HELD_BYTES:
                        yield from spread(held)
                        held, size = [], 0
            yield from spread(held)

        def spread(held):
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                rows = []
                for b, at in scatter(of_doc(t.column("_doc").to_numpy(), n)):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_table(t.take(pa.array(at)))
                    rows.append((b, sink.getvalue().to_pybytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "block"])

        self.packed = self.docs.mapInArrow(blocks, "bucket int, block binary")

    def pieces(self, cut, last: bool) -> DataFrame:
        """Rows of PIECES from cut(data, offsets) -> columns of ENTRY, doc being the text's place in the chunk and lo an offset in data."""
        n = self.n

        def run(batches):
            held, size = [], 0
            for b in batches:
                for part, data, offsets in text_chunks(b, "_text"):
                    e = cut(data, offsets)
                    text = e["doc"]
                    e |= {"doc": part.column("_doc").to_numpy()[text], "lo": e["lo"] - offsets[text]}
                    held.append(e)
                    size += len(text)
                    if size >= HELD_PIECES:
                        yield send(joined(held), n, last)
                        held, size = [], 0
            if size:
                yield send(joined(held), n, last)

        return self.docs.select("_doc", "_text").mapInArrow(run, PIECES)

    def meet(self, flags: DataFrame, each, schema: str, finish=None) -> DataFrame:
        """each(documents, data, offsets, open pieces, spans) -> RecordBatch, over all documents; doc and lo as in pieces.

        With finish, each returns anything, and finish(list of these) makes a bucket's RecordBatch.
        """

        def both(docs: pa.Table, found: pa.Table) -> pa.Table:
            op, sp = unpack(OPEN, found.column("open").to_pylist()), unpack(SPAN, found.column("spans").to_pylist())
            out = []
            for b in unblock(docs).to_batches():
                for part, data, offsets in text_chunks(b, "_text"):
                    number = part.column("_doc").to_numpy()
                    order = np.argsort(number)
                    own = []
                    for f, ends in ((op, ("lo",)), (sp, ("lo", "hi"))):
                        at = order[np.minimum(np.searchsorted(number[order], f["doc"]), len(order) - 1)]
                        mine = number[at] == f["doc"]
                        own.append(picked(f, mine) | {"doc": at[mine]})
                        for k in ends:
                            own[-1][k] = own[-1][k] + offsets[at[mine]]
                    out.append(each(part, data, offsets, *own))
            if finish:
                out = [finish(out)] if out else []
            return pa.Table.from_batches(out or [_empty(schema)])

        return self.packed.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(both, schema)


def unblock(docs: pa.Table) -> pa.Table:
    """The documents in the blocks of a bucket, in one piece."""
    blocks = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in docs.column("block")]
    return pa.concat_tables(blocks).combine_chunks() if blocks else pa.table({})


def _empty(schema: str) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return pa.RecordBatch.from_pylist([], schema=to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema))


def union(s: dict) -> dict:
    """Spans of the same document that overlap or touch, as one; in the order of documents and places."""
    order = np.lexsort((s["lo"], s["doc"]))
    doc, lo, hi = s["doc"][order], s["lo"][order], s["hi"][order]
    if not len(doc):
        return s
    # ends may lie within earlier spans of a document: carry the furthest one, document by document
    group = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
    far = np.maximum.accumulate(hi + group * (1 << 40)) - group * (1 << 40)
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (lo[1:] > far[:-1]))
    first = np.flatnonzero(fresh)
    return {"doc": doc[first], "lo": lo[first], "hi": far[np.append(first[1:], len(doc)) - 1]}


def removed(n: int, spans: dict) -> np.ndarray:
    """Mask of the bytes that lie in a span; spans are a union, so none overlap."""
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, spans["lo"], 1)
    np.subtract.at(edge, spans["hi"], 1)
    return np.cumsum(edge[:n], dtype=np.int8) > 0
