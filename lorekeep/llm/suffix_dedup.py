"""Removal of repeated 100-byte strings, by prefix-free parsing.

The parse (parsing.py) turns texts into phrases of a dictionary. A phrase reaches 99 bytes into the next one, so a suffix
of a text is told by the suffix of its phrase as far as the contract looks, and of equal phrases every occurrence but the
parse's first repeats all its windows. What is left are distinct phrases that share a trigger. Where these differ is found
in steps of STEP windows; the windows of the steps that are still in doubt are suffixes of dictionary phrases, and they are
put in the order of their letters, all over the corpus: a suffix array that is dealt to tasks by ranges of letters. In it
equal suffixes are neighbours, in the order of the parse, and all but the first of them are repeats.

Dictionary entries themselves are compared by their digests: ordering all of them by letters would send the corpus's text
several times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import digests, mix64, shuffle_partitions, stored
from lorekeep.llm.firstseen import FLAGS, OPEN, PIECES, SPAN, Corpus, by_bucket, joined, of_doc, removed, resolve, send, union
from lorekeep.llm.parsing import LENGTH, Parse

STEP = 8


def _phrases(data: np.ndarray, offsets: np.ndarray) -> dict:
    p = Parse(data, offsets)
    content, more = p.contents()
    zero = np.zeros(len(p.lo), np.uint8)
    return {"core": p.trigger, "content": content, "more": more, "doc": p.text, "lo": p.lo, "size": p.hi - p.lo + LENGTH, "off": p.at - p.lo, "open": zero}


def _steps(data: np.ndarray, offsets: np.ndarray, op: dict) -> dict:
    """Open phrases as pieces of up to STEP windows, counted back from the trigger, so that equal windows are in like pieces."""
    trigger = op["lo"] + op["off"]
    low, high = trigger - (op["lo"] + op["size"] - LENGTH), op["off"].astype(np.int64)  # distances from a window's start to the trigger
    first, last = np.maximum(low, 0) // STEP, high // STEP
    n = (last - first + 1).astype(np.int64)
    src = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n) + first[src]
    far, near = np.minimum(j * STEP + STEP - 1, high[src]), np.maximum(j * STEP, low[src])
    lo, hi = trigger[src] - far, trigger[src] - near + LENGTH
    core, _ = digests(data, trigger[src] - j * STEP, trigger[src] - j * STEP - STEP + 1 + LENGTH)
    content, more = digests(data, lo, hi)
    zero = np.zeros(len(lo), np.uint8)
    return {"core": mix64(core + j.astype(np.uint64)), "content": content ^ mix64((far * 128 + near).astype(np.uint64)), "more": more, "doc": op["doc"][src], "lo": lo, "size": hi - lo, "off": zero, "open": zero}


def _named(part, offsets, e: dict) -> dict:
    """Columns with documents' numbers and offsets in them, from places in a chunk."""
    number, at = part.column("_doc").to_numpy(), e["doc"]
    return e | {k: e[k] - offsets[at] for k in ("lo", "hi") if k in e} | {"doc": number[at]}


def _in_steps(corpus: Corpus, flags: DataFrame) -> DataFrame:
    """Rows of FLAGS after the open phrases are compared step by step."""
    n = corpus.n

    def each(part, data, offsets, op, spans):
        return _named(part, offsets, _steps(data, offsets, op)), union(_named(part, offsets, spans))

    def finish(found):
        return send(joined([e for e, _ in found]), n, False, joined([s for _, s in found]))

    return resolve(corpus.meet(flags, each, PIECES, finish), n, False)


SUFFIXES = "bucket int, spans binary, suffix binary, doc long, lo long"


def _suffixes(corpus: Corpus, flags: DataFrame) -> DataFrame:
    """Rows of SUFFIXES: the spans known so far, by documents' buckets, and the suffixes in doubt, cut at LENGTH bytes.

    Of suffixes that are equal inside a task only the first goes on; the others are spans.
    """
    n = corpus.n

    def each(part, data, offsets, op, spans):
        k = (op["size"] - LENGTH + 1).astype(np.int64)
        lo = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(op["lo"], k)
        letters = data[lo[:, None] + np.arange(LENGTH)].view(f"V{LENGTH}").ravel() if len(lo) else np.zeros(0, f"V{LENGTH}")
        return _named(part, offsets, {"doc": np.repeat(op["doc"], k), "lo": lo}) | {"suffix": letters}, union(_named(part, offsets, spans))

    def finish(found):
        e, spans = joined([e for e, _ in found]), joined([s for _, s in found])
        letters = e["suffix"].view(np.uint8).reshape(-1, LENGTH) if len(e["lo"]) else np.zeros((0, LENGTH), np.uint8)
        # equal rows of letters are neighbours in the order of eight-byte words
        order = np.lexsort((e["lo"], e["doc"], *np.ascontiguousarray(np.pad(letters, ((0, 0), (0, -LENGTH % 8)))).view(np.uint64).T))
        letters, doc, lo = letters[order], e["doc"][order], e["lo"][order]
        later = np.zeros(len(order), bool)
        later[1:] = (letters[1:] == letters[:-1]).all(axis=1)
        spans = union(joined([spans, {"doc": doc[later], "lo": lo[later], "hi": lo[later] + LENGTH}]))
        known = by_bucket("bucket int, spans binary", (SPAN, spans, of_doc(spans["doc"], n)))
        letters, doc, lo = letters[~later], doc[~later], lo[~later]
        a, b = len(known), len(doc)
        suffix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), b, [None, pa.py_buffer(np.ascontiguousarray(letters))]).cast(pa.binary()) if b else pa.array([], pa.binary())
        cols = [
            pa.concat_arrays([known.column("bucket"), pa.nulls(b, pa.int32())]), pa.concat_arrays([known.column("spans"), pa.nulls(b, pa.binary())]), pa.concat_arrays([pa.nulls(a, pa.binary()), suffix]),
            pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(doc)]), pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(lo)]),
        ]
        return pa.RecordBatch.from_arrays(cols, ["bucket", "spans", "suffix", "doc", "lo"])

    return corpus.meet(flags, each, SUFFIXES, finish)


def _neighbours(suffixes: DataFrame, n: int) -> DataFrame:
    """Rows of FLAGS with the spans of suffixes that equal the one before them in the order of letters and of the parse."""

    def run(batches):
        last = None
        for b in batches:
            data = b.column("suffix").buffers()[2]
            if not b.num_rows:
                continue
            at = np.frombuffer(b.column("suffix").buffers()[1], np.int32)[b.column("suffix").offset]
            letters = np.frombuffer(data, np.uint8)[at : at + b.num_rows * LENGTH].reshape(-1, LENGTH)
            later = np.zeros(len(letters), bool)
            later[1:] = (letters[1:] == letters[:-1]).all(axis=1)
            later[0] = last is not None and bool((letters[0] == last).all())
            last = letters[-1].copy()
            doc, lo = b.column("doc").to_numpy()[later], b.column("lo").to_numpy()[later]
            yield by_bucket(FLAGS, (OPEN, {k: np.zeros(0, t) for k, t in OPEN.items()}, np.zeros(0, np.int64)), (SPAN, {"doc": doc, "lo": lo, "hi": lo + LENGTH}, of_doc(doc, n)))

    array = suffixes.select("suffix", "doc", "lo").repartitionByRange(shuffle_partitions(suffixes.sparkSession), "suffix").sortWithinPartitions("suffix", "doc", "lo")
    return array.mapInArrow(run, FLAGS)


def _repeats(docs: DataFrame, keep: list[str]) -> tuple[Corpus, DataFrame]:
    corpus = Corpus(docs, keep)
    flags = resolve(corpus.pieces(_phrases, False), corpus.n, False)
    rows = stored(_suffixes(corpus, _in_steps(corpus, flags)))
    known = rows.where("bucket is not null").select("bucket", F.lit(None).cast("binary").alias("open"), "spans")
    return corpus, known.unionByName(_neighbours(rows.where("suffix is not null"), corpus.n))


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs.

    A null text has no bytes, and a text below 100 bytes loses none. Of rows with the same doc_id the smaller text comes
    first; of equal rows the later is a copy and loses all that it can. A null doc_id comes last.
    """
    corpus, flags = _repeats(docs, ["doc_id"])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(part, data, offsets, op, spans):
        spans, n = union(spans), part.num_rows
        gone, ends = removed(len(data), spans), offsets.tolist()
        count = np.bincount(spans["doc"], minlength=n)
        size = np.bincount(spans["doc"], weights=spans["hi"] - spans["lo"], minlength=n).astype(np.int64)
        digest = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]
        return pa.RecordBatch.from_arrays(
            [part.column("_row").field("doc_id"), pa.array(np.diff(offsets)), pa.array(size), pa.array(count.astype(np.int64)), pa.array(digest, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return corpus.meet(flags, each, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes cut out of text, and n_chars counted anew; texts of which nothing is left go.

    Bytes of a character that lost others are dropped with them. A text that was null or empty before stays as it was.
    """
    names = docs.columns
    corpus, flags = _repeats(docs, names)

    def each(part, data, offsets, op, spans):
        gone = removed(len(data), union(spans))
        ends = offsets.tolist()
        had = part.column("_text").is_valid().to_pylist()
        texts = [data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") if ok else None for a, b, ok in zip(ends, ends[1:], had)]
        stays = pa.array([not ok or a == b or t != "" for a, b, ok, t in zip(ends, ends[1:], had, texts)])
        row = part.column("_row")
        cols = [pa.array(texts, pa.string()) if k == "text" else row.field(k) for k in names]
        if "n_chars" in names:
            at = names.index("n_chars")
            cols[at] = pa.array([cols[at][i].as_py() if t is None else len(t) for i, t in enumerate(texts)], cols[at].type)
        return pa.RecordBatch.from_arrays(cols, names).filter(stays)

    return corpus.meet(flags, each, docs.schema).select(*names)
