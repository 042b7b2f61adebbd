"""Substring dedup by content-defined chunks, cut by a gear rolling hash.

The gear hash of the last 32 bytes decides where a chunk ends, so an insertion
moves only the cuts around it. Of chunks with one digest the first in the
corpus stays. A chunk below MIN_CHUNK bytes goes on to the next cut, one of
MAX_CHUNK bytes is cut there, and the last of a text ends with it. A last chunk
below MIN_CHUNK bytes always stays, for short ends are alike by chance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm.common import SLICE, digests
from lorekeep.llm.firstseen import Corpus, removed, resolve, union

MIN_CHUNK, MAX_CHUNK = 64, 1024
#: One place in MASK + 1 is a cut, so chunks are about MIN_CHUNK + MASK + 1 bytes long.
MASK = np.uint32(31 << 27)
WINDOW = 32
GEAR = np.random.default_rng(2016).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def _marks(data: np.ndarray) -> list[int]:
    """Ends of chunks that the gear hash proposes, slice by slice with the bytes before that the hash reaches back to."""
    out = []
    for at in range(0, len(data), SLICE):
        back = max(0, at - WINDOW)
        # the gear hash is the sum of the last bytes' gears, each shifted by its age: of 1, 2, 4 ... bytes in turn
        h, have = GEAR[data[back : at + SLICE]], 1
        while have < WINDOW:
            older = np.zeros_like(h)
            older[have:] = h[:-have] << np.uint32(have)
            h, have = h + older, 2 * have
        out += (np.flatnonzero((h[at - back :] & MASK) == 0) + at + 1).tolist()
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the chunks of the texts in data."""
    text, start, end, k = [], [], [], 0
    cut = _marks(data)
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while a < b:
            # hashes that reach back before the text do not count
            least, most = a + MIN_CHUNK, min(b, a + MAX_CHUNK)
            while k < len(cut) and cut[k] < least:
                k += 1
            to = cut[k] if k < len(cut) and cut[k] <= most else most
            text.append(d), start.append(a), end.append(to)
            a = to
    return np.array(text, np.int64), np.array(start, np.int64), np.array(end, np.int64)


def _chunks(data: np.ndarray, offsets: np.ndarray) -> dict:
    text, lo, hi = cuts(data, offsets)
    long = hi - lo >= MIN_CHUNK
    text, lo, hi = text[long], lo[long], hi[long]
    core, content = digests(data, lo, hi)
    zero = np.zeros(len(lo), np.uint8)
    return {"core": core, "content": content, "more": np.zeros(len(lo), np.uint64), "doc": text, "lo": lo, "size": hi - lo, "off": zero, "open": zero}


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed_chunks, n_removed, kept_sha256: one row per row of docs.

    Digests are BLAKE2b of 128 bits. The first chunk is the one of the smallest doc_id, then offset; a null doc_id comes last, rows
    with the same doc_id go by text, and of equal rows the later is a copy. A null or empty text has no chunks.
    """
    corpus = Corpus(docs, ["doc_id"])
    flags = resolve(corpus.pieces(_chunks, True), corpus.n, True)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(part, data, offsets, op, spans):
        text, _, _ = cuts(data, offsets)
        gone = removed(len(data), union(spans))
        ends, n = offsets.tolist(), part.num_rows
        size = np.bincount(spans["doc"], weights=spans["hi"] - spans["lo"], minlength=n).astype(np.int64)
        digest = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]
        return pa.RecordBatch.from_arrays(
            [
                part.column("_row").field("doc_id"), pa.array(np.diff(offsets)), pa.array(np.bincount(text, minlength=n).astype(np.int64)),
                pa.array(np.bincount(spans["doc"], minlength=n).astype(np.int64)), pa.array(size), pa.array(digest, pa.string()),
            ],
            ["doc_id", "n_bytes", "n_chunks", "n_removed_chunks", "n_removed", "kept_sha256"],
        )

    return corpus.meet(flags, each, f"doc_id {kind}, n_bytes long, n_chunks long, n_removed_chunks long, n_removed long, kept_sha256 string")
