"""Benchmark decontamination with suffix arrays of the training text.

Each task sorts the suffixes of its shard of the documents, word by word, into
a suffix array; every suffix of every benchmark item is binary-searched in it
for the documents' words that repeat it verbatim. A suffix that does not begin
with two words that stand so in some item cannot repeat a window, so it is left
out of the sort. Matches that continue each other are joined into the longest.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import Shared, short_batches, text_bytes, text_chunks, words_of

WINDOW = 10
#: Words of benchmark text, and so windows at most, that are broadcast and searched at once; more is searched block after block.
BLOCK_WORDS = 100_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Word bytes: 0-9, a-z and all of non-ASCII characters.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def _spelt(text: bytes) -> list[bytes]:
    """The words themselves, as words_of counts them."""
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())


class Items:
    """The benchmark's windows, sorted, over word numbers from 1; 0 is any word that no item has."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        self.ids = ids
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        words, owner = words_of(data, offsets, IN_WORD, LOWER)
        self.words = [_spelt(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        self.vocabulary = np.unique(words)
        number = (np.searchsorted(self.vocabulary, words) + 1).astype(np.int64)
        rows, width, item, place = [], [], [], []
        counts = np.bincount(owner, minlength=len(ids)) if len(ids) else np.zeros(0, int)
        at = 0
        for i, n in enumerate(counts.tolist()):
            w = min(WINDOW, n)
            for k in range(n - w + 1 if n else 0):
                rows.append(number[at + k : at + k + w])
                width.append(w), item.append(i), place.append(k)
            at += n
        self.width, self.item, self.place = np.array(width, int), np.array(item, int), np.array(place, int)
        self.low, self.high = self._keys(rows, 0), self._keys(rows, (1 << 32) - 1)
        # the least start that a suffix must share: two words, or one where an item has but one
        self.lead = min(2, int(self.width.min())) if rows else 1
        self.leads = np.unique([self.pair(r[0], r[1] if self.lead == 2 else 0) for r in rows]) if rows else np.zeros(0, np.int64)

    @staticmethod
    def pair(a, b):
        return a * (1 << 31) + b

    @staticmethod
    def _keys(rows: list, fill: int) -> np.ndarray:
        out = np.full((len(rows), WINDOW), fill, ">u4")
        for r, x in zip(out, rows):
            r[: len(x)] = x
        return out.view(f"S{4 * WINDOW}").ravel() if len(rows) else np.zeros(0, f"S{4 * WINDOW}")

    def matches(self, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, place in it, first word in the shard, words) of each longest verbatim match of a window or more."""
        none = (np.zeros(0, int),) * 4
        if not len(self.low) or not len(words):
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        number = np.where(self.vocabulary[at] == words, at + 1, 0).astype(np.int64)
        follow = np.zeros(len(number), np.int64)
        if self.lead == 2:
            follow[:-1] = np.where(owner[1:] == owner[:-1], number[1:], 0)
        suffix = np.flatnonzero((number > 0) & np.isin(self.pair(number, follow), self.leads))
        if not len(suffix):
            return none
        # the suffix array: starts of suffixes in the order of their first WINDOW words, texts ending in 0
        reach = suffix[:, None] + np.arange(WINDOW)
        clip = np.minimum(reach, len(number) - 1)
        key = np.where((reach < len(number)) & (owner[clip] == owner[suffix][:, None]), number[clip], 0).astype(">u4")
        key = np.ascontiguousarray(key).view(f"S{4 * WINDOW}").ravel()
        order = np.argsort(key, kind="stable")
        key, suffix = key[order], suffix[order]
        lo, hi = np.searchsorted(key, self.low, "left"), np.searchsorted(key, self.high, "right")
        n = hi - lo
        window = np.repeat(np.arange(len(n)), n)
        if not len(window):
            return none
        start = suffix[np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        # windows one after another in the same item and text are parts of one longer match
        item, place = self.item[window], self.place[window]
        order = np.lexsort((start, start - place, item))
        item, place, start, width = item[order], place[order], start[order], self.width[window][order]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (start[1:] != start[:-1] + 1) | (owner[start[1:]] != owner[start[:-1]])
        first = np.flatnonzero(fresh)
        run = np.diff(np.append(first, len(start)))
        return item[first], place[first], start[first], run - 1 + width[first]

    def found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, first word in the text, place in the item, words) of the longest verbatim matches, and all texts' words: (n of each).

        matches goes by hashes; here each of its matches is compared word by word, and what differs is cut out of it.
        """
        words, owner = words_of(data, offsets, IN_WORD, LOWER)
        counts = np.bincount(owner, minlength=len(offsets) - 1)
        item, place, start, n = self.matches(words, owner)
        who = owner[start]
        start = start - (np.cumsum(counts) - counts)[who]
        out, spelt = [], {}
        for w, i, s, p, k in sorted(zip(who.tolist(), item.tolist(), start.tolist(), place.tolist(), n.tolist())):
            if w not in spelt:
                spelt = {w: _spelt(data[offsets[w] : offsets[w + 1]].tobytes())}
            text, own = spelt[w][s : s + k], self.words[i][p : p + k]
            if text == own:
                out.append((w, i, s, p, k))
                continue
            least, at = min(WINDOW, len(self.words[i])), 0
            for end in [j for j in range(k) if text[j] != own[j]] + [k]:
                if end - at >= least:
                    out.append((w, i, s + at, p + at, end - at))
                at = end + 1
        cols = np.array(out, np.int64).reshape(-1, 5).T
        return (*cols, counts)


def _blocks(benchmark: DataFrame, block_words: int):
    """Items in blocks of about block_words words, by a hash of their id and text; what is broadcast does not grow with the benchmark."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")
    size = rows.agg(F.sum(F.regexp_count(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    n = max(1, math.ceil(size / block_words))
    for k in range(n):
        found = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()
        yield Items([r["id"] for r in found], [r["text"] for r in found])


def find_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): all longest verbatim matches, of WINDOW words or a whole shorter item."""
    rows, out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), None
    kind = rows.schema["doc_id"].dataType.simpleString()
    for items in _blocks(benchmark, block_words):
        shared = Shared(docs.sparkSession, items)

        def run(batches, shared=shared):
            for b in batches:
                for part, data, offsets in text_chunks(b, "_text"):
                    who, item, start, place, n, _ = shared.value.found(data, offsets)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(who)), pa.array([shared.value.ids[i] for i in item], pa.string()), pa.array(start), pa.array(place), pa.array(n)],
                        ["doc_id", "item_id", "doc_word", "item_word", "n_words"],
                    )

        found = rows.mapInArrow(run, f"doc_id {kind}, item_id string, doc_word long, item_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def _merge(spans: np.ndarray) -> np.ndarray:
    """Spans [start, end), as a union of separate ones."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.column_stack([spans[fresh, 0], reach[np.append(fresh[1:], len(spans)) - 1]])


def measure(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """keep (default: all columns of docs) as struct row, with n_words, spans, items for every row of docs.

    Blocks of the benchmark are searched one after another, each adding to the spans and items of the one before.
    """
    short_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(b"").alias("spans"), F.array().cast("array<string>").alias("items"))
    for items in _blocks(benchmark, block_words):
        shared = Shared(docs.sparkSession, items)

        def run(batches, shared=shared):
            for b in batches:
                for part, data, offsets in text_chunks(b, "text"):
                    who, item, start, _, n, words = shared.value.found(data, offsets)
                    spans, ids = part.column("spans").to_pylist(), part.column("items").to_pylist()
                    order = np.argsort(who, kind="stable")
                    for g in np.split(order, np.flatnonzero(np.diff(who[order])) + 1) if len(order) else []:
                        d = int(who[g[0]])
                        own = np.column_stack([start[g], start[g] + n[g]]).astype(np.int64)
                        spans[d] = _merge(np.concatenate([np.frombuffer(spans[d], np.int64).reshape(-1, 2), own])).tobytes()
                        ids[d] = sorted({*ids[d], *(shared.value.ids[i] for i in set(item[g].tolist()))})
                    counts = pa.array(words.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), counts, pa.array(spans, pa.binary()), pa.array(ids, pa.list_(pa.string()))], ["row", "text", "n_words", "spans", "items"])

        rows = rows.mapInArrow(run, rows.schema)
    return rows.drop("text")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all their columns."""
    return measure(docs, benchmark).where(F.length("spans") == 0).select("row.*")


def op3(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs. Equal item_ids are one item, a null one is "". Null and empty texts have no words; without
    items nothing is contaminated."""
    rows = measure(docs, benchmark, ["doc_id"])

    def run(batches):
        for b in batches:
            hit = [int((s[:, 1] - s[:, 0]).sum()) for s in (np.frombuffer(x, np.int64).reshape(-1, 2) for x in b.column("spans").to_pylist())]
            items = b.column("items").to_pylist()
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("row.doc_id", "n_words", "spans", "items").mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS g(i) WHERE len(w) > 0),
dw AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM bw), unnest(range(1, len(w) - k + 2)) AS g(i) WHERE len(w) >= k),
h AS (SELECT r, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
p AS (SELECT r, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + k)) AS g(j) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
