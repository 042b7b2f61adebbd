"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary.

Words are counted, and the vocabulary is put into Bloom filters of 64-bit blocks, one shard for each length, which are
broadcast. Every word's edits (a letter deleted, or replaced by a later one of the alphabet; an insertion is a deletion
seen from the longer word) are probed against the filters. Edits that pass are joined with the vocabulary itself, which
removes false positives, and each pair that is left is seen from both its words. A vocabulary whose filters would be too
large to broadcast is searched in rounds, a bounded filter each.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import Shared, durable, mix64

#: Letters, fixed by the contract; code points of a word at least, and occurrences.
LETTERS = "A-Za-zÀ-ÿ"
LEAST, TWICE = 7, 2
#: One occurrence in about so many is misspelt on purpose; a form must be so many times as frequent.
MISSPELT, TIMES = 31, 10
#: Bits of filter for a word, bits that a word sets, and the bytes of filter that are broadcast in one round at most.
BITS, SET, ROUND_BYTES = 24, 5, 48 << 20
#: Words from this length on share a shard.
LONG = 64
#: Entries of a matrix of edits.
ENTRIES = 1 << 19
TABLE = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def occurrences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): each maximal run of letters, A-Z in lower case, long enough to count; of some, by the checksum of document and run, a letter is deleted."""
    runs = documents.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{LEAST},}}"), F.lit(0))).alias("r"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.when(F.octet_length("r") == F.length("r"), F.lower("r")).otherwise(F.translate("r", upper, lower))
    rows = runs.select("d", low.alias("r"))
    rows = rows.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "r").cast("binary")))
    at: Column = (F.col("h") % F.length("r")).cast("int")
    cut = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))
    return rows.select(F.when(F.col("h") % MISSPELT == 0, cut).otherwise(F.col("r")).alias("word")).where(F.length("word") >= LEAST)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = BASE
    return np.cumprod(out, dtype=np.uint64)


def _matrices(words: list[str], rest: list):
    """Words by length: (letters as a matrix of Latin-1 codes, what rest says of each of them)."""
    size = np.array([len(w) for w in words])
    for length in np.unique(size).tolist():
        own = np.flatnonzero(size == length)
        step = max(1, ENTRIES // (64 * length) if length < LONG else 1)
        for at in range(0, len(own), step):
            some = own[at : at + step]
            m = np.frombuffer("".join([words[i] for i in some]).encode("latin-1"), np.uint8).reshape(-1, length)
            yield m, [rest[i] for i in some]


def _sums(m: np.ndarray) -> np.ndarray:
    """A hash of each row, linear in its letters, so that an edit changes it by what the edit changes."""
    return (TABLE[m] * _powers(m.shape[1])).sum(axis=1, dtype=np.uint64)


def _places(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(mixed hash, the bits of its block that a word sets)."""
    mixed = mix64(h ^ np.uint64(length * 0x632BE59BD9B4E019 % (1 << 64)))
    mask = np.uint64(1) << (mixed & np.uint64(63))
    for k in range(1, SET):
        mask = mask | (np.uint64(1) << ((mixed >> np.uint64(6 * k)) & np.uint64(63)))
    return mixed, mask


def _slot(mixed: np.ndarray, blocks: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part of the shard, block in it)."""
    high = mixed >> np.uint64(32)
    return (mix64(mixed) % np.uint64(parts)).astype(np.int64), ((high * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def plan_rounds(counts: dict[int, int], most: int = ROUND_BYTES) -> list[dict]:
    """What each round's filters hold: {shard: (blocks of a part, parts, [its parts in this round])}, at most most bytes in all."""
    rounds, used, now = [], 0, {}
    for shard, n in sorted(counts.items()):
        parts = max(1, -(-n * BITS // (8 * most)))
        blocks = max(1, -(-n * BITS // (64 * parts)))
        for part in range(parts):
            if used and used + 8 * blocks > most:
                rounds.append(now)
                used, now = 0, {}
            now.setdefault(shard, (blocks, parts, []))[2].append(part)
            used += 8 * blocks
    return [*rounds, now] if now else rounds


def _filters(vocabulary: DataFrame, plan: dict) -> dict[tuple[int, int], np.ndarray]:
    """{(shard, part): blocks of the words in it}, put together by tasks and fetched as columns; its size is the plan's."""

    def run(batches):
        for b in batches:
            words = b.column("word").to_pylist()
            for m, _ in _matrices(words, words):
                shard = min(m.shape[1], LONG)
                blocks, parts, own = plan[shard]
                mixed, mask = _places(_sums(m), m.shape[1])
                part, block = _slot(mixed, blocks, parts)
                ok = np.isin(part, own)
                n = int(ok.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(part[ok].astype(np.int32)), pa.array(block[ok]), pa.array(mask[ok].view(np.int64))], ["shard", "part", "block", "mask"])

    rows = vocabulary.where(F.least(F.length("word"), F.lit(LONG)).isin(list(plan))).select("word").mapInArrow(run, "shard int, part int, block long, mask long")
    got = rows.groupBy("shard", "part", "block").agg(F.bit_or("mask").alias("mask")).toArrow()
    shard, part, block, mask = (got.column(c).to_numpy() for c in ("shard", "part", "block", "mask"))
    out = {}
    for s, (blocks, _, own) in plan.items():
        for p in own:
            filled, here = np.zeros(blocks, np.int64), (shard == s) & (part == p)
            filled[block[here]] = mask[here]
            out[s, p] = filled.view(np.uint64)
    return out


def _candidates(vocabulary: DataFrame, plan: dict, alphabet: list[int]) -> DataFrame:
    """(word, n, edit): edits of words of the vocabulary that the filters of the plan may hold."""
    shared = Shared(vocabulary.sparkSession, (plan, _filters(vocabulary, plan), np.array(alphabet, np.uint8)))

    def held(h, length):
        """Which of the hashes of words of this length the round's filters may hold."""
        plan, filters, _ = shared.value
        shard = min(length, LONG)
        if shard not in plan:
            return np.zeros(h.shape, bool)
        blocks, parts, own = plan[shard]
        mixed, mask = _places(h, length)
        part, block = _slot(mixed, blocks, parts)
        found = np.zeros(h.shape, bool)
        for p in own:
            found |= (filters[shard, p][block] & mask == mask) & (part == p)
        return found

    def replaced(m, h):
        """(row, edited word) of replacements of a letter by a later one of the alphabet."""
        letters = shared.value[2]
        power = _powers(m.shape[1])
        for i in range(m.shape[1]):
            ok = held(h[:, None] + (TABLE[letters][None] - TABLE[m[:, i]][:, None]) * power[i], m.shape[1]) & (letters[None] > m[:, i][:, None])
            row, letter = np.nonzero(ok)
            edited = m[row]
            edited[:, i] = letters[letter]
            yield row, edited

    def deleted(m, h):
        """(row, edited word) of deletions; of a run of equal letters the first stands for all."""
        length = m.shape[1]
        terms = TABLE[m] * _powers(length)
        before = np.zeros(len(m), np.uint64)
        back = np.uint64(pow(int(BASE), -1, 1 << 64))
        for i in range(length):
            after = (h - before - terms[:, i]) * back  # what follows moves up by one place
            ok = held(before + after, length - 1)
            if i:
                ok &= m[:, i] != m[:, i - 1]
            row = np.flatnonzero(ok)
            yield row, np.delete(m[row], i, axis=1)
            before = before + terms[:, i]

    def run(batches):
        for b in batches:
            words, counts = b.column("word").to_pylist(), b.column("n").to_pylist()
            for m, own in _matrices(words, list(zip(words, counts))):
                h, length = _sums(m), m.shape[1]
                for row, edited in [*deleted(m, h), *replaced(m, h)] if length < LONG else (x for f in (deleted, replaced) for x in f(m, h)):
                    if len(row):
                        text = edited.tobytes().decode("latin-1")
                        size = edited.shape[1]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([own[r][0] for r in row]), pa.array([own[r][1] for r in row], pa.int64()), pa.array([text[k : k + size] for k in range(0, len(text), size)])], ["word", "n", "edit"]
                        )

    # a word of one length probes its own shard and that of the words a letter shorter
    near = sorted({s for s in plan} | {min(s + 1, LONG) for s in plan})
    rows = vocabulary.where(F.least(F.length("word"), F.lit(LONG)).isin(near))
    return rows.mapInArrow(run, "word string, n long, edit string")


def near_words(vocabulary: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words of the vocabulary (word, n; each word once) that one edit parts, once."""
    spark = vocabulary.sparkSession
    counts = {r["s"]: r["k"] for r in vocabulary.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("s")).agg(F.count("*").alias("k")).collect()}  # a row a shard
    alphabet = sorted(ord(r["c"]) for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())  # Latin-1 letters
    found = [durable(_candidates(vocabulary, plan, alphabet)) for plan in plan_rounds(counts, round_bytes)]
    if not found:
        return spark.createDataFrame([], "a string, a_n long, b string, b_n long")
    b = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("b_n"))
    return reduce(DataFrame.unionByName, found).join(b, "edit").select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("edit").alias("b"), "b_n")


def group_variants(vocabulary: DataFrame, times: int = TIMES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n).

    A word's form is its near word of largest n, ties going to the smallest in code-point order, if that n is at least times
    the word's; root is the last of the forms that follow. As n grows with each step, chains are short: times to the number
    of steps is at most the largest n.
    """
    vocabulary = durable(vocabulary)
    pairs = near_words(vocabulary, round_bytes)
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"{a}_n").alias("n"), F.col(b).alias("near"), F.col(f"{b}_n").alias("near_n"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    rows = both.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    takes = -F.col("best.less") >= F.lit(times) * F.col("n")
    rows = durable(rows.select("word", "n", "n_near", F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")))
    links = durable(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # roots jump twice as far each time
        far = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = durable(links.join(far, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """group_variants of the words of whole texts that occur TWICE or more.

    A null text has no words; a null doc_id counts as an empty one where misspellings are made. Each row of documents counts,
    repeated ones too. Only the columns named are read. An empty table gives no rows.
    """
    counts = occurrences(documents, doc_id, text).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TWICE)
    return group_variants(counts)


def op13(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """variants of all documents; nulls, repeated rows, ties and empty tables as there."""
    return variants(documents)
