"""Many words in one pass over a text: an Aho-Corasick automaton of them, built in each task from a broadcast list.

A list too long to broadcast is dealt out in blocks of bounded size, and texts are read once for each block.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

#: Bytes of words that are broadcast at once.
BLOCK_BYTES = 16 << 20


def _scanner(words: list[str]):
    import ahocorasick

    tree = ahocorasick.Automaton()
    for i, w in enumerate(words):
        tree.add_word(w, i)
    tree.make_automaton()
    return lambda text: sorted({i for _, i in tree.iter(text)})


def with_found(df: DataFrame, text: str, words: list[str], name: str) -> DataFrame:
    """df with name: the numbers of the words (no empty ones) that stand in the text, rising; of a null text none."""
    shared = df.sparkSession.sparkContext.broadcast(list(words))
    schema = StructType([*df.schema.fields, StructField(name, ArrayType(IntegerType()))])

    def run(batches):
        find = _scanner(shared.value)
        for b in batches:
            hits = pa.array([find(t) if t else [] for t in b.column(b.schema.get_field_index(text)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, hits], [*b.schema.names, name])

    return df.mapInArrow(run, schema)


def block_count(rows: DataFrame, size: Column, block_bytes: int) -> int:
    """How many blocks hold the rows, whose bytes size gives, when they are dealt by a hash."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return max(1, -(-int(total) // block_bytes))


def found_words(texts: DataFrame, words: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """((id, words), blocks): the words (word, each once, not empty) that stand in each of texts (id, text), of those with any.

    With several blocks a text has a row for each block that it holds words of.
    """
    blocks = block_count(words, F.octet_length("word") + 8, block_bytes)
    schema = StructType([StructField("id", texts.schema["id"].dataType), StructField("words", ArrayType(StringType()))])
    found = []
    for k in range(blocks):
        own = [r["word"] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == k).collect()]  # about block_bytes
        shared = texts.sparkSession.sparkContext.broadcast(own)

        def run(batches, shared=shared):
            own = shared.value
            find = _scanner(own)
            for b in batches:
                hits = [find(t) if t and own else [] for t in b.column(1).to_pylist()]
                rows = pa.array([i for i, h in enumerate(hits) if h], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([[own[i] for i in h] for h in hits if h], pa.list_(pa.string()))], ["id", "words"])

        found.append(texts.select("id", "text").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found), blocks


def found_numbers(texts: DataFrame, words: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, words): which of the words (word, number; each once, not empty) stand in each of texts (id, text), of those with any.

    words are numbers of eight bytes each, in no order. An id may have several rows, but few of a batch if it has most of its texts.
    Equal texts of a batch are read once.
    """
    blocks = block_count(words, F.octet_length("word") + 8, block_bytes)
    schema = StructType([StructField("id", texts.schema["id"].dataType), StructField("words", BinaryType())])
    found = []
    for k in range(blocks):
        own = words.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == k).collect()  # about block_bytes
        shared = texts.sparkSession.sparkContext.broadcast(([r["word"] for r in own], np.array([r["number"] for r in own], np.int64)))

        def run(batches, shared=shared):
            own, numbers = shared.value
            find = _scanner(own)
            for b in batches:
                text = b.column(1).dictionary_encode()
                packed = pa.array([numbers[find(t)].tobytes() or None if t and own else None for t in text.dictionary.to_pylist()], pa.binary())
                hits = packed.take(text.indices)
                ids, hits = b.column(0).filter(hits.is_valid()), hits.drop_null()
                key = ids.dictionary_encode("encode")
                if len(key) > 2 * len(key.dictionary):
                    held = [set() for _ in range(len(key.dictionary))]
                    for i, h in zip(key.indices.to_pylist(), hits.to_pylist()):
                        held[i].add(h)
                    ids = key.dictionary
                    hits = pa.array([h.pop() if len(h) == 1 else np.unique(np.frombuffer(b"".join(h), np.int64)).tobytes() for h in held], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, hits], ["id", "words"])

        found.append(texts.select("id", "text").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found)


#: Bytes that a task remembers of what it has counted.
KEPT_BYTES = 32 << 20


class Holders:
    """How many of lists of numbers hold any of some numbers.

    A number that one of 64 lists or more hold is a common one and has bits, one for each list; the lists of others are places in an array.
    So what is kept grows with the lists alone. Numbers asked for are a mask of common ones and the places of lists that these leave out.
    """

    def __init__(self, lists: pa.ListArray):
        self.size = len(lists)
        self.own, at = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.place = np.repeat(np.arange(self.size, dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.own)))])
        self.common, self.bits = {}, []
        for i in np.flatnonzero(np.diff(self.ends) * 64 >= self.size).tolist():
            bits = np.zeros(self.size, np.uint8)
            bits[self._places(i)] = 1
            self.common[i] = 1 << len(self.bits)
            self.bits.append(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"))
        most = max(1, KEPT_BYTES // (self.size // 8 + 256))
        self.of, self._united = lru_cache(most)(self.found), lru_cache(most)(self._united)

    def _places(self, i: int) -> np.ndarray:
        return self.place[self.ends[i] : self.ends[i + 1]]

    def _united(self, mask: int) -> tuple[int, np.ndarray]:
        """How many lists hold any of the common numbers, and their bits."""
        bits = reduce(or_, (self.bits[j] for j in range(mask.bit_length()) if mask >> j & 1), 0)
        return bits.bit_count(), np.frombuffer(bits.to_bytes(self.size // 8 + 1, "little"), np.uint8)

    def _left(self, mask: int, places: list) -> np.ndarray:
        few, held = np.concatenate(places), self._united(mask)[1]
        few = few[held[few >> 3] >> (few & 7) & 1 == 0]
        return np.unique(few) if len(few) > 1 else few

    def found(self, numbers: bytes) -> tuple[int, list]:
        """The mask and the places (an array, or none) of numbers of eight bytes each; of remembers it."""
        asked = np.frombuffer(numbers, np.int64)
        mask, places = 0, []
        for i, n in zip(np.searchsorted(self.own, asked).tolist(), asked.tolist()):
            if i < len(self.own) and self.own[i] == n:
                if i in self.common:
                    mask |= self.common[i]
                else:
                    places.append(self._places(i))
        return mask, [left] if places and len(left := self._left(mask, places)) else []

    def count(self, mask: int, places: list) -> int:
        return self._united(mask)[0] + (len(self._left(mask, places)) if places else 0)
