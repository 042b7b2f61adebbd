"""N-gram Jaccard join with parity sketches.

A document's set is its distinct word shingles. In a size band of B blocks every
shingle is XORed into the block that its hash names, and each block that holds
any gives a token. A shingle in one set but not in the other changes one block,
so the number of blocks that differ (the sketches' Hamming distance, block by
block) is at most the symmetric difference, and of linked sets that is at most
a seventh of the sum of their sizes. By the pigeonhole principle linked
documents share so many of their tokens that they share LEAST of them, or more,
among the first ones of each in the order of hashes.

Documents that share too few tokens with any others drop out. The rest are
paired with the smallest document of each token, verified on their whole sets,
and joined to components; then tokens whose documents lie in different
components are looked at pair by pair, so that no link is lost.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import join_hot, mix64, shuffle_partitions, stored, text_bytes, text_chunks, words_of
from lorekeep.llm.components import components
from lorekeep.llm.decontaminate import LOWER
from lorekeep.llm.firstseen import Corpus, by_bucket, joined, of_doc, of_key, picked, unblock, unpack

N_WORDS = 5
#: Two sets are linked when SCALE * intersection >= LINK * union.
LINK, SCALE = 75, 100
#: Sets below TINY are a band of their own whose blocks are single shingles; above it a band spans a factor of STEP.
TINY, STEP = 16, 4
#: Tokens beyond the pigeonhole bound that are sent, as a share of the set: that many more must be shared.
SLACK = 0.2
#: Documents that are verified together with their leader, and documents of a token that are compared with one another.
GROUP, BLOCK = 256, 1024

WORD = np.ones(256, bool)
WORD[[32, 9, 10, 11, 12, 13]] = False
MULTIPLY = mix64(np.arange(1, N_WORDS + 1, dtype=np.uint64)) | np.uint64(1)

TOKEN = {"token": "u8", "doc": "i8", "band": "u1", "shared": "u1"}
SHARED = {"token": "u8", "doc": "i8", "band": "u1"}
SIZES = {"doc": "i8", "n": "i4"}
NEEDS = {"doc": "i8", "band": "u1", "need": "i4", "weak": "u1"}
HELD = {"token": "u8", "doc": "i8", "band": "u1", "need": "i4", "digest": "u8", "many": "u1"}
PAIR = {"doc": "i8", "b": "i8"}
STAR = {"token": "u8", "doc": "i8", "band": "u1", "need": "i4", "leader": "i8", "open": "u1"}
TOKENS = "bucket int, tokens binary, shared binary, needs binary, sizes binary"
FOUND = "bucket int, shared binary, needs binary, sizes binary"
FLAT = "doc long, leader long, token long, band int, need int"
#: Tokens that a task holds before it sends them on, and how many of its documents may have one before they are combined.
HELD_TOKENS, HOT = 300_000, 8


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text in data, in this order."""
    word, owner = words_of(data, offsets, WORD, LOWER)
    m = len(word)
    total = np.zeros(max(0, m - N_WORDS + 1), np.uint64)
    for k in range(N_WORDS):
        total += word[k : k + len(total)] * MULTIPLY[k]
    whole = np.flatnonzero(owner[: len(total)] == owner[N_WORDS - 1 :]) if len(total) else np.zeros(0, int)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    text, h = owner[whole], mix64(total[whole])
    first = np.cumsum(counts) - counts
    few = np.flatnonzero((counts > 0) & (counts < N_WORDS))
    if len(few):
        short = np.array([int((word[first[d] : first[d] + counts[d]] * MULTIPLY[: counts[d]]).sum()) % (1 << 64) for d in few.tolist()], np.uint64)
        text, h = np.concatenate([text, few]), np.concatenate([h, mix64(short ^ counts[few].astype(np.uint64))])
    small = text.astype(np.uint16) if len(offsets) < 1 << 16 else text
    order = np.lexsort((h, small))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[new], h[new]


def _band(n: np.ndarray) -> np.ndarray:
    """0 for sets below TINY, k for those from TINY * STEP ** (k - 1)."""
    edges = TINY * STEP ** np.arange(20, dtype=np.int64)
    return np.searchsorted(edges, n, side="right")


def _blocks(band: np.ndarray) -> np.ndarray:
    """Blocks of a band: as many as its largest set has shingles; more where sets are small, so that tokens stay above the bound."""
    return TINY * STEP ** band.astype(np.int64) * np.where(band == 1, 2, 1)


def sketch_tokens(text: np.ndarray, h: np.ndarray, sizes: np.ndarray, salt: int = 0) -> tuple[dict, dict]:
    """(first tokens of each text and band, how many of these a linked text must share).

    A text is in its own band, and in the one below where a linked text can be that much smaller; linked texts meet in
    the smaller one's band. salt: another way to deal shingles to blocks. weak: a set whose shingles met in so few
    blocks that the pigeonhole bound says nothing.
    """
    home = _band(sizes)
    lower = _band((sizes * LINK + SCALE - 1) // SCALE)
    also = np.flatnonzero((lower < home) & (sizes > 0))
    doc = np.concatenate([np.flatnonzero(sizes > 0), also])
    band = np.concatenate([home[sizes > 0], lower[also]])
    n = sizes[doc].astype(np.int64)
    first = (np.cumsum(sizes) - sizes)[doc]
    src = np.repeat(np.arange(len(doc)), n)
    code = h[np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    dealt = mix64(code ^ np.uint64(salt)) if salt else code
    block = (dealt >> np.uint64(13)) % _blocks(band)[src].astype(np.uint64)
    block = np.where(band[src] == 0, code, block)
    small = src.astype(np.uint16) if len(doc) < 1 << 16 else src
    order = np.lexsort((block, small))
    src, block, code = src[order], block[order], code[order]
    new = np.ones(len(src), bool)
    new[1:] = (src[1:] != src[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    parity = np.bitwise_xor.reduceat(code, at) if len(at) else code
    src = src[at]
    token = mix64(parity ^ mix64((block[at] << np.uint64(5)) ^ band[src].astype(np.uint64)))
    small = src.astype(np.uint16) if len(doc) < 1 << 16 else src
    order = np.lexsort((token, small))
    src, token = src[order], token[order]
    t = np.bincount(src, minlength=len(doc))
    differ = (n + n * SCALE // LINK) // (2 * SCALE // (SCALE - LINK) - 1)
    slack = lambda k: (k * SLACK).astype(np.int64)
    rank = np.arange(len(src)) - np.repeat(np.cumsum(t) - t, t)
    sent = rank < (differ + 1 + slack(n))[src]
    need = np.maximum(1, np.minimum(slack((n * LINK + SCALE - 1) // SCALE) + 1, t - differ))
    tokens = {"token": token[sent], "doc": doc[src[sent]], "band": band[src[sent]], "shared": np.zeros(int(sent.sum()), np.uint8)}
    return tokens, {"doc": doc, "band": band, "need": need, "weak": (t <= differ).astype(np.uint8)}


def _token_rows(corpus: Corpus, salt: int) -> DataFrame:
    """Tokens by their bucket, combined: of a token that several documents of a task have, one entry goes; the others are known to be shared."""
    n = corpus.n

    def flush(tokens, needs, sizes):
        tokens, needs, sizes = joined(tokens), joined(needs), joined(sizes)
        order = np.lexsort((tokens["doc"], tokens["token"]))
        tokens = {k: v[order] for k, v in tokens.items()}
        new = np.ones(len(order), bool)
        new[1:] = tokens["token"][1:] != tokens["token"][:-1]
        alone = new & np.append(new[1:], True)
        tokens["shared"] = (~alone).astype(np.uint8)
        go, rest = picked(tokens, new), picked(tokens, ~new)
        return by_bucket(
            TOKENS, (TOKEN, go, of_key(go["token"], n)), (SHARED, rest, of_doc(rest["doc"], n)), (NEEDS, needs, of_doc(needs["doc"], n)), (SIZES, sizes, of_doc(sizes["doc"], n))
        )

    def run(batches):
        held, count = ([], [], []), 0
        for b in batches:
            for part, data, offsets in text_chunks(b, "_text"):
                text, h = shingles(data, offsets)
                number = part.column("_doc").to_numpy()
                sizes = np.bincount(text, minlength=len(number))
                tokens, needs = sketch_tokens(text, h, sizes, salt)
                for x in (tokens, needs):
                    x["doc"] = number[x["doc"]]
                for x, to in zip((tokens, needs, {"doc": number, "n": sizes}), held):
                    to.append(x)
                count += len(tokens["token"]) + len(number)
                if count >= HELD_TOKENS:
                    yield flush(*held)
                    held, count = ([], [], []), 0
        if count:
            yield flush(*held)

    return corpus.docs.select("_doc", "_text").mapInArrow(run, TOKENS)


def _shared_tokens(rows: DataFrame, n: int) -> DataFrame:
    """By documents' buckets: the tokens that some other document has too."""

    def bucket(t: pa.Table) -> pa.Table:
        e = unpack(TOKEN, t.column("tokens").to_pylist())
        order = np.argsort(e["token"], kind="stable")
        e = {k: v[order] for k, v in e.items()}
        new = np.ones(len(order), bool)
        new[1:] = e["token"][1:] != e["token"][:-1]
        group = np.cumsum(new) - 1
        many = (np.bincount(group) > 1) | (np.bincount(group, weights=e["shared"]) > 0) if len(group) else np.zeros(0, bool)
        e = {k: e[k][many[group]] for k in SHARED}
        parts = []
        for fields, name in ((SHARED, "shared"), (NEEDS, "needs"), (SIZES, "sizes")):
            known = unpack(fields, t.column(name).to_pylist())
            known = joined([known, e]) if name == "shared" else known
            parts.append((fields, known, of_doc(known["doc"], n)))
        return pa.Table.from_batches([by_bucket(FOUND, *parts)])

    return rows.groupBy("bucket").applyInArrow(bucket, FOUND)


def parity(h: np.ndarray, band: int) -> bytes:
    """The parity sketch of a set: every shingle flips the bit that its hash names; two bits a block."""
    width = 2 * TINY * STEP**band
    return np.packbits((np.bincount(((h >> np.uint64(21)) % np.uint64(width)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def _candidates(corpus: Corpus, found: DataFrame, kind: str) -> DataFrame:
    """doc, doc_id, n for every document; also text and bands (need, sketch, shared tokens) for those that share as many tokens as a link takes."""
    listed = pa.list_(pa.struct([("band", pa.int32()), ("need", pa.int32()), ("digest", pa.binary()), ("sketch", pa.binary()), ("tokens", pa.binary())]))

    def both(docs: pa.Table, flags: pa.Table) -> pa.Table:
        shared = unpack(SHARED, flags.column("shared").to_pylist())
        needs, sizes = unpack(NEEDS, flags.column("needs").to_pylist()), unpack(SIZES, flags.column("sizes").to_pylist())
        need_of = dict(zip(zip(needs["doc"].tolist(), needs["band"].tolist()), needs["need"].tolist()))
        weak = set(needs["doc"][needs["weak"] == 1].tolist())
        shared, first, count = _by_set(shared)
        mine: dict = {}
        for d, b, at, size in zip(*(x.tolist() for x in (shared["doc"][first], shared["band"][first], first, count))):
            if size >= need_of[d, b]:
                mine.setdefault(d, []).append((b, need_of[d, b], shared["token"][at : at + size].tobytes()))
        t = unblock(docs)
        number = t.column("_doc").to_pylist()
        live = np.array([d in mine for d in number], bool)
        bands: list = [[] for _ in number]
        some = pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(live)), t.column("_text").combine_chunks().filter(pa.array(live))], ["at", "text"])
        for part, data, offsets in text_chunks(some, "text"):
            who, h = shingles(data, offsets)
            first = np.searchsorted(who, np.arange(part.num_rows + 1))
            for i, at in enumerate(part.column("at").to_pylist()):
                own = h[first[i] : first[i + 1]]
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                digest = hashlib.blake2b(b" ".join(raw.lower().split()), digest_size=8).digest()  # of the words: equal hashes are no equal texts
                bands[at] = [{"band": b, "need": q, "digest": digest, "sketch": parity(own, b), "tokens": x} for b, q, x in mine[number[at]]]
        n_of = dict(zip(sizes["doc"].tolist(), sizes["n"].tolist()))
        return pa.table(
            {
                "doc": t.column("_doc"), "doc_id": pc.struct_field(t.column("_row"), "doc_id"), "n": pa.array([n_of[d] for d in number], pa.int64()),
                "text": pc.if_else(pa.array(live), t.column("_text").cast(pa.string()), None), "bands": pa.array(bands, listed), "weak": pa.array([d in weak for d in number], pa.bool_()),
            }
        )

    return corpus.packed.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(both, f"doc long, doc_id {kind}, n long, text string, bands array<struct<band:int,need:int,digest:binary,sketch:binary,tokens:binary>>, weak boolean")


def _stars(live: DataFrame, n: int) -> DataFrame:
    """Rows of FLAT: each document with a leader for each of its tokens, and with its tokens that three documents or more have.

    Tokens go to their bucket and come back to their document's. Which of a token's documents leads depends on the token,
    so that the leaders of a group of alike documents are several. Of equal words only the smallest document takes part,
    and leads the others. Of a token that many of a task's documents have, the leader of these goes; the others are paired
    with it at once.
    """

    def run(batches):
        for b in batches:
            bands = b.column("bands").to_pylist()
            parts = [(d, x["band"], x["need"], np.frombuffer(x["tokens"], np.uint64), np.frombuffer(x["digest"], np.uint64)[0]) for d, own in zip(b.column("doc").to_pylist(), bands) for x in own]
            at = 0
            while at < len(parts):
                to, count = at, 0
                while to < len(parts) and count < HELD_TOKENS:
                    count += len(parts[to][3])
                    to += 1
                yield flush(parts[at:to])
                at = to

    def flush(parts):
        size = [len(x[3]) for x in parts]
        e = {"token": np.concatenate([x[3] for x in parts])}
        e |= {k: np.repeat(np.array([x[i] for x in parts], np.int64), size) for i, k in enumerate(("doc", "band", "need"))}
        e["digest"] = np.repeat(np.array([x[4] for x in parts], np.uint64), size)
        e, same = alike(e)
        first, count, lead = led(e)
        many = np.repeat(count >= HOT, count)
        many &= lead != e["doc"]
        rest = picked(e, many) | {"leader": lead[many], "open": np.ones(int(many.sum()), np.uint8)}
        rest = joined([{k: rest[k] for k in STAR}, same])
        e["many"] = np.repeat(count >= HOT, count).astype(np.uint8)  # the leader stands for more than itself
        go = picked(e, ~many)
        return by_bucket("bucket int, held binary, star binary", (HELD, go, of_key(go["token"], n)), (STAR, rest, of_doc(rest["doc"], n)))

    def alike(e):
        """Entries in the order of tokens without equal sets but for the smallest document of each; rows of STAR for the others."""
        e = picked(e, np.lexsort((e["doc"], e["digest"], e["token"])))
        new = np.ones(len(e["doc"]), bool)
        new[1:] = (e["token"][1:] != e["token"][:-1]) | (e["digest"][1:] != e["digest"][:-1])
        at = np.flatnonzero(new)
        lead = np.repeat(e["doc"][at], np.diff(np.append(at, len(new))))  # the smallest document with the set
        same = picked(e, ~new) | {"leader": lead[~new], "open": np.zeros(int((~new).sum()), np.uint8)}
        return picked(e, new), {k: same[k] for k in STAR}

    def led(e):
        first, count = _groups(e["token"])
        rule = mix64(e["doc"].astype(np.uint64) ^ (e["token"] & np.uint64(7)) << np.uint64(56))
        order = np.lexsort((rule, e["token"]))
        return first, count, np.repeat(e["doc"][order][first], count)

    def meet(t: pa.Table) -> pa.Table:
        e = unpack(HELD, t.column("held").to_pylist())
        hot = np.unique(e["token"][e["many"] == 1])
        e, same = alike(e)
        first, count, lead = led(e)
        e |= {"leader": lead, "open": (np.repeat(count >= 3, count) | np.isin(e["token"], hot)).astype(np.uint8)}
        e = joined([unpack(STAR, t.column("star").to_pylist()), same, picked({k: e[k] for k in STAR}, np.repeat(count >= 2, count))])
        return pa.Table.from_batches([by_bucket("bucket int, star binary", (STAR, e, of_doc(e["doc"], n)))])

    def settle(t: pa.Table) -> pa.Table:
        e = unpack(STAR, t.column("star").to_pylist())
        pairs = np.unique(np.column_stack([e["doc"], e["leader"]])[e["doc"] != e["leader"]], axis=0)
        own = picked(e, e["open"] == 1)
        own, _, count = _by_set(own)
        own = picked(own, np.repeat(count, count) >= own["need"])
        m, k = len(pairs), len(own["doc"])
        none = lambda size: pa.nulls(size, pa.int64())
        int_ = lambda x: pa.array(x.astype(np.int32))
        a = pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none(m), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32())], ["doc", "leader", "token", "band", "need"])
        b = pa.table([pa.array(own["doc"]), none(k), pa.array(own["token"].view(np.int64)), int_(own["band"]), int_(own["need"])], ["doc", "leader", "token", "band", "need"])
        return pa.concat_tables([a, b])

    rows = live.select("doc", "bands").mapInArrow(run, "bucket int, held binary, star binary")
    rows = rows.groupBy("bucket").applyInArrow(meet, "bucket int, star binary")
    return rows.groupBy("bucket").applyInArrow(settle, FLAT)


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, size) of the runs of equal values in a sorted array."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _by_set(e: dict) -> tuple[dict, np.ndarray, np.ndarray]:
    """(entries in the order of document and band, first place and size of each such set); a document's number may be any."""
    e = picked(e, np.lexsort((e["band"], e["doc"])))
    new = np.ones(len(e["doc"]), bool)
    new[1:] = (e["doc"][1:] != e["doc"][:-1]) | (e["band"][1:] != e["band"][:-1])
    first = np.flatnonzero(new)
    return e, first, np.diff(np.append(first, len(new)))


def near_enough(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """The pairs (a, b) whose parity sketches differ in no more bits than the sets of a link may differ in shingles."""
    bands = live.select("doc", "n", F.transform("bands", lambda x: F.struct(x["band"].alias("band"), x["sketch"].alias("sketch"))).alias("s"))
    side = lambda k: bands.select(F.col("doc").alias(k), F.col("n").alias(f"n{k}"), F.col("s").alias(f"s{k}"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(f"{SCALE} * least(na, nb) >= {LINK} * greatest(na, nb)")

    def run(batches):
        for t in batches:
            keep = []
            for na, nb, x, y in zip(*(t.column(k).to_pylist() for k in ("na", "nb", "sa", "sb"))):
                x, y = {s["band"]: s["sketch"] for s in x}, {s["band"]: s["sketch"] for s in y}
                band = max(x.keys() & y.keys(), default=None)
                most = (SCALE - LINK) * (na + nb) // (SCALE + LINK)
                keep.append(band is not None and (int.from_bytes(x[band]) ^ int.from_bytes(y[band])).bit_count() <= most)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _across(open_: DataFrame, live: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of documents that share a token, lie in different components, and are near enough by size and sketch.

    Pairs are compared inside tasks, and only those that pass leave them. A token of more than BLOCK documents is dealt
    out as pairs of blocks, so that a task sees two blocks at most.
    """
    spark = open_.sparkSession
    band = live.select("doc", "n", F.explode("bands").alias("s")).select("doc", "n", "s.band", "s.sketch")
    blocks = F.ceil(F.col("_k") / BLOCK).cast("int")
    rows = open_.join(band, ["doc", "band"]).withColumn("own", F.pmod(F.xxhash64("doc"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    buckets = shuffle_partitions(spark) * 8
    rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc", "component", "n", "sketch")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("token", "i", "j"), F.lit(buckets)).cast("int"))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([("token", "ascending"), ("i", "ascending"), ("j", "ascending")]).combine_chunks()
        token, i, j, doc, comp, size = (t.column(k).to_numpy() for k in ("token", "i", "j", "doc", "component", "n"))
        sketch, found = t.column("sketch").to_pylist(), []
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        first = np.flatnonzero(new)
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(token)]):
            bits = np.frombuffer(b"".join(sketch[lo:hi]), np.uint8).reshape(hi - lo, -1).view(np.uint32)
            step = max(1, (4 << 20) // bits.nbytes)
            for at in range(lo, hi, step):
                x = np.arange(at, min(hi, at + step))[:, None]
                y = np.arange(lo, hi)[None]
                r, c = np.nonzero((doc[x] < doc[y]) & (comp[x] != comp[y]) & (SCALE * size[x] >= LINK * size[y]) & (SCALE * size[y] >= LINK * size[x]))
                r = r + at - lo
                differ = np.bitwise_count(bits[r] ^ bits[c]).sum(axis=1)
                fit = differ <= (SCALE - LINK) * (size[lo + r] + size[lo + c]) // (SCALE + LINK)
                found.append(np.column_stack([doc[lo + r[fit]], doc[lo + c[fit]]]))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.Table.from_batches([by_bucket("bucket int, pairs binary", (PAIR, {"doc": pairs[:, 0], "b": pairs[:, 1]}, of_doc(pairs[:, 0], buckets)))])

    def once(t: pa.Table) -> pa.Table:
        e = unpack(PAIR, t.column("pairs").to_pylist())
        pairs = np.unique(np.column_stack([e["doc"], e["b"]]), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("bucket").applyInArrow(compare, "bucket int, pairs binary").groupBy("bucket").applyInArrow(once, "a long, b long")


def linked(a: bytes, b: bytes, part_bytes: int = 4 << 20) -> bool:
    """Whether the shingle sets of two texts are linked, word by word; of long texts a part of all shingles at a time."""
    if a == b:
        return bool(a.split())
    words = [x.lower().split() for x in (a, b)]  # bytes: A-Z and ASCII white space alone
    if not words[0] or not words[1]:
        return False
    parts, both, sizes = 1 + (len(a) + len(b)) // part_bytes, 0, 0
    for k in range(parts):
        own = []
        for w in words:
            every = zip(*[w[i:] for i in range(N_WORDS)]) if len(w) >= N_WORDS else iter([tuple(w)])
            own.append(set(every) if parts == 1 else {s for s in every if hash(s) % parts == k})
        both, sizes = both + len(own[0] & own[1]), sizes + len(own[0]) + len(own[1])
    return SCALE * both >= LINK * (sizes - both)


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets are linked; docs has doc and text.

    Hashes of shingles leave few pairs, which are then confirmed on their words. A document a with many partners is verified
    in several groups, each of which gets its text.
    """
    sized = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts")), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    asks = sized.select("a", "part", F.col("b").alias("doc")).unionByName(sized.select("a", "part", F.col("a").alias("doc")).distinct())
    rows = asks.join(docs.select("doc", "text"), "doc")

    def group(t: pa.Table) -> pa.Table:
        a, links = t.column("a")[0].as_py(), []
        doc, text = t.column("doc").to_numpy(), t.column("text").combine_chunks()
        leader = int(np.flatnonzero(doc == a)[0])
        raw, _ = text_bytes(text.slice(leader, 1))
        _, own = shingles(*text_bytes(text.slice(leader, 1)))
        raw = raw.tobytes()
        members = pa.RecordBatch.from_arrays([t.column("doc").combine_chunks(), text], ["doc", "text"])
        for part, data, offsets in text_chunks(members, "text"):
            who, h = shingles(data, offsets)
            sizes = np.bincount(who, minlength=part.num_rows)
            both = np.bincount(who, weights=np.isin(h, own), minlength=part.num_rows).astype(np.int64)
            fit = SCALE * both >= LINK * (sizes + len(own) - both)
            number = part.column("doc").to_numpy()
            links += [int(number[i]) for i in np.flatnonzero(fit & (number != a) & (sizes > 0)) if linked(raw, data[offsets[i] : offsets[i + 1]].tobytes())]
        return pa.table({"a": pa.array([a] * len(links), pa.int64()), "b": pa.array(links, pa.int64())})

    return rows.groupBy("a", "part").applyInArrow(group, "a long, b long")


def near_duplicates(docs: DataFrame, keep: list[str] | None = None) -> tuple[Corpus, DataFrame]:
    """(corpus, rows): doc, doc_id, n, component (a doc, the smallest that links reach) for every row of docs."""
    corpus = Corpus(docs, keep or ["doc_id"])
    for salt in itertools.count():
        found = _shared_tokens(_token_rows(corpus, salt), corpus.n)
        info = stored(_candidates(corpus, found, docs.schema["doc_id"].dataType.simpleString()))
        if not info.where("weak").limit(1).count():
            break  # otherwise deal the shingles anew, until every set keeps enough tokens for the bound to hold
    live = info.where(F.size("bands") > 0)
    flat = stored(_stars(live, corpus.n))
    texts = live.select("doc", "text")
    star = flat.where("leader is not null").select(F.least("leader", "doc").alias("a"), F.greatest("leader", "doc").alias("b")).distinct()
    links = stored(verify(stored(near_enough(star, live)), texts))
    labels = components(links)

    # tokens whose documents are in different components; a document needs enough of them to have a link there
    held = flat.where("token is not null").drop("leader")
    open_ = held.join(labels, held["doc"] == labels["node"], "left").select("doc", "band", "need", "token", F.coalesce("component", "doc").alias("component"))
    open_ = stored(open_)
    for _ in range(2):
        mixed = open_.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
        open_ = stored(join_hot(open_, mixed, "token"))
        enough = open_.groupBy("doc", "band").agg(F.count("*").alias("_n"), F.max("need").alias("_need")).where("_n >= _need").select("doc", "band")
        open_ = stored(open_.join(enough, ["doc", "band"]))
    # a pair shares need of its open tokens, so one that is left when each gives up its need - 1 commonest ones
    open_ = join_hot(open_, open_.groupBy("token").agg(F.count("*").alias("_k")), "token")
    own = Window.partitionBy("doc", "band")
    open_ = open_.withColumns({"_rank": F.row_number().over(own.orderBy("_k", "token")), "_last": F.count("*").over(own) - F.col("need") + 1}).where("_rank <= _last")
    across = _across(open_.select("doc", "band", "token", "component", "_k"), live)
    across = stored(across.join(star, ["a", "b"], "left_anti"))
    if across.limit(1).count():
        labels = components(stored(links.unionByName(verify(across, texts))))
    rows = info.select("doc", "doc_id", "n").join(labels, info["doc"] == labels["node"], "left")
    return corpus, rows.select("doc", "doc_id", "n", F.coalesce("component", "doc").alias("component"))


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs.

    A null, empty or blank text has no shingles and no links. Rows with the same doc_id are documents of their own; a
    null doc_id counts as the largest. Extra columns are not looked at.
    """
    _, rows = near_duplicates(docs)
    rows = stored(rows)
    names = rows.select(F.col("doc").alias("component"), F.col("doc_id").alias("component_id"))
    return join_hot(rows, names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are the smallest of their component."""
    corpus, rows = near_duplicates(docs, docs.columns)
    n, names = corpus.n, docs.columns
    gone = rows.where("component <> doc").select("doc")

    def block(batches):
        for b in batches:
            doc = b.column("doc").to_numpy()
            yield by_bucket("bucket int, docs binary", ({"doc": "i8"}, {"doc": doc}, of_doc(doc, n)))

    def both(blocks: pa.Table, drop: pa.Table) -> pa.Table:
        out_of = set(unpack({"doc": "i8"}, drop.column("docs").to_pylist())["doc"].tolist())
        t = unblock(blocks)
        t = t.filter(pa.array([d not in out_of for d in t.column("_doc").to_pylist()]))
        return pa.table([t.column("_text") if k == "text" else pc.struct_field(t.column("_row"), k) for k in names], names)

    flags = gone.mapInArrow(block, "bucket int, docs binary")
    return corpus.packed.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(both, docs.schema)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS g(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id
"""
