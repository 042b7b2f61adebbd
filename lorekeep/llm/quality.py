"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. The chain sees features of the line and of its two
neighbours, and how labels follow one another. Forward-backward gives each
line's probability of being good; their mean, weighted by line length, is the
document's quality, which a logistic curve turns into the chance of label 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import crc_mod, short_batches, text_chunks, word_hashes

#: Labelled documents of each label to learn from, about and at most, drawn by a hash of their id; they are read whole.
TRAIN_DOCS = 800
#: Lines of these documents to learn from at most, and lines that one of them may have.
TRAIN_LINES, MAX_LINES = 200_000, 5_000
ROUNDS = 80
RIDGE = 1e-4
THRESHOLD = 0.3

#: Texts of more lines are scored slice by slice, of SLICE bytes or one line each; short texts are scored together up to BATCH_LINES.
LONG_LINES, SLICE, BATCH_LINES = 20_000, 1 << 17, 50_000

#: Features of a line itself; those of its neighbours follow.
OWN = 13

#: Byte classes: 0 other ASCII, 1 lower case, 2 upper case, 3 digit, 4 blank, 5 sentence mark, 6 not ASCII.
CLASS = np.zeros(256, np.uint8)
CLASS[ord("a") : ord("z") + 1], CLASS[ord("A") : ord("Z") + 1], CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
CLASS[[32, 9, 10, 11, 12, 13]] = 4
CLASS[[ord(x) for x in ".,;:?'\"-"]] = 5
CLASS[128:] = 6


def own_features(data: np.ndarray, offsets: np.ndarray, said: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts in data: (each line's own features, its weight, number of lines of each text, the last two words). An empty text is one empty line.

    Words are compared with the two before them in their text; said holds those before the first one, where data is a slice.
    """
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    # a line starts where a text starts and after each break
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, owner))
    starts = starts[order]
    owner_end = np.concatenate([np.searchsorted(offsets, breaks, side="right") - 1, np.arange(len(offsets) - 1)])
    ends = ends[np.lexsort((ends, owner_end))]
    counts = np.bincount(owner, minlength=len(offsets) - 1)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int32)
        np.cumsum(mask, out=sums[1:], dtype=np.int32)
        return (sums[ends] - sums[starts]).astype(float)

    kind = CLASS[data]
    size = (ends - starts).astype(float)
    share = [total(kind == k) / np.maximum(size, 1) for k in range(7)]
    same = np.zeros(n, bool)
    same[1:] = data[1:] == data[:-1]
    doubled = total(same & ((kind == 0) | (kind == 5))) / np.maximum(size, 1)

    # words: how many, and how many repeat one of the two before
    blank = kind == 4
    edge = np.ones(n + 1, bool)
    edge[1:] = np.append(blank[1:], True) if n else True
    head = ~blank
    head[1:] &= blank[:-1]
    head[offsets[:-1][(offsets[:-1] < n)]] |= ~blank[offsets[:-1][(offsets[:-1] < n)]]
    w_start = np.flatnonzero(head)
    tail = ~blank
    tail[:-1] &= blank[1:] | head[1:]
    w_end = np.flatnonzero(tail) + 1
    word = word_hashes(data, w_start, w_end)
    known = np.zeros(0, word.dtype) if said is None else said
    word = np.concatenate([known, word])
    text_of = np.concatenate([np.zeros(len(known), np.int64), np.searchsorted(offsets, w_start, side="right") - 1])
    again = np.zeros(len(word), bool)
    for back in (1, 2):
        again[back:] |= (word[back:] == word[:-back]) & (text_of[back:] == text_of[:-back])
    again = again[len(known) :]
    repeat = np.zeros(n, bool)
    repeat[w_start[again]] = True
    words = total(head)
    repeated = total(repeat) / np.maximum(words, 1)
    long_words = np.minimum(size / np.maximum(words, 1), 30) / 30
    single = total(head & np.append(tail[:n], False)[:n]) / np.maximum(words, 1)
    own = np.column_stack([*share, doubled, repeated, long_words, single, np.log1p(size) / 8, size == 0])

    return own, size + 1, counts, word[-2:].copy()


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts in data: (features of each line and its neighbours, its weight, number of lines of each text)."""
    own, weight, counts, _ = own_features(data, offsets)
    first = np.cumsum(counts) - counts
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[first + counts - 1] = 0
    lonely = np.zeros((len(own), 2))
    lonely[first, 0] = 1
    lonely[first + counts - 1, 1] = 1
    return np.column_stack([own, before, after, lonely, np.ones(len(own))]), weight, counts


def line_slices(data: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of whole lines of a text that has lines, each of SLICE bytes at most or one line."""
    out, start, n = [], 0, len(data)
    while start <= n:
        end = min(start + SLICE, n)
        if end < n:
            breaks = np.flatnonzero(data[start:end] == 10)
            while not len(breaks) and end < n:  # a line longer than a slice
                more = np.flatnonzero(data[end : end + SLICE] == 10)
                breaks = more + (end - start)
                end = min(end + SLICE, n)
            if len(breaks):
                end = start + int(breaks[-1] if end - start <= SLICE else breaks[0])
            else:
                end = n
        out.append((start, end))
        start = end + 1
    return out


def _ascend(slope_at, theta: np.ndarray) -> np.ndarray:
    """theta after ROUNDS steps of Adam up a slope, with a ridge."""
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        grad = slope_at(theta) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta


class LineChain:
    """The field: weights of the features for "good" against "bad", and a score for each pair of neighbouring labels."""

    def __init__(self, n_features: int):
        self.w, self.t, self.curve = np.zeros(n_features), np.zeros((2, 2)), np.array([0.0, 1.0])

    def marginals(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected number of each pair of neighbouring labels, by forward-backward over all texts at once."""
        emit = np.column_stack([np.zeros(len(x)), x @ self.w])
        first = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        first, length = first[order], counts[order]
        alpha, beta, pairs = np.empty_like(emit), np.zeros_like(emit), np.zeros((2, 2))
        steps = int(length[0]) if len(length) else 0
        alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps + 1)]  # texts with more than t lines
        alpha[first] = emit[first]
        for t in range(1, steps):
            at = first[: alive[t]] + t
            alpha[at] = np.logaddexp(alpha[at - 1, :1] + self.t[0], alpha[at - 1, 1:] + self.t[1]) + emit[at]
        for t in range(steps - 1, 0, -1):
            at = first[: alive[t]] + t
            ahead = beta[at] + emit[at]
            beta[at - 1] = np.logaddexp(ahead[:, :1] + self.t[:, 0], ahead[:, 1:] + self.t[:, 1])
        both = alpha + beta
        total = np.logaddexp(both[:, 0], both[:, 1])
        later = np.ones(len(x), bool)
        later[first] = False
        at = np.flatnonzero(later)
        if len(at):
            joint = alpha[at - 1][:, :, None] + self.t[None] + (beta[at] + emit[at])[:, None, :] - total[at][:, None, None]
            pairs = np.exp(joint).sum(axis=0)
        return np.exp(both[:, 1] - total), pairs

    def fit(self, x: np.ndarray, weight: np.ndarray, counts: np.ndarray, label: np.ndarray) -> LineChain:
        """Learns from texts of label 0 or 1: lines' labels, then the field by maximum likelihood, then the curve.

        A text of label 1 has good lines only. Of a text of label 0 those are bad that lines alone, without neighbours
        and order, tell from good ones, and in any case the worst.
        """
        of_text, n, first = np.repeat(label, counts).astype(float), max(1, len(x)), np.cumsum(counts) - counts
        own = np.append(np.arange(OWN), x.shape[1] - 1)
        alone = _ascend(lambda w: x[:, own].T @ (of_text - 1 / (1 + np.exp(-(x[:, own] @ w)))) / n, np.zeros(len(own)))
        chance = x[:, own] @ alone
        worst = np.repeat(np.minimum.reduceat(chance, first), counts)
        y = np.where(of_text == 1, 1.0, ((chance > 0) & (chance > worst)).astype(float))
        later = np.ones(len(x), bool)
        later[first] = False
        at, inside = np.flatnonzero(later), np.zeros((2, 2))
        np.add.at(inside, (y[at - 1].astype(int), y[at].astype(int)), 1)

        def slope_at(theta: np.ndarray) -> np.ndarray:
            self.w, self.t = theta[:-4], theta[-4:].reshape(2, 2)
            p, pairs = self.marginals(x, counts)
            return np.concatenate([x.T @ (y - p), (inside - pairs).ravel()]) / n

        theta = np.concatenate([np.zeros(len(self.w)), np.zeros(4)])
        theta[own] = alone
        theta = _ascend(slope_at, theta)
        self.w, self.t = theta[:-4], theta[-4:].reshape(2, 2)
        q = self.quality(x, weight, counts)
        bias, slope = 0.0, 0.0
        share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
        for _ in range(50):  # Newton steps of a logistic regression in which both labels weigh the same
            p = 1 / (1 + np.exp(-(bias + slope * q)))
            g = np.array([(share * (label - p)).sum(), (share * (label - p) * q).sum() - 1e-5 * slope])
            d = share * p * (1 - p)
            h = np.array([[d.sum() + 1e-7, (d * q).sum()], [(d * q).sum(), (d * q * q).sum() + 1e-5]])
            bias, slope = np.array([bias, slope]) + np.linalg.solve(h, g)
        self.curve = np.array([bias, slope])
        return self

    def quality(self, x: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
        p, _ = self.marginals(x, counts)
        first = np.cumsum(counts) - counts
        return np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int32)]) if len(data) else np.zeros(1, np.int32)
        lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
        q, start, held = np.empty(len(lines)), 0, 0
        for i, n in enumerate([*lines.tolist(), 0]):
            if i > start and (i == len(lines) or n > LONG_LINES or held + n > BATCH_LINES):
                q[start:i] = self.quality(*line_features(data[offsets[start] : offsets[i]], offsets[start : i + 1] - offsets[start]))
                start, held = i, 0
            if n > LONG_LINES:
                q[i] = self.long_quality(data[offsets[i] : offsets[i + 1]])
                start = i + 1
            else:
                held += n
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * q)))

    def long_quality(self, data: np.ndarray) -> float:
        """quality of one text of many lines, by slices: forward with what enters each slice kept, then backward from the end.

        Of a slice only its entering chances, the two words before it and its neighbours' features are kept, so memory does not
        grow with the number of lines but by a few numbers a slice; features are computed twice.
        """
        cuts, said = line_slices(data), np.zeros(0, np.uint64)
        edges, words = [], []
        for a, b in cuts:  # the features of the first and last line of each slice
            words.append(said)
            own, _, _, said = own_features(data[a:b], np.array([0, b - a]), said)
            edges.append((own[0].copy(), own[-1].copy()))

        def emissions(k: int) -> tuple[np.ndarray, np.ndarray]:
            a, b = cuts[k]
            own, weight, _, _ = own_features(data[a:b], np.array([0, b - a]), words[k])
            nothing = np.zeros((1, OWN))
            before = np.concatenate([edges[k - 1][1][None] if k else nothing, own[:-1]])
            after = np.concatenate([own[1:], edges[k + 1][0][None] if k + 1 < len(cuts) else nothing])
            good = own @ self.w[:OWN] + before @ self.w[OWN : 2 * OWN] + after @ self.w[2 * OWN : 3 * OWN] + self.w[-1]
            good[0] += self.w[3 * OWN] * (k == 0)
            good[-1] += self.w[3 * OWN + 1] * (k + 1 == len(cuts))
            return np.column_stack([np.zeros(len(own)), good]), weight

        entering, state = [], None
        for k in range(len(cuts)):
            entering.append(state)
            state = _carried(emissions(k)[0], self.t, state)[-1]
        good, whole, state = 0.0, 0.0, None
        for k in range(len(cuts) - 1, -1, -1):
            emit, weight = emissions(k)
            forward = _carried(emit, self.t, entering[k])
            # backward, each line's own emission included, is the same walk from the end with the scores turned round
            backward = _carried(emit[::-1], self.t.T, state)[::-1]
            both = forward + backward - emit
            p = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
            good, whole, state = good + float(p @ weight), whole + float(weight.sum()), backward[0]
        return good / whole


def _carried(emit: np.ndarray, t: np.ndarray, entering: np.ndarray | None) -> np.ndarray:
    """Forward log sums of a chain's lines after entering (none at its start), each shifted so that its greater is 0.

    Lines stand in rows of equal length. All rows are walked at once: first the matrices that each row amounts to, then
    what enters each row, one row after another, then the lines.
    """
    n = len(emit)
    m = max(1, int(n**0.5))
    rows = -(-n // m)
    e = np.concatenate([emit, np.zeros((rows * m - n, 2))]).reshape(rows, m, 2)

    def step(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = np.logaddexp(x[..., :1] + t[0], x[..., 1:] + t[1]) + at
        return x

    start = np.broadcast_to(np.array([[0.0, -np.inf], [-np.inf, 0.0]]), (rows, 2, 2)).copy()
    for j in range(m):
        start = step(start, e[:, None, j])
        start -= start.max(axis=(1, 2), keepdims=True)
    enters = np.empty((rows, 2))
    state = entering
    for r in range(rows):
        if state is None:  # the first line has no line before it
            x = e[r, 0]
            for j in range(1, m):
                x = step(x, e[r, j])
            enters[r] = 0.0
        else:
            enters[r] = state
            x = np.logaddexp(state[0] + start[r, 0], state[1] + start[r, 1])
        state = x - x.max()
    out = np.empty((rows, m, 2))
    x = step(enters, e[:, 0])
    if entering is None:
        x[0] = e[0, 0]
    for j in range(m):
        x = step(x, e[:, j]) if j else x
        x = x - x.max(axis=1, keepdims=True)
        out[:, j] = x
    return out.reshape(-1, 2)[:n]


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS) -> LineChain:
    """A chain learned from the documents in labels (doc_id, quality), at most about per_label of each quality.

    Labels are counted over all rows; nulls are left out, and of several labels of a document the highest counts. The sample
    is a share of the documents of each label by a hash, with at most TRAIN_LINES lines; documents of more than MAX_LINES lines
    are not learned from, repeated rows are learned from once. Without labels of both kinds the chain gives every text the
    share of label 1 (0.5 without labels).
    """
    short_batches(docs.sparkSession)
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).select("doc_id", (F.col("quality") == 1).cast("int").alias("quality"))
    n = {q: c for q, c in labels.groupBy("quality").count().collect()}
    share = F.lit(0.0)
    for q in n:
        share = F.when(F.col("quality") == q, min(1.0, per_label / n[q])).otherwise(share)
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    lines = F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumns({"_hash": F.xxhash64("doc_id", "text"), "_lines": lines}).where(F.col("_lines") <= MAX_LINES)
    drawn, total, most = sample.groupBy("_hash").agg(F.max("_lines")).orderBy("_hash").limit(4 * per_label).collect(), 0, None
    for h, k in drawn:
        total += k
        if total > TRAIN_LINES:
            break
        most = h
    sample = sample.where(F.col("_hash") <= most if most is not None else F.lit(False)).dropDuplicates(["doc_id", "text"]).select("doc_id", "text", "quality")

    def features(batches):
        for b in batches:
            for part, data, offsets in text_chunks(b, "text"):
                x, weight, counts = line_features(data, offsets)
                at = np.cumsum(counts) - counts
                x, weight = np.split(x, at[1:]), np.split(weight, at[1:])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("quality").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in weight], pa.binary())],
                    ["doc_id", "quality", "x", "weight"],
                )

    rows = sample.mapInArrow(features, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, quality int, x binary, weight binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    width = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    chain = LineChain(width)
    label = np.array([int(r["quality"] == 1) for r in rows])
    if len(set(label.tolist())) < 2:
        p = float(np.clip(label.mean(), 0.01, 0.99)) if len(label) else 0.5
        chain.curve = np.array([np.log(p / (1 - p)), 0.0])
        return chain
    weight = [np.frombuffer(r["weight"]) for r in rows]
    return chain.fit(np.concatenate([np.frombuffer(r["x"]).reshape(-1, width) for r in rows]), np.concatenate(weight), np.array([len(w) for w in weight]), label)


def score_quality(docs: DataFrame, chain: LineChain, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """keep, score and predicted for every row of docs, from its whole text; a null text scores as an empty one."""
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches):
        for b in batches:
            for part, data, offsets in text_chunks(b, "_text"):
                score = chain.score(data, offsets)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{fields}, score double, predicted int")


def keep_good(docs: DataFrame, chain: LineChain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns, whatever their names.

    A null text is judged like an empty one, repeated rows stay or go together, and an empty table stays empty.
    """

    def run(batches):
        for b in batches:
            for part, data, offsets in text_chunks(b, text):
                yield part.filter(pa.array(chain.score(data, offsets) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _learnable(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod("doc_id", 5) != 0).select("doc_id", "quality")


def op4(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted. Learns from labels whose crc32(doc_id) mod 5 is not 0; a null doc_id is not held out."""
    chain = train(docs, _learnable(labels))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return score_quality(docs, chain).select("doc_id", held.alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """keep_good with a chain learned from docs and the labels that op4 may learn from; nulls, repeats and empty tables as there."""
    return keep_good(docs, train(docs, _learnable(labels)))
