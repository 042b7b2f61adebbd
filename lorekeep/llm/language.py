"""Language identification: words first, then ever shorter character n-grams.

The model holds, for each language, the log frequency of its words and of the
character n-grams of its words. A known word scores its own log frequencies.
An unseen one falls back to its n-grams of the greatest length of which any is
known. What a language never had is one figure a length, so only what it had is
stored. A model of few entries is broadcast and a task scores each distinct word
once; a larger one stays a table, which the distinct words are joined with.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import Shared, crc_mod, join_hot, short_batches, stored

#: Documents of a language that the model learns from, about and at most, drawn by a hash of their id and text.
TRAIN_DOCS = 3000
#: The model's vocabulary: each language's commonest words and n-grams, however many languages there are.
MODEL_WORDS, MODEL_GRAMS = 25_000, 37_500
#: Entries (a word or n-gram of a language) up to which the model is broadcast; beyond, it stays a table.
MODEL_ENTRIES = 500_000
NGRAMS = (5, 4, 3, 2, 1)
#: Words remembered by a task from one batch to the next, and figures of theirs; cells that are filled at a time; characters of a
#: text that are looked at together.
MEMO, FIGURES, CELLS, PIECE = 400_000, 1 << 22, 1 << 21, 1 << 18
RUN = re.compile(r"[^\W\d_]+")
END = re.compile(r"[\W\d_]")


def words_of(text: str | None):
    """The words of a text, lower case, in lists: longest runs of letters (the Unicode categories L), for learning and predicting alike."""
    at, n = 0, len(text or "")
    while at < n:
        to = at + PIECE
        if to < n:
            gap = END.search(text, to)
            to = gap.start() if gap else n
        found = RUN.findall(text[at:to].lower())
        if not all(map(str.isalpha, found)):  # runs may hold numerals such as fractions, which are no letters
            found = ["".join(g) for w in found for letter, g in groupby(w, str.isalpha) if letter]
        yield found
        at = to


def base_of(sums: np.ndarray, entries: int) -> np.ndarray:
    """Log frequency, by length and language, of what a language never had."""
    return np.log(0.1 / (sums + 0.1 * max(1, entries)))


def answers(languages: list[str], base: np.ndarray, sums: np.ndarray, levels: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of texts, by what their words add for each language and how many words they have of each length."""
    langs, scores = ["und"] * len(sums), [0.0] * len(sums)
    seen = levels.sum(axis=1)
    some = np.flatnonzero(seen) if languages else np.zeros(0, int)
    if len(some):
        total, seen = sums[some] + levels[some] @ base, seen[some]
        # the mean over words, not the sum, so that the posterior of a long text still tells sure from unsure
        e = np.exp((total - total.max(axis=1, keepdims=True)) * (np.minimum(seen, 8) / seen)[:, None])
        best = total.argmax(axis=1)
        for i, k, x in zip(some.tolist(), best.tolist(), (e[np.arange(len(e)), best] / e.sum(axis=1)).tolist()):
            langs[i], scores[i] = languages[k], x
    return langs, scores


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of size each, one span after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class BackoffModel:
    """languages; base, see base_of; and for each known word or n-gram the languages that had it and by how much that raises it."""

    def __init__(self, counts: list[tuple[str, int, str, int]], languages: list[str] | None = None):
        """counts: (language, length, gram, count); length 0 stands for whole words."""
        self.languages = sorted({x[0] for x in counts} | set(languages or []))
        place = {x: i for i, x in enumerate(self.languages)}
        self.tables: list[dict] = [{} for _ in range(max(NGRAMS) + 1)]
        entries: Counter = Counter()
        sums = np.zeros((max(NGRAMS) + 1, len(place)))
        rows = 0
        for lang, n, gram, count in counts:
            at = self.tables[n].setdefault(gram, rows)
            rows += at == rows
            entries[at, place[lang]] += count
            sums[n, place[lang]] += count
        self.base = base_of(sums, rows)
        cells = np.array(sorted(entries), np.int64).reshape(-1, 2)
        self.lang = cells[:, 1].astype(np.int32)
        self.delta = np.log((np.array([entries[at, lang] for at, lang in cells.tolist()], float) + 0.1) / 0.1)
        self.size = np.bincount(cells[:, 0], minlength=rows)
        self.start = np.cumsum(self.size) - self.size

    def known(self, w: str) -> tuple[list[int], int]:
        """(rows, length) for a word: its own row and 0, else those of its n-grams of the greatest length of which any is known; -1 if none."""
        own = self.tables[0].get(w)
        if own is not None:
            return [own], 0
        framed, size = f"^{w}$", len(w) + 2
        for n in NGRAMS:
            get = self.tables[n].get
            found = [v for i in range(size - n + 1) if (v := get(framed[i : i + n])) is not None]
            if found:
                return found, n
        return [], -1

    def predict(self, texts: Iterable[str | None], memo: Memo | dict | None = None) -> tuple[list[str], list[float]]:
        """The language and score of each text; texts may come one by one, only one is held."""
        memo = memo if isinstance(memo, Memo) else Memo(self)
        width = max(1, len(self.languages))
        sums, levels = [], []
        ids: list[int] = []
        ends = [0]

        def add():
            """What the words collected so far add, to the sums of their texts, of which the first may have begun before."""
            memo.settle()
            doc, at = np.repeat(np.arange(len(ends)), np.diff([*ends, len(ids)])), np.array(ids, np.int64)
            level = memo.level[at]
            some = level >= 0
            levels_ = np.bincount(doc[some] * len(self.base) + level[some], minlength=len(ends) * len(self.base)).reshape(len(ends), -1)
            size = memo.size[at]
            flat = spans(memo.start[at], size)
            sums_ = np.bincount(np.repeat(doc, size) * width + memo.lang[flat], memo.delta[flat], len(ends) * width).reshape(len(ends), -1)
            for i, (x, y) in enumerate(zip(sums_, levels_)):
                if i == 0 and sums:
                    sums[-1] += x
                    levels[-1] += y
                else:
                    sums.append(x)
                    levels.append(y)
            ids.clear()
            ends[:] = [0]
            memo.tidy()

        most = max(1024, min(1 << 18, CELLS // width))
        n = 0
        for n, text in enumerate(texts, 1):
            for found in words_of(text):
                for i in range(0, len(found), most):
                    ids += map(memo.__getitem__, found[i : i + most])
                    if len(ids) >= most:
                        add()
            ends.append(len(ids))
        add()
        return answers(self.languages, self.base, np.array(sums[:n]).reshape(n, -1), np.array(levels[:n]).reshape(n, -1))


class Memo(dict):
    """Words met so far -> their place; level is the length at which a word is known (-1: at none), and start and size its span
    of (lang, delta). A new word gets its place at once; new words are looked up together by settle."""

    def __init__(self, model: BackoffModel):
        self.model = model
        self._forget()

    def _forget(self):
        self.clear()
        self.new: list[str] = []
        self.level, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.lang, self.delta = np.zeros(0, np.int32), np.zeros(0)

    def __missing__(self, w: str) -> int:
        at = self[w] = len(self)
        self.new.append(w)
        return at

    def settle(self) -> None:
        if not self.new:
            return
        m, found = self.model, [self.model.known(w) for w in self.new]
        count = np.array([len(f) for f, _ in found], np.int64)
        rows = np.fromiter((r for f, _ in found for r in f), np.int64, int(count.sum()))
        owner, width = np.repeat(np.arange(len(found)), count), max(1, len(m.languages))
        cells = np.zeros((len(found), width))
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(m.size[rows]) // CELLS)) + 1):
            if len(part):
                r, o, a, b = rows[part], owner[part], owner[part[0]], owner[part[-1]] + 1
                flat = spans(m.start[r], m.size[r])
                cells[a:b] += np.bincount(np.repeat(o - a, m.size[r]) * width + m.lang[flat], m.delta[flat], (b - a) * width).reshape(-1, width)
        word, lang = np.nonzero(cells)
        size, grown = np.bincount(word, minlength=len(found)), len(self.lang)
        self.lang, self.delta = np.append(self.lang, lang.astype(np.int32)), np.append(self.delta, cells[word, lang] / count[word])
        self.level, self.size = np.append(self.level, [n for _, n in found]), np.append(self.size, size)
        self.start, self.new = np.append(self.start, grown + np.cumsum(size) - size), []

    def tidy(self) -> None:
        if len(self) > MEMO or len(self.lang) > FIGURES:
            self._forget()


def cuts(framed, n: int):
    """The n-grams of a framed word, as an array of strings."""
    cut = F.transform(F.sequence(F.lit(1), F.length(framed) - n + 1), lambda i: F.substring(framed, i, F.lit(n)))
    return F.when(F.length(framed) >= n, cut).otherwise(F.array().cast("array<string>"))


class TableModel:
    """The same model as a stored table (len, gram, langs: what each language's place in languages adds), for models that outgrow a
    broadcast. The driver holds languages and base, six figures a language."""

    def __init__(self, languages: list[str], base: np.ndarray, rows: DataFrame):
        self.languages, self.base, self.rows = languages, base, rows

    def known(self, vocabulary: DataFrame) -> DataFrame:
        """(w, adds) of the distinct words w that are known: what each adds by language, and 1 under -1 - the length at which it is known."""
        rows = self.rows.select("len", F.col("gram").alias("w"), "langs")
        own = vocabulary.join(rows.where("len = 0"), "w")
        framed = F.concat(F.lit("^"), "w", F.lit("$"))
        rest = vocabulary.join(own.select("w"), "w", "left_anti").select("w", F.explode(F.concat(*[cuts(framed, n) for n in NGRAMS])).alias("gram"))
        rest = stored(rest.groupBy("w", "gram").agg(F.count("*").alias("m")))
        hits = join_hot(rest, self.rows.where("len > 0"), "gram").withColumn("top", F.max("len").over(Window.partitionBy("w"))).where("len = top")
        adds = F.concat(F.transform("langs", lambda x: F.struct(x["lang"].alias("lang"), (x["delta"] * F.col("m")).alias("x"))), F.array(F.struct(F.lit(-1).alias("lang"), F.col("m").cast("double").alias("x"))))
        by = hits.select("w", "len", F.explode(adds).alias("a")).groupBy("w", "len", "a.lang").agg(F.sum("a.x").alias("x")).groupBy("w", "len").agg(F.collect_list(F.struct("lang", "x")).alias("all"))
        found = F.filter("all", lambda a: a["lang"] < 0)[0]["x"]
        rest = by.select("w", "len", F.transform(F.filter("all", lambda a: a["lang"] >= 0), lambda a: F.struct(a["lang"].alias("lang"), (a["x"] / found).alias("delta"))).alias("langs"))
        return own.select("w", "len", "langs").unionByName(rest).select("w", F.concat("langs", F.array(F.struct((-1 - F.col("len")).alias("lang"), F.lit(1.0).alias("delta")))).alias("adds"))

    def identify(self, rows: DataFrame, keep: list[str], out: str) -> DataFrame:
        """keep, lang_pred and score of rows (keep, _text): texts as bags of words, which meet the table by distinct word."""

        def bags(batches):
            for b in batches:
                for i in range(b.num_rows):
                    bag: Counter = Counter()
                    for found in words_of(b.column("_text")[i].as_py()):
                        bag.update(found)
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(k).slice(i, 1) for k in keep), pa.array([list(bag)], pa.list_(pa.string())), pa.array([list(bag.values())], pa.list_(pa.int64()))], [*keep, "_words", "_counts"]
                    )

        fields = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep), "_words array<string>, _counts array<long>"])
        bag = rows.mapInArrow(bags, fields)
        bag = stored(bag.withColumn("_row", F.monotonically_increasing_id()))
        flat = bag.select("_row", F.explode(F.arrays_zip("_words", "_counts")).alias("x")).select("_row", F.col("x._words").alias("w"), F.col("x._counts").alias("n"))
        known = stored(self.known(flat.select("w").distinct()))
        each = join_hot(flat, known, "w").select("_row", "n", F.explode("adds").alias("a"))
        sums = each.groupBy("_row", "a.lang").agg(F.sum(F.col("n") * F.col("a.delta")).alias("x")).groupBy("_row").agg(F.collect_list(F.struct("lang", "x")).alias("_adds"))
        shared, width = Shared(rows.sparkSession, (self.languages, self.base)), max(1, len(self.languages))

        def finish(batches):
            languages, base = shared.value
            step = max(1, CELLS // (8 * width))
            for b in batches:
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    sums, levels = np.zeros((part.num_rows, width)), np.zeros((part.num_rows, len(base)))
                    for i, found in enumerate(part.column("_adds")):
                        for a in found.as_py() or ():
                            if a["lang"] >= 0:
                                sums[i, a["lang"]] = a["x"]
                            else:
                                levels[i, -1 - a["lang"]] = a["x"]
                    langs, scores = answers(languages, base, sums, levels)
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

        return bag.drop("_words", "_counts").join(sums, "_row", "left").drop("_row").mapInArrow(finish, out)


def train(
    docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", per_language: int = TRAIN_DOCS, words: int = MODEL_WORDS, grams: int = MODEL_GRAMS, entries: int = MODEL_ENTRIES
) -> BackoffModel | TableModel:
    """A model from docs with a non-null language, about per_language documents of each at most.

    Languages are counted over all rows and all of them are learned; the sample is a share of each language by a hash of doc_id
    and text, its texts are read whole, and repeated rows are learned from once. Each language keeps its commonest words and
    grams n-grams (ties: the smaller one). A model of at most entries comes to the driver; a larger one stays a table.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null")
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("n")))
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"))
    sample = rows.join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["doc_id", "lang", "text"])

    def count(batches):
        for b in batches:
            found: dict = {}
            for own, text_ in zip(b.column("lang").to_pylist(), b.column("text")):
                for w in words_of(text_.as_py()):
                    found.setdefault(own, Counter()).update(w)
            flat = [(own, w, n) for own, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "w", "n"])

    said = sample.select("lang", "text").mapInArrow(count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    framed = F.concat(F.lit("^"), "w", F.lit("$"))
    cut = said.select("lang", "n", F.explode(F.concat(*[cuts(framed, n) for n in NGRAMS])).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n")).select("lang", F.length("gram").alias("len"), "gram", "n")
    whole = said.select("lang", F.lit(0).alias("len"), F.col("w").alias("gram"), "n")
    common = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "len", "gram"))
    kept = [df.withColumn("_rank", common).where(F.col("_rank") <= most).drop("_rank") for df, most in ((whole, words), (cut, grams))]
    kept = stored(kept[0].unionByName(kept[1]))
    if kept.count() <= entries:
        found = kept.orderBy("lang", "len", "gram").toArrow()
        return BackoffModel(list(zip(*(c.to_pylist() for c in found.columns))), [r["lang"] for r in sizes.collect()])
    languages = sorted(r["lang"] for r in sizes.collect())
    place = {x: i for i, x in enumerate(languages)}
    sums = np.zeros((max(NGRAMS) + 1, len(place)))
    for r in kept.groupBy("lang", "len").agg(F.sum("n").alias("n")).collect():
        sums[r["len"], place[r["lang"]]] = r["n"]
    places = docs.sparkSession.createDataFrame(list(place.items()), "lang string, place int")
    raised = F.log((F.col("n") + 0.1) / 0.1)
    table = stored(kept.join(places, "lang").groupBy("len", "gram").agg(F.collect_list(F.struct(F.col("place").alias("lang"), raised.alias("delta"))).alias("langs")))
    return TableModel(languages, base_of(sums, table.count()), table)


def identify(docs: DataFrame, model: BackoffModel | TableModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred and score for every row of docs, from its whole text alone; und and 0 for a text that is null or has no letter.

    A BackoffModel goes to the executors once, by broadcast; train bounds its entries. A TableModel is joined with. Both give the
    same answers. Repeated rows get the same answer, an empty table none.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(*[F.col(k) for k in keep], F.col(text).alias("_text"))
    out = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep), "lang_pred string, score double"])
    if isinstance(model, TableModel):
        return model.identify(rows, list(keep), out)
    shared = Shared(docs.sparkSession, model)

    def run(batches):
        model = shared.value
        memo = Memo(model)
        for b in batches:
            langs, scores = [], []
            step = max(1, min(256, CELLS // (8 * max(1, len(model.languages)))))
            for at in range(0, b.num_rows, step):
                x, y = model.predict((t.as_py() for t in b.column("_text").slice(at, step)), memo)
                langs += x
                scores += y
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, out)


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row per row of docs.

    Learns where crc32(doc_id) mod 4 is not 2 and lang is not null; a null doc_id is not learned from and not held out. A null
    or empty text, and one without letters, is und with score 0; repeated rows get one answer each; an empty table none.
    """
    rest = crc_mod("doc_id", 4)
    model = train(docs.where(rest != 2))
    held = F.coalesce(rest == 2, F.lit(False))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
