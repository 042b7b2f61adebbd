"""Quality rules: counts of each text, and a hashed n-gram likelihood ratio between trusted documents and the corpus.

Words and pairs of words are hashed to BUCKETS. A bucket's weight is the logarithm of how much more often trusted
documents hold it than all documents do, with a prior that follows the corpus, so a bucket of which nothing is known
weighs little. A document's score is the mean weight of its n-grams, and a document stays if that is at least THRESHOLD.
Weights are whole millionths, so that sums do not depend on the order of rows and a score is the same in every run.

DataFrame operations only. A text is cut into an array of its words, so memory grows with the longest text of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import durable

#: Buckets that n-grams are hashed to: the table of weights, which is broadcast, has this many rows at most.
BUCKETS = 1 << 16
#: Trusted documents that the target is counted on at most (the corpus is counted on all documents).
TRUSTED = 50_000
#: N-grams that the prior counts for, and the least mean weight of a document that stays.
PRIOR, THRESHOLD = 65_536, -0.2
#: Words of a window that may repeat, and of a document that is too short.
WINDOW, LEAST_WORDS = 5, 10
SPACE = r"[\x20\x09-\x0D]+"
MICRO = 1_000_000


def words(text: Column) -> Column:
    """The runs of characters that are no ASCII white space; none of a null."""
    return F.coalesce(F.filter(F.split(text, SPACE), lambda w: w != ""), F.array().cast("array<string>"))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once, whatever the optimizer does with the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, hashes: Column) -> Column:
    """How many words stand in a window of WINDOW words that the text holds twice or more.

    Hashes tell whether any window may repeat; only where one may are the windows themselves sorted and compared.
    """
    n = F.size(words)
    at = F.sequence(F.lit(0), n - WINDOW)
    key = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    window = F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("i")))
    twice = lambda s: F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"]))
    places = F.sort_array(F.transform(_once(F.sort_array(window), twice), lambda x: x["i"]))
    covered = _once(places, lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x))
    return F.when(n < WINDOW, 0).when(_once(key, lambda k: F.size(F.array_distinct(k)) == F.size(k)), 0).otherwise(covered).cast("long")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(hashes: Column) -> Column:
    """The buckets of a text's words, and of its pairs of words."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = F.transform(hashes, lambda h, i: F.when(i > 0, bucket(F.xxhash64(F.get(hashes, i - 1), h))))
    return F.concat(F.transform(hashes, bucket), F.array_compact(pairs))


def _counts(text: Column, words: Column, hashes: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size(words).cast("long")
    return _once(repeated_words(words, hashes), lambda again: F.struct(
        n.alias("n_words"), F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), again.alias("n_repeat_words"),
        ((n < LEAST_WORDS) | (100 * again > 20 * n)).alias("base_failed"), _grams(hashes).alias("grams"),
    ))


def counted(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_row, doc_id, the counts of the base rules, base_failed and grams (bucket of each word and pair of words), a row for each document."""
    whole = _once(F.coalesce(F.col(text), F.lit("")), lambda t: _once(words(t), lambda w: _once(_hashes(w), lambda h: _counts(t, w, h))))
    return documents.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), whole.alias("_s")).select("_row", "doc_id", "_s.*")


def gram_weights(documents: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = TRUSTED, prior: int = PRIOR) -> DataFrame:
    """(bucket, weight): the log ratio of each bucket that documents hold, in millionths. trusted (doc_id) names the trusted ones.

    Of these the first most in the order of a hash of their id are counted, so that their ids can be broadcast. Without
    trusted documents every weight is 0.
    """
    own = trusted.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    own = F.broadcast(own.orderBy(F.xxhash64("_id"), "_id").limit(most))
    rows = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("t")).join(own.withColumn("_own", F.lit(1)), "_id", "left")
    grams = rows.select("_own", F.explode(_once(_hashes(words(F.col("t"))), _grams)).alias("bucket"))
    counts = durable(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_own").alias("target")))
    total = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    ratio = (F.col("target") * (F.col("all_raw") / F.col("raw")) + prior) / (F.col("all_target") + prior)
    return counts.crossJoin(F.broadcast(total)).select("bucket", F.round(F.ln(ratio) * MICRO).cast("long").alias("weight"))  # total is one row


def judge(documents: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept: a row for each row of documents.

    score is the mean log ratio of the document's n-grams, 0 of a text without any. A null text has no words and fails the
    base rules, as every text of under ten words does; an id may be null or repeat, each row is judged by its own text. Only
    the columns named are read, so others may have any name. Empty documents give no rows; without trusted documents the
    base rules alone decide.
    """
    weights = F.broadcast(gram_weights(documents, trusted, doc_id, text))
    rows = counted(documents, doc_id, text)
    keys = [c for c in rows.columns if c != "grams"]
    scored = rows.select(*keys, F.explode_outer("grams").alias("bucket")).join(weights, "bucket", "left")
    total = scored.groupBy(*keys).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("_sum"), F.count("bucket").alias("_n"))
    score = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n") / MICRO).otherwise(0.0)
    kept = ~F.col("base_failed") & (F.col("_sum") >= F.col("_n") * int(threshold * MICRO))
    return total.select(*keys[1:], score.alias("score"), kept.alias("kept"))


def op11(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """judge, with the documents that labels call good as the trusted ones; nulls, repeated rows and empty tables as there."""
    return judge(documents, labels.where("quality = 1").select("doc_id"))
