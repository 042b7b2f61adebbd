"""Structures that are stored and grow: the text index and merged snapshots."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import rollup, salience, search, textindex
from lorekeep.sources import snapshot, versions
from lorekeep.sources import adapters as ad


@pytest.fixture(scope="module")
def texts(spark, sf):
    return ad.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("person"), F.col("text").alias("content"))


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    """Three appends, one of them without rows, with ranges of about ten documents."""
    i = textindex.TextIndex(spark, str(tmp_path_factory.mktemp("index")))
    for rows in (texts.where("id < 80"), texts.where("false"), texts.where("id >= 80")):
        i.append(rows, keep=("person",), docs_per_range=10)
    return i


def found(df):
    return sorted((r["id"], round(r["rank"], 9)) for r in df.collect())


@pytest.mark.parametrize("query", ["the that", "the", "of-the", "Für dié", "und der", '"the" of-the in', "nowhere", "--", "the nowhere"])
def test_the_index_ranks_as_a_scan_does(index, texts, query):
    assert found(index.search(query, None)) == found(search.bm25(texts, query, None))


@pytest.mark.parametrize("k", [1, 3, 7, 1000])
def test_the_best_k_are_found_by_bounds(index, texts, k, monkeypatch):
    monkeypatch.setattr(textindex, "FIRST", 2)
    want = sorted((round(r["rank"], 9), r["id"]) for r in search.bm25(texts, "the of", None).collect())[:k]
    got = [(round(r["rank"], 9), r["id"]) for r in index.search("the of", k).collect()]
    assert [x for x, _ in got] == [x for x, _ in want] and len(set(got)) == len(want)
    who = F.col("person") == "src1"
    assert found(index.search("the of", None, fits=who)) == found(search.bm25(texts, "the of", None, fits=who))
    few = index.search("the of", 2, keep=("person",), fits=who).collect()
    assert len(few) == min(2, len(found(index.search("the of", None, fits=who)))) and all(r["person"] == "src1" for r in few)


def test_ranks_that_are_equal_when_rounded_are_ties(spark, tmp_path, monkeypatch):
    """A word that most texts hold: the exact ranks differ in their last digits, the ids that count are the smallest."""
    monkeypatch.setattr(textindex, "FIRST", 1)
    docs = spark.range(300).select("id", F.concat(F.repeat(F.lit("the "), (F.col("id") % 7 + 1).cast("int")), F.repeat(F.lit("x "), (F.col("id") % 11).cast("int"))).alias("content"))
    i = textindex.TextIndex(spark, str(tmp_path)).append(docs, docs_per_range=10)
    want = sorted((round(r["rank"], 6), r["id"]) for r in search.bm25(docs, "the", None).collect())[:25]
    got = sorted((round(r["rank"], 6), r["id"]) for r in i.search("the", 25, digits=6).collect())
    assert got == want and [r["id"] for r in i.search("the", 25).collect()] != [x for _, x in want]


def test_postings_are_not_shuffled_before_they_are_blocks(spark, texts, tmp_path, monkeypatch):
    """A text's postings are made where its terms are, in parts if a range has very many; the answers stay."""
    want = found(search.bm25(texts, "the of-the", None))
    monkeypatch.setattr(textindex, "HELD", 500)
    i = textindex.TextIndex(spark, str(tmp_path)).append(texts, docs_per_range=100)
    blocks = i.blocks()
    assert blocks.count() > blocks.select("term", "range").distinct().count()
    assert found(i.search("the of-the", None)) == want and found(i.search("the that", None)) == found(search.bm25(texts, "the that", None))
    assert [r["id"] for r in i.search("the", 5).collect()] == [r["id"] for r in search.bm25(texts, "the", 5).collect()]
    rows = texts.select(F.lit(0).alias("range"), "id", search.terms(F.col("content")).alias("w")).sortWithinPartitions("range", "id")
    assert "Exchange" not in textindex._blocks(rows)._jdf.queryExecution().executedPlan().toString()
    one = spark.createDataFrame([(0, 7, ["b", "a", "b"]), (0, 9, []), (0, 11, ["b"])], "range int, id long, w array<string>").coalesce(1)
    got = {r["term"]: tuple(r[c] for c in ("n", "max_tf", "min_dl", "ids", "tfs", "dls", "places")) for r in textindex._blocks(one).collect()}
    assert got == {"a": (1, 1, 3, [7], [1], [3], [[1]]), "b": (2, 2, 1, [7, 11], [2, 1], [3, 1], [[0, 2], [0]])}


def test_only_blocks_of_asked_terms_are_read(index):
    plan = index.blocks(["the"]).select("ids")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan and "EqualTo(term,the)" in plan.replace(" ", "") and "places" not in plan.split("ReadSchema")[1]
    folders = index.blocks(["the"]).select("bucket").distinct().count()
    assert folders == 1 and index.blocks().select("bucket").distinct().count() == textindex.BUCKETS


def test_appends_and_merges(spark, texts, tmp_path):
    i = textindex.TextIndex(spark, str(tmp_path)).append(texts.where("id < 50"))
    before = found(i.search("the", None))
    i.append(spark.createDataFrame([(-1, "the the best of all"), (-2, None), (-3, "")], "id long, content string"))
    after = found(i.search("the", None))
    assert -1 in {x for x, _ in after} - {x for x, _ in before} and i.n == 53
    again = textindex.TextIndex(spark, str(tmp_path))
    assert again.version == 2 and found(again.search("the", None)) == after and found(again.merge().search("the", None)) == after and len(again.segments) == 1
    assert found(again.search("best-of", None)) == found(i.search("best-of", None)) != []
    # what was written but never published is not there
    i.blocks().drop("segment").withColumn("segment", F.lit("s9")).write.partitionBy("segment", "bucket").mode("append").parquet(f"{tmp_path}/postings")
    assert found(textindex.TextIndex(spark, str(tmp_path)).search("the", None)) == after


def test_an_index_is_kept_for_its_files(spark, sf):
    docs = ad.table(spark, sf, "documents")
    one, two = (textindex.kept(docs, "doc_id", "text") for _ in range(2))
    assert one.path == two.path and two.version == 1
    with pytest.raises(ValueError):
        textindex.TextIndex(spark, one.path + "-other").blocks()


def test_two_writers_of_a_version(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "name string")
    versions.publish(spark, str(tmp_path), 1, rows)
    with pytest.raises(Exception, match="exists"):
        versions.publish(spark, str(tmp_path), 1, rows)
    assert versions.current(spark, str(tmp_path))[0] == 1 and versions.current(spark, f"{tmp_path}/none") == (0, [])


def adjusted(base, log):
    return salience.apply_adjustments(base, log.select(F.col("id").alias("trace_id"), "seq", "delta"), ("seq",)).select("id", F.col("adjusted").alias("salience"))


def values(df):
    return {r["id"]: round(r["salience"], 9) for r in df.collect()}


def test_merges_of_a_log(spark, tmp_path):
    base = spark.range(200).select("id", (F.col("id") % 10 / 10).alias("salience"))
    log = spark.range(600).select((F.col("id") * 7 % 40).alias("id"), F.col("id").alias("seq"), (F.col("id") % 5 * 0.1 - 0.2).alias("delta"))
    want = values(adjusted(base, log))
    s = snapshot.Snapshot(spark, str(tmp_path), buckets=16).create(base)
    assert s.merge(adjusted) == 0 and values(s.read(adjusted)) == values(base)
    s.append(log.where("seq < 300"))
    assert values(s.read(adjusted)) == values(adjusted(base, log.where("seq < 300")))
    touched = s.merge(adjusted)
    assert 0 < touched <= 16 and s.merge(adjusted) == 0 and s.version == 2
    s.append(log.where("seq >= 300 and id = 7"))
    s.append(log.where("seq >= 300 and id <> 7"))
    assert values(s.read(adjusted)) == want
    other = snapshot.Snapshot(spark, str(tmp_path), buckets=16)
    assert other.merge(adjusted) > 0 and values(other.base()) == want and other.merge(adjusted) == 0


def test_a_merge_rewrites_only_what_the_log_touches(spark, tmp_path):
    base = spark.range(100).select("id", F.lit(None).cast("string").alias("metadata"))
    fold = lambda b, log: rollup.mark(b, log, "archived", F.lit(True))
    s = snapshot.Snapshot(spark, str(tmp_path), buckets=8).create(base)
    s.append(spark.createDataFrame([(3, 1)], "id long, seq long"))
    assert s.merge(fold) == 1
    assert sum(r["name"].startswith("base/v2") for r in s.parts) == 1 and len(s.parts) == 8
    assert [r["id"] for r in s.base().where("metadata is not null").collect()] == [3] and s.base().count() == 100


def test_many_queries_send_their_best_and_no_pairs(spark, index, texts, tmp_path, monkeypatch):
    """Each of many queries against all documents: the answers of a scan, ties to the smaller id, and of each task a query's best alone."""
    asked = [["the", "that"], ["the"], ["of", "the", "und"], ["nowhere", "the"], ["der", "und"], ["in", "that", "the", "to"]]
    queries = spark.createDataFrame([(i, w) for i, w in enumerate(asked)], "q int, words array<string>")

    def brute(rows, k):
        return sorted((i, r["id"], round(-r["rank"], 9)) for i, w in enumerate(asked) for r in search.bm25(rows, " ".join(w), k).collect())

    got = lambda df: sorted((r["q"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert got(index.best_holding(queries, 1000)) == brute(texts, None)
    best = got(index.best_holding(queries, 3))
    monkeypatch.setattr(textindex, "ASKED", 2)
    monkeypatch.setattr(textindex, "PAIRS", 5)
    monkeypatch.setattr(textindex, "KEPT", 4)
    assert got(index.best_holding(queries, 1000)) == brute(texts, None) and got(index.best_holding(queries, 3)) == best
    assert [(i, s) for i, _, s in best] == [(i, s) for i, _, s in brute(texts, 3)]

    sent, made = [], textindex._best_holding
    monkeypatch.setattr(textindex, "_best_holding", lambda *a: sent.append(made(*a)) or sent[-1])
    copies = spark.range(400).select("id", F.lit("a b c d e").alias("content"))
    i = textindex.TextIndex(spark, str(tmp_path)).append(copies, docs_per_range=20)
    many = spark.createDataFrame([(n, sorted({"a", "b", "c", "d", "e"} - {w})) for n, w in enumerate("abcdex")], "q int, words array<string>")
    assert [(r["q"], r["id"]) for r in i.best_holding(many, 4).orderBy("q", "id").collect()] == [(n, k) for n in range(6) for k in range(4)]
    assert sent[0].count() <= 6 * 4 * 2 * spark.sparkContext.defaultParallelism < 6 * 400
    assert i.best_holding(queries, 4).count() == 0
