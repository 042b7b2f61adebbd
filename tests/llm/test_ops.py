"""The training-data operators on awkward rows and on the smallest tables, against brute force or SQL."""

import random
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[1]))
import brute  # noqa: E402
from conftest import duck_rows, rows_of  # noqa: E402

from lorekeep.llm import chat, chunk_dedup, decontaminate, jaccard, language, mixing, quality, queries, suffix_dedup, url_filter, vectors  # noqa: E402
from lorekeep.llm.common import table  # noqa: E402

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi omega über naïve été".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def near(text, seed, share):
    r, w = random.Random(seed), text.split()
    return " ".join("zz" + str(r.randrange(999)) if r.random() < share else x for x in w)


BASE, PASSAGE = prose(1, 300), prose(2, 60)
ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, near(BASE, 3, 0.01)), (4, near(BASE, 4, 0.03)), (5, None), (6, ""), (7, " \t\n "), (8, "one two"), (9, "One  two"), (10, "x" * 350),
    (None, prose(5, 80)), (None, None), (11, prose(6, 40) + " " + PASSAGE + " " + prose(7, 40)), (12, PASSAGE + " " + prose(8, 20)), (13, prose(9, 4000)), (14, "é" * 120 + PASSAGE), (15, "a b c d e"),
    (16, "a b c d e"), (17, "ab" * 400), (18, prose(9, 4000)[:15000]), (13, "other text with the same id"), *[(100 + i, near(BASE, i, 0.005 * i)) for i in range(12)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None if d == 5 else "en", None if d is None or d % 5 == 0 else f"s{d % 3}", 1, "x", 2.0, 3, "y", 4) for d, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket string, size double, _doc long, component string, n long")


@pytest.fixture
def empty(docs):
    return docs.where("false")


def tuples(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(name, spark, sf, duck):
    assert repr(rows_of(queries.QUERIES[name](spark, sf))) == repr(duck_rows(duck, queries.ORACLES[name]))


def test_op6_equals_brute_force(spark, docs, empty):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert tuples(suffix_dedup.op6(spark, docs), cols) == brute.op6(ROWS)
    assert suffix_dedup.op6(spark, empty).count() == 0


def test_op6_whole_table(spark, sf):
    t = table(spark, sf, "documents")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert tuples(suffix_dedup.op6(spark, t), cols) == brute.op6([tuple(r) for r in t.select("doc_id", "text").collect()])


def test_op10_equals_brute_force(spark, sf, docs, empty):
    cols = ["doc_id", "n_bytes", "n_chunks", "n_removed_chunks", "n_removed", "kept_sha256"]
    assert tuples(chunk_dedup.op10(spark, docs), cols) == brute.op10(ROWS)
    t = table(spark, sf, "documents")
    assert tuples(chunk_dedup.op10(spark, t), cols) == brute.op10([tuple(r) for r in t.select("doc_id", "text").collect()])
    assert chunk_dedup.op10(spark, empty).count() == 0


def test_op8_equals_brute_force(spark, docs, empty):
    assert tuples(jaccard.op8(spark, docs), ["doc_id", "n_shingles", "component_id"]) == brute.op8(ROWS)
    assert jaccard.op8(spark, empty).count() == 0


def test_op8_chain_of_near_copies(spark):
    """A family in which most pairs are not linked: links run through the middle, and leaders alone would miss some."""
    rows, text = [], prose(50, 120)
    for i in range(60):
        rows.append((i, text))
        text = near(text, 500 + i, 0.012)
    rows += [(200 + i, near(rows[30][1], i, 0.03)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert tuples(jaccard.op8(spark, df), ["doc_id", "n_shingles", "component_id"]) == brute.op8(rows)


def test_op8_with_hot_tokens_in_every_task(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 2)
    monkeypatch.setattr(jaccard, "HELD_TOKENS", 400)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows, text = [], prose(60, 90)
    for i in range(50):
        rows.append((i * 7 % 50, text))
        text = near(text, 700 + i, 0.014)
    rows += [(300 + i, near(rows[25][1], i, 0.035)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert tuples(jaccard.op8(spark, df), ["doc_id", "n_shingles", "component_id"]) == brute.op8(rows)


def test_op8_with_ids_of_64_bits(spark):
    ids = [2**62 + 1, 2**62 + 2, -(2**62) - 3, 2**63 - 1, -(2**63), 2**58, 5, 6]
    rows = list(zip(ids, [BASE, BASE, near(BASE, 3, 0.01), near(BASE, 4, 0.01), BASE, prose(5, 80), prose(5, 80), prose(6, 80)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert tuples(jaccard.op8(spark, df), ["doc_id", "n_shingles", "component_id"]) == brute.op8(rows)
    assert [r["doc_id"] for r in jaccard.keep_one(df).orderBy("doc_id").collect()] == [-(2**63), 5, 6]


def test_op8_hot_group_and_small_sets(spark):
    rows = [(i, prose(1000 + i, 3 + i % 25)) for i in range(150)] + [(1000 + i, near(prose(77, 30), i, 0.02)) for i in range(80)] + [(3000 + i, PASSAGE + " " + prose(4000 + i, 60)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert tuples(jaccard.op8(spark, df), ["doc_id", "n_shingles", "component_id"]) == brute.op8(rows)


def test_op3_awkward_rows_and_blocks(spark, docs, empty):
    bench = [(1, PASSAGE), (2, None), (3, ""), (4, "One two"), (5, "Über0 " + prose(11, 8)), (5, prose(6, 12)), (None, prose(5, 30)), (10, "?!")]
    b = spark.createDataFrame([(*r, 1) for r in bench], "item_id long, text string, row int")
    c = duckdb.connect()
    c.sql("create table documents(doc_id bigint, text varchar)"), c.sql("create table benchmark(item_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", ROWS), c.executemany("insert into benchmark values (?, ?)", bench)
    want = duck_rows(c, decontaminate.ORACLE)
    assert repr(rows_of(decontaminate.op3(spark, docs, b))) == repr(want)
    whole = {r["doc_id"]: r["n_hit"] for r in decontaminate.op3(spark, docs, b).collect()}
    several = decontaminate.measure(docs, b, ["doc_id"], block_words=40)
    for r in several.collect():
        spans = np.frombuffer(r["spans"], np.int64).reshape(-1, 2)
        if r["row"]["doc_id"] not in (None, 2, 13):
            assert whole[r["row"]["doc_id"]] == int((spans[:, 1] - spans[:, 0]).sum())
    assert decontaminate.op3(spark, empty, b).count() == 0
    assert decontaminate.op3(spark, docs, b.where("false")).where("contaminated").count() == 0
    kept = decontaminate.remove_contaminated(docs, b)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not brute.contaminated(t, [x for _, x in bench]) for _, t in ROWS)
    m = decontaminate.find_matches(docs, b).where("doc_id = 12 and item_id = '1'").first()
    assert (m["doc_word"], m["item_word"], m["n_words"]) == (0, 0, 60)


def test_op2_mix(spark, sf, docs, empty):
    t = table(spark, sf, "documents")
    rows = mixing.mix_sources(t).toPandas()
    assert len(rows) == t.count() and (rows["taken"] <= 3 * rows["size"]).all()
    per = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), most=("size", "max"), true=("size", "sum"))
    assert (per["size"] == per["true"]).all() and (per["target"] <= 3 * per["size"] + 1e-6).all() and abs(per["target"].sum() - per["size"].sum()) < 1e-3
    assert (abs(per["taken"] - per["target"]) <= per["most"]).all()
    assert tuples(mixing.mix_sources(t), ["doc_id", "taken"]) == sorted(zip(rows["doc_id"], rows["taken"]), key=repr)
    small = mixing.mix_sources(docs, block=8).toPandas()  # several levels of blocks
    assert len(small) == len(ROWS) and (small["taken"] <= 3 * small["size"]).all()
    assert mixing.mix_sources(empty).count() == 0


def test_op2_flight_keeps_sums():
    r = np.random.default_rng(0)
    p, size = r.random(500), r.integers(1, 900, 500)
    q = mixing.flight(p, size, 1)
    assert ((q == 0) | (q == 1)).sum() >= 498 and q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())


def test_op2_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), (None, 1000), ("c", 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # weights 5, 2, 1 and 5 for the null: a stops at 30, b at 300, c at 0, the rest is the last one's
    assert got == {"a": 30.0, "b": pytest.approx(300.0), "c": 0.0, None: pytest.approx(780.0)}


def test_op1(spark, sf, docs, empty):
    t = table(spark, sf, "documents")
    rows = language.op1(spark, t).join(t.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(rows) == t.count() and (rows["lang_pred"] == rows["lang"])[rows["held_out"]].mean() > 0.97 and rows["score"].between(0, 1).all()
    odd = t.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "12 — !!", "en"), (None, "the and of that", None)], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in language.op1(spark, odd).where("doc_id < 0 or doc_id is null").collect()}
    assert [got[k]["lang_pred"] for k in (-1, -2, -3, None)] == ["und", "und", "und", "en"] and got[None]["held_out"] is False
    assert language.op1(spark, empty).count() == 0
    assert language.op1(spark, docs).count() == len(ROWS)


def test_op1_backs_off_to_shorter_grams():
    m = language.BackoffModel([("a", 0, "haus", 9), ("b", 0, "casa", 9), ("a", 5, "^haus", 9), ("a", 2, "au", 9), ("b", 1, "s", 9), ("a", 1, "h", 9)])
    assert m.predict(["haus", "hausen", "xs", "", None, "qq"], {})[0][:5] == ["a", "a", "b", "und", "und"]


def test_op4(spark, sf, docs, empty):
    t, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = quality.op4(spark, t, labels)
    assert rows.count() == t.count() and rows.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    seen = rows.join(labels, "doc_id")
    assert seen.where("predicted = quality").count() >= 0.95 * seen.count()
    assert quality.op4(spark, docs, labels).count() == len(ROWS)
    assert quality.op4(spark, empty, labels).count() == 0
    assert {r["score"] for r in quality.op4(spark, docs, labels.where("false")).collect()} == {0.5}
    mixed = spark.createDataFrame([(1, 1, "a"), (1, 0, "b"), (None, 1, "c"), (3, None, "d")], "doc_id long, quality int, text string")
    assert quality.op4(spark, docs, mixed).count() == len(ROWS)


def test_op4_forward_backward_equals_sums_over_all_labellings():
    import itertools

    r = np.random.default_rng(1)
    chain = quality.LineChain(2)
    chain.w, chain.t = r.normal(size=2), r.normal(size=(2, 2))
    x, counts = r.normal(size=(7, 2)), np.array([4, 1, 2])
    got, _ = chain.marginals(x, counts)
    at = 0
    for n in counts:
        e = x[at : at + n] @ chain.w
        weight = {y: np.exp(sum(e[i] for i in range(n) if y[i]) + sum(chain.t[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=int(n))}
        for i in range(n):
            assert got[at + i] == pytest.approx(sum(v for y, v in weight.items() if y[i]) / sum(weight.values()))
        at += n


def test_op4_line_features_count_lines():
    from lorekeep.llm.common import text_bytes
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(["a b\n\nC1!", None, "", "x\n"]))
    x, weight, counts = quality.line_features(data, offsets)
    assert counts.tolist() == [3, 1, 1, 2] and weight.tolist() == [4, 1, 4, 1, 1, 2, 1]


def test_op5_awkward_rows(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 1, "ann", "same turn"), (1, 1, "ann", "same turn"), (1, 2, "system", "s"), (1, None, None, ""), (2, 0, "system", "alone"), (None, 0, "cy", "x"), (3, 0, None, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, ord int")
    c = duckdb.connect()
    c.sql("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)"), c.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert repr(rows_of(chat.rotate_perspectives(df))) == repr(duck_rows(c, chat.ORACLE))
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.render_dialogues(df).collect()}
    ann = whole[(1, "ann")]
    assert ann["text"].startswith("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n") and len(ann["spans"]) == 3
    assert [ann["text"][s["start"] : s["end"]] for s in ann["spans"]][0] == "hi<|im_end|>\n" and set(whole) == {(1, "ann"), (1, "bob"), (None, "cy")}


def test_op7_awkward_rows(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/", "http://com", "http://x.com/?q", "https://Example.com/en/1#a", "https://www.example.com/en/", "http://notexample.com/en/", "http://a.net/es/x", "http://a.net/es", "http://a.net/fr/?x=/es/",
            "x://spam-farm.example.org/en/1", "http://a.org/Login.html", "http://a.com:80/en/", "http://a.com/x\ny", "http://u.org/a/click-here", "http://a.org://b.com/", "http://a.net/ES/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(1, ""), (None, "http://com/"), (7, urls[7])]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    c = duckdb.connect()
    c.sql("create table pages(page_id bigint, url varchar)"), c.executemany("insert into pages values (?, ?)", rows)
    assert repr(rows_of(url_filter.op7(spark, df))) == repr(duck_rows(c, url_filter.ORACLE))
    assert url_filter.op7(spark, df.where("false")).count() == 0
    assert url_filter.filter_urls(df).columns == df.columns
    nodes = url_filter.op7(spark, df)._jdf.queryExecution().toString()
    assert "Python" not in nodes and "Arrow" not in nodes


def test_op9(spark, sf):
    t = table(spark, sf, "embeddings")
    got = vectors.op9(spark, t).toPandas()
    ids, x = zip(*[(r["vec_id"], r["embedding"]) for r in t.collect()])
    ids, x = np.array(ids), np.array(x, float)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and own["score"].is_monotonic_increasing
        hit, total = hit + len({int(ids[k]) for k in best} & set(own["vec_id"])), total + 10
        near_ = dict(zip(own["vec_id"], own["score"]))
        assert all(near_[int(ids[k])] == pytest.approx(d[k], abs=1e-12) for k in best if int(ids[k]) in near_)
    assert hit / total >= 0.9


def test_op9_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (100, []), (200, [3.0, 4.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, list int")
    got = tuples(vectors.op9(spark, df), ["query_id", "rank", "vec_id", "score"])
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (0, 4, 200), (200, 1, 2), (200, 2, 2), (200, 3, 0), (200, 4, 1)]  # every row is a candidate
    assert vectors.op9(spark, df.where("false")).count() == 0


def test_op9_many_equal_vectors(spark):
    df = spark.range(6000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array((F.col("id") % 97) / 7.0, (F.col("id") % 89) / 5.0)).alias("embedding"))
    got = vectors.op9(spark, df).where("query_id = 300").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [i for i in range(0, 60, 3)][:10] and {r["score"] for r in got} == {0.0}


def test_op9_small_groups_far_from_others(spark):
    x = np.random.default_rng(3).normal(size=(3000, 4))
    x[:100] = 1000.0 * np.eye(4)[np.arange(100) % 4]
    x[0], x[100], x[200:204] = -900.0, 700.0, [-500.0, 500.0, -500.0, 500.0]  # a lone vector, another, four copies
    x[4:100] = np.random.default_rng(4).normal(size=(96, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vectors.op9(spark, df).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"]) for r in got] == [(q, k) for q in range(0, 3000, 100) for k in range(1, 11)]
    assert [r["vec_id"] for r in got if r["query_id"] == 200][:3] == [201, 202, 203]


def test_op9_lists_full_of_the_own_id(spark):
    x = np.random.default_rng(5).normal(size=(2000, 4))
    x[1980:] += 500.0
    df = spark.createDataFrame([(max(0, i - 1979), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vectors.op9(spark, df).orderBy("rank").collect()
    d = np.sqrt(((x[:1980, None] - x[None, 1980:]) ** 2).sum(2)).ravel()
    assert [r["rank"] for r in got] == list(range(1, 11)) and [r["score"] for r in got] == pytest.approx(np.sort(d)[:10].tolist())


def test_columns_that_do_not_depend_on_a_model(spark, sf):
    """held_out of op1 and op4, and sizes and targets of op2, against plain Python over whole tables."""
    import re
    import zlib

    t, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rest = lambda n: lambda d: zlib.crc32(str(d).encode()) % n
    assert {r["doc_id"]: r["held_out"] for r in language.op1(spark, t).collect()} == {r["doc_id"]: rest(4)(r["doc_id"]) == 2 for r in t.collect()}
    assert {r["doc_id"]: r["held_out"] for r in quality.op4(spark, t, labels).collect()} == {r["doc_id"]: rest(5)(r["doc_id"]) == 0 for r in t.collect()}
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in t.collect()}
    source = {r["doc_id"]: r["source"] for r in t.collect()}
    per = {s: sum(n for d, n in size.items() if source[d] == s) for s in set(source.values())}
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        rate = (sum(per.values()) - sum(3 * per[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if weight[s] * rate > 3 * per[s]}
        if more == full:
            break
        full = more
    target = {s: 3.0 * per[s] if s in full else weight[s] * rate for s in names}
    for r in mixing.op2(spark, t).collect():
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"], r["target"]) == (size[r["doc_id"]], per[s], pytest.approx(target[s]))
