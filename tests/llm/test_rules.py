"""Quality rules, whitening and spelling variants against plain versions, on awkward rows and on whole tables."""

import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute_rules as brute  # noqa: E402

from lorekeep.llm import queries, quality_rules, spelling, whitening  # noqa: E402
from lorekeep.llm.common import table  # noqa: E402

LINE = "the same line stands here once more and again"
TEXTS = [
    (1, None), (2, ""), (3, " \n\t\x0b "), (4, "one two three"), (5, LINE + "\n" + LINE), (6, LINE + "\n" + LINE + "\n" + " ".join(f"word{i}" for i in range(100))), (6, "x " * 40),
    (None, " ".join(f"plain{i}" for i in range(30))), (None, None), (7, "### *** $$$ %%% &&& ||| <a> b c d e f g"), (8, " ".join(f"w{i % 7}" for i in range(50))), (9, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z a b c d e"),
    (10, "é" * 9 + " naïve word été " * 5), (11, " ".join(f"long{i}" for i in range(200_000))), (12, "\n\n".join(["same"] * 12)), (13, "a b c d e " * 1000), (14, "\U0001f600 smile " * 20),
]


def rule_rows(df):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    return sorted((tuple(round(v, 9) if c == "score" else v for c, v in zip(cols, (r[c] for c in cols))) for r in df.collect()), key=repr)


def rounded(rows):
    return sorted(((*r[:7], round(r[7], 9), r[8]) for r in rows), key=repr)


def test_quality_rules_on_awkward_rows(spark):
    docs = spark.createDataFrame([(i, t, "b", 1, 2.0) for i, t in TEXTS], "doc_id long, text string, bucket string, n_words int, weight double")
    trusted = spark.createDataFrame([(6,), (6,), (9,), (None,), (99,)], "doc_id long")
    assert rule_rows(quality_rules.judge(docs, trusted)) == rounded(brute.op11(TEXTS, {6, 9}))
    assert rule_rows(quality_rules.judge(docs, trusted.where("false"))) == rounded(brute.op11(TEXTS, set()))
    assert quality_rules.judge(docs.where("false"), trusted).count() == 0


def test_quality_rules_on_the_whole_table(spark, sf):
    docs, labels = table(spark, sf, "documents").collect(), table(spark, sf, "labels").collect()
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    got = queries.QUERIES["op11_quality_rules"](spark, sf)
    assert rule_rows(got) == rounded(brute.op11([(r["doc_id"], r["text"]) for r in docs], good))


def test_quality_rules_keep_good_documents(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    rows = queries.QUERIES["op11_quality_rules"](spark, d).where("not base_failed").join(table(spark, d, "labels"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_quality_rules_run_in_the_jvm(spark, sf):
    plan = queries.QUERIES["op11_quality_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, dim int")


def compare(got, want):
    """Components may have either sign, the same for all rows."""
    rows, found = got.collect(), {}
    for r in rows:
        found.setdefault((r["vec_id"], r["component"]), []).append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
        assert r["identity_error"] <= 1e-9
    assert found.keys() == want.keys()
    for k in want:
        for a, b in zip(sorted(found[k]), sorted(want[k]), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-7) and a[3] == pytest.approx(b[3], rel=1e-9)


def test_whitening_on_the_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    compare(queries.QUERIES["op12_whiten"](spark, sf), brute.op12(rows))


def test_whitening_on_awkward_rows(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 3 - k % 3) for k in range(9)]) for i in range(60)]
    rows += [(1, rows[1][1]), (100, rows[2][1]), (101, None), (102, [1.0] * 8 + [None]), (103, [1.0] * 8 + [float("nan")]), (104, [float("-inf")] + [0.0] * 8), (None, [0.0] * 9), (105, [-0.001] * 9)]
    compare(whitening.whiten(vectors_of(spark, rows)), brute.op12(rows))
    equal = vectors_of(spark, [(i, [0.5, 0.25]) for i in range(5)])
    assert whitening.whiten(equal).count() == 0 and whitening.whiten(equal.where("false")).count() == 0
    flat = vectors_of(spark, [(i, [i / 8, 0.5, 0.5]) for i in range(6)] + [(9, []), (10, [3.0])])  # one component, and other lengths
    assert {(x["component"], x["n"]) for x in whitening.whiten(flat).collect()} == {(1, 6)}


def test_wide_whole_numbers(spark):
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [3e14, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {x["deviation"] for x in whitening.whiten(df).collect()} == {None}


@pytest.mark.parametrize("seed", range(4))
def test_leading_eigenvalues(seed):
    r = np.random.default_rng(seed)
    x = r.standard_normal((40, 12)) * np.array([5, 5, 3, 2] + [1] * 8)
    v = x.T @ x / 40
    e, u = whitening.leading(v, 4)
    want = np.linalg.eigvalsh(v)[::-1]
    assert np.allclose(e, want[:4], rtol=1e-12) and np.allclose(v @ u, u * e, atol=1e-10) and np.allclose(u.T @ u, np.eye(4), atol=1e-12)
    for shift in (want[0] + 1, (want[1] + want[2]) / 2, 0.0, -1.0):
        assert whitening.ldl_pivots(v - shift * np.eye(12))[0] == (want > shift).sum()
    q = np.linalg.qr(r.standard_normal((6, 6)))[0]
    twin = q @ np.diag([4.0, 4, 4, 1, 1, 0]) @ q.T
    e, u = whitening.leading((twin + twin.T) / 2, 4)
    assert np.allclose(e, [4, 4, 4, 1]) and np.allclose(u.T @ u, np.eye(4), atol=1e-9) and np.allclose(twin @ u, u * e, atol=1e-8)


SPELT = " ".join(["receive"] * 120 + ["recieve", "receve"] * 3 + ["reeceive"] * 2 + ["Receivé"] * 2 + ["receiver"] * 12 + ["receivers"] * 2 + ["tiny"] * 5 + ["ÀÉÎÕÜßþ"] * 2 + ["once"])


def spelt(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def test_spelling_on_awkward_rows(spark):
    rows = [(1, SPELT), (1, SPELT), (2, None), (3, ""), (None, SPELT), (4, "b" * 3000 + " " + "b" * 2999 + "c " + "b" * 3000), (5, "b" * 2999 + "c " + "b" * 2998 + "c"), (6, "b" * 2998 + "c"), (7, "x1receive2ÿreceive×receive÷receive")]
    rows += [(100 + i, " ".join(["receive"] * 20)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, r string, n int")
    want = brute.op13(rows)
    assert any(w[1] for w in want) and spelt(spelling.variants(docs)) == want
    assert spelling.variants(docs.where("false")).count() == 0


def test_spelling_chains_and_rounds(spark):
    """Forms that follow one another, and filters that must be searched in many rounds."""
    words = {"aaaaaaa": 2, "aaaaaab": 30, "aaaaabb": 400, "aaaabbb": 5000, "aaabbbb": 60_000, **{"x" * 7 + "".join(p): 2 + k % 3 for k, p in enumerate(zip("abcdefghij" * 40, "abcdefghijklmn" * 30))}}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = {r["word"]: r for r in spelling.group_variants(df).collect()}
    assert rows["aaaaaaa"]["root"] == "aaabbbb" and rows["aaaaaaa"]["form"] == "aaaaaab" and rows["aaabbbb"]["form"] is None
    again = spelt(spelling.group_variants(df, round_bytes=64))
    assert again == spelt(spelling.group_variants(df)) and len(spelling.plan_rounds({7: 100, 9: 5}, 64)) > 3


def test_spelling_on_the_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert spelt(queries.QUERIES["op13_spelling"](spark, sf)) == brute.op13(rows)


def test_score_is_finite():
    assert math.isfinite(brute.op11([(1, "a b")], {1})[0][7])
