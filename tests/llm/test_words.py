"""Words whose hashes are equal by construction link nothing and contaminate nothing."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from lorekeep.llm import decontaminate, jaccard  # noqa: E402
from lorekeep.llm.common import word_hashes  # noqa: E402

PAIRS = [("et536lxnaafaafap", "no2f1s0bdk8cv809"), ("g2vh9q27aaaaabra", "fgeu4v0ktgu55x8l"), ("cnvz2hc2appapafa", "k6nb4y3ub41j6k86")]
ONE, OTHER = (" ".join(p[k] for p in PAIRS) for k in (0, 1))


def hashes(word):
    return int(word_hashes(np.frombuffer(word.encode(), np.uint8), np.array([0]), np.array([len(word)]))[0])


def test_the_words_share_their_hashes():
    assert all(hashes(a) == hashes(b) for a, b in PAIRS)


def test_links_are_confirmed_on_words(spark):
    rows = [(1, f"{ONE} {ONE}"), (2, f"{OTHER} {OTHER}"), (3, f"{ONE} {ONE}".upper()), (4, f"{OTHER} {OTHER}\n"), (5, ONE), (6, OTHER)]
    got = jaccard.op8(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == brute.op8(rows)


def test_long_texts_are_compared_in_parts():
    a = " ".join(f"w{i}" for i in range(3000)).encode()
    for b in (a, a + b" x", a.replace(b"w1", b"v1"), a[:5000], b"", b"one two"):
        assert jaccard.linked(a, b, 1000) == jaccard.linked(a, b) == (100 * len(brute.shingle_set(a.decode()) & brute.shingle_set(b.decode())) >= 75 * len(brute.shingle_set(a.decode()) | brute.shingle_set(b.decode())) and bool(b))


def test_hits_are_confirmed_on_words(spark):
    ten = " ".join(f"b{i}" for i in range(10))
    items = [("a", f"{ONE} {ONE}"), ("b", f"{ten} {PAIRS[0][0]} {ten}"), ("c", f"{OTHER}")]
    docs = [(1, f"x {OTHER} {OTHER} y"), (2, f"x {ONE} {ONE}"), (3, f"{ten} {PAIRS[0][1]} {ten}"), (4, f"{ten} {PAIRS[0][0]} {ten}"), (5, f"z {PAIRS[1][0]}"), (6, f"{PAIRS[0][1]} {ten}")]
    got = decontaminate.op3(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    rows = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in got.collect()}
    assert rows == {1: (6, 1, True), 2: (6, 1, True), 3: (20, 1, True), 4: (21, 1, True), 5: (0, 0, False), 6: (10, 1, True)}
    for d, text in docs:
        assert rows[d][2] == brute.contaminated(text, [t for _, t in items])
