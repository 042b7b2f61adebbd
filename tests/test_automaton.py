"""Many words and patterns in one pass, against looking for each of them."""

import re

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import signal
from lorekeep.functions.text import STOP_WORDS
from lorekeep.operators import automaton, search

TEXTS = ["blue anvil and anvils", "", None, "BLUE", "a" * 5000 + "anvil", "nothing here", "ünïcode anvil", "blu e"]


@pytest.mark.parametrize("block", [1 << 20, 12])
def test_skill_matches(spark, block):
    messages = spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string")
    skills = [("Blue", "an anvil"), ("x", "here that"), ("anvil", None), ("other", "abc defg"), ("Blue", "an anvil")]
    got = search.skill_matches(messages, spark.createDataFrame(skills, "name string, description string"), block)
    want = set()
    for i, t in enumerate(TEXTS):
        for name, text in skills:
            words = {name.lower()} | {w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) >= 4 and w not in STOP_WORDS}
            if t and any(w in t.lower() for w in words):
                want.add((i, name))
    assert sorted((r["id"], r["name"]) for r in got.collect()) == sorted(want)


def test_needed_literals():
    assert signal.needed_literals(r"\bi (need|want) to (think|figure)") == ("figure", "think")
    assert signal.needed_literals(r"[!]") == ("!",) and signal.needed_literals(r"\b\d+(\.\d+)?") is None and signal.needed_literals(r"colou?r") == ("colo",)
    assert signal.needed_literals(r"(a|)b*") is None
    for p, need in signal.NEEDED.items():
        assert all(x and x == x.lower() for x in need), p


def test_patterns_run_only_where_a_literal_is(spark):
    """measured() gives what the scores without the literals give, on sentences that fit each pattern's words and on others."""
    words = [x for x in signal.LITERALS]
    texts = ["", "Honestly, I noticed that the bug is on line 12! Yeah.", *[f"So {a} {b}." for a, b in zip(words, words[7:] + words[:7])], *[" ".join(words[i::9]).upper() for i in range(9)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: (r["embodiment"], r["clarity"]) for r in signal.measured(df).collect()}
    t = F.col("text")
    plain = {r["id"]: r for r in df.select("id", signal.embodiment(t).alias("e"), signal.clarity(t).alias("c"), signal.jargon_density(t).alias("j")).collect()}
    for i, r in plain.items():
        assert got[i][1] == pytest.approx(r["c"])
        if r["j"] <= 0.15:
            assert got[i][0] == pytest.approx(r["e"])


def test_found_words_of_nothing(spark):
    none = spark.createDataFrame([], "word string")
    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    assert automaton.found_words(texts, none)[0].count() == 0


def test_holders():
    """How many lists hold any of some numbers, of which some stand in many lists and others in few, asked for in parts."""
    import random

    import numpy as np
    import pyarrow as pa

    r = random.Random(3)
    for size in (0, 1, 64, 499, 500):
        lists = [r.sample(range(300), r.randint(0, 3)) + [10**12] * (r.random() < 0.3) for _ in range(size)]
        holders = automaton.Holders(pa.array(lists, pa.list_(pa.int64())))
        for _ in range(100):
            parts = [r.sample([*range(300), 10**12, 10**13, -1], r.randint(1, 9)) for _ in range(r.randint(1, 3))]
            found = [(holders.of if size % 2 else holders.found)(np.array(x, np.int64).tobytes()) for x in parts]
            mask = 0
            for x, _ in found:
                mask |= x
            assert holders.count(mask, [p for _, places in found for p in places]) == sum(any(not set(x).isdisjoint(own) for x in parts) for own in lists)
