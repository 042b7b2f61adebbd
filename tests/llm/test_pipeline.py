"""The pipeline's stages against plain versions, each on its own input."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from lorekeep.llm import quality  # noqa: E402
from lorekeep.llm.common import stored, table  # noqa: E402


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_equal_plain_versions(spark, sf):
    docs = table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_filter", "near_duplicates", "repeated_substrings", "decontamination", "source_mix"]

    good = stored(stages["quality_filter"](spark, docs, sf))
    op4 = quality.op4(spark, docs, table(spark, sf, "labels"))
    assert set(texts(good)) == {r["doc_id"] for r in op4.where("predicted = 1").collect()} and good.columns == docs.columns

    single = stored(stages["near_duplicates"](spark, good, sf))
    assert set(texts(single)) == {d for d, _, c in brute.op8(list(texts(good).items())) if d == c} and single.columns == docs.columns

    cut = stored(stages["repeated_substrings"](spark, single, sf))
    want = {d: bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore") for d, b, gone in brute.repeats(list(texts(single).items()))}
    before = texts(single)
    assert texts(cut) == {d: t for d, t in want.items() if t or not before[d]} and cut.columns == docs.columns
    assert cut.where("n_chars <> length(text)").count() == 0

    clean = stored(stages["decontamination"](spark, cut, sf))
    items = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    assert texts(clean) == {d: t for d, t in texts(cut).items() if not brute.contaminated(t, items)} and clean.columns == docs.columns

    mix = stages["source_mix"](spark, clean, sf)
    got = sorted(tuple(r) for r in mix.select("doc_id", "size", "taken").collect())
    assert [d for d, _, _ in got] == sorted(texts(clean)) and all(t <= 3 * n for _, n, t in got)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "size", "taken").collect()) == got


def test_empty_and_odd_tables(spark, sf):
    docs = table(spark, sf, "documents")
    odd = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (-5, "", "en", None, 0)], docs.schema))
    for rows in (docs.where("false"), odd):
        kept = rows
        for _, stage in corpus_pipeline.STAGES:
            kept = stored(stage(spark, kept, sf))
        assert kept.count() <= rows.count()
