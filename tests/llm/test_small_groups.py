"""Outliers in groups too small for an estimate of their own."""

import random

from tallgrass.llm import quality

WORDS = [f"w{i}" for i in range(400)]


def test_small_groups_are_judged_by_a_pool(spark):
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(60, 240)))
    junk = lambda: " ".join(f"{rng.choice(WORDS)}###$$$" for _ in range(100))
    rows = [(i, plain(), "en", "a") for i in range(200)]
    # a tail of small sources of a known language, a language of few documents, and nulls: one plain and one of junk each
    tail = [("en", "b"), ("en", "c"), ("en", None), ("de", "a"), ("de", "z"), (None, "a"), (None, None)]
    rows += [x for k, g in enumerate(tail) for x in ((1000 + k, plain(), *g), (2000 + k, junk(), *g))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judged(df, "doc_id").collect()}
    assert len(kept) == len(rows)
    assert [k for k in range(len(tail)) if kept[2000 + k] or not kept[1000 + k]] == []


def test_few_documents_in_all(spark):
    words = " ".join(WORDS[:100])
    rows = [(i, f"{words} x{i}", "en", f"s{i}") for i in range(8)] + [(100, " ".join(f"{w}###$$$" for w in WORDS[:100]), "fr", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality.judged(df, "doc_id").where("kept").collect()} == set(range(8))
