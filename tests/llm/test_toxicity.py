"""Toxicity: savings against compressing window by window, held-out accuracy, and odd inputs."""

import random
import zlib

import numpy as np
import pytest
import zstandard

from tallgrass.llm import toxicity

DOCS, LABELS = "doc_id long, text string, lang string, source string, score string", "doc_id long, quality int, toxic int"


def corpus(n, seed=1, bad=("loathsome", "vermin", "wretch", "imbecile")):
    """Texts of made-up words; a third hold some bad ones. Labels are of these, without error."""
    rng = random.Random(seed)
    parts = ["the", "an", "er", "tion", "ou", "st", "li", "mo", "ra", "ke", "ing", "ble"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(30, 200))]
        toxic = int(i % 3 == 0)
        for _ in range(toxic * rng.randint(3, 8)):
            words.insert(rng.randint(0, len(words)), rng.choice(bad).upper() if rng.random() < 0.2 else rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s", "x"))
        labels.append((i, 1, toxic))
    return rows, labels


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def made(spark):
    rows, labels = corpus(1500)
    df, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    return rows, {i: t for i, _, t in labels}, df, known, toxicity.fit(df, known)


def test_held_out_accuracy(spark, made):
    rows, label, df, _, model = made
    got = {r.doc_id: r.score for r in toxicity.scored(df, model, "doc_id").collect()}
    held = [i for i in got if fold(i)]
    assert len(got) == len(rows) and len(held) > 200
    right = [(got[i] >= 0.5) == (label[i] == 1) for i in held]
    assert np.mean(right) > 0.97
    assert all(0 <= s <= 1 for s in got.values())


def test_labels_of_the_held_out_fold_are_not_used(spark, made):
    _, label, df, _, model = made
    flipped = spark.createDataFrame([(i, 0, 1 - t if fold(i) else t) for i, t in label.items()], LABELS)
    again = toxicity.fit(df.repartition(7), flipped)
    assert (again.ordinary, again.toxic, again.threshold) == (model.ordinary, model.toxic, model.threshold)
    assert np.allclose(again.weights, model.weights)


def test_savings_by_single_compressions(made):
    model, rng = made[4], random.Random(5)
    both = toxicity.Savings(model.ordinary, model.toxic)
    texts = [b"x", b"", b"Loathsome WRETCH", made[0][0][1].encode(), bytes(rng.randrange(256) for _ in range(1000)), b"a" * 64, b"b" * 65, b"c" * 112, b"d" * 113]
    how = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=64, dict_size=len(model.ordinary + model.toxic), min_match=4, write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    raw = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for d in (model.ordinary, model.toxic + model.ordinary)]
    for t in texts:
        low = b' ' * bool(t) + bytes(c + 32 if 65 <= c <= 90 else c for c in t) + b' ' * bool(t)
        windows = [low[k : k + 64] for k in range(0, max(1, len(low) - 16), 48)] if low else []
        assert not low or b"".join(w[: 48 if k < len(windows) - 1 else 64] for k, w in enumerate(windows)) == low  # no byte is left out
        assert both(t).tolist() == ([len(raw[0].compress(w)) - len(raw[1].compress(w)) for w in windows] or [0])


def test_contexts_count_copies_once():
    grams, n = toxicity.contexts([b"what a wretch he is"] * 50 + [b"some other wretch there"])
    count = {int(g).to_bytes(5, "big"): int(c) for g, c in zip(grams, n, strict=True)}
    assert count[b"wretc"] == 2 and count[b"what "] == 1
    plain, bad = [b"people are kind today and so on %d" % i for i in range(40)], [b"%d you wretch %d" % (i, i * i) for i in range(40)]
    found = toxicity.telling(plain, bad)
    assert b"wretch" in b"".join(toxicity.parts(b"oh wretch, no", found)) and toxicity.parts(b"people are kind", found) == []


def test_odd_rows(spark, made):
    *_, known, model = made
    long = "the ing tion " * 300_000
    rows = [(1, None, None, None, "a"), (2, "", None, None, "b"), (None, "you vermin, loathsome wretch and imbecile", "en", "s", "c"), (3, long, "en", "s", None), (3, "same", "", "", "d"), (3, "same", "", "", "d")]
    got = toxicity.scored(spark.createDataFrame(rows, DOCS), model, "doc_id", "source", "text").collect()
    assert sorted(str((r.doc_id, r.source, r.text)) for r in got) == sorted(str((i, s, t)) for i, t, _, s, _ in rows)
    by = {r.text: r.score for r in got}
    assert by[None] == by[""] < 0.5 and by["you vermin, loathsome wretch and imbecile"] > 0.5 and by[long] < 0.5
    assert len({r.score for r in got if r.text == "same"}) == 1
    assert toxicity.scored(spark.createDataFrame([], DOCS), model, "doc_id").count() == 0


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(k, 1, 0) for k in range(9)], 0.0), ([(k, 1, 1) for k in range(9)], 1.0), ([(None, 1, 1), (1, None, None), (2, 1, 7)], 0.0), ([(k, 0, k % 2) for k in range(4)], None)])
def test_few_labels(spark, labels, score):
    rows = [(k, f"some text {k}", "en", "s", "") for k in range(12)]
    df = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(df, spark.createDataFrame(labels, LABELS))
    got = [r.score for r in toxicity.scored(df, model, "doc_id").collect()]
    assert len(got) == 12 and (all(0 <= s <= 1 for s in got) if score is None else set(got) == {score})


def test_query(spark, made, tmp_path):
    rows, _, df, known, _ = made
    df.drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op12_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.held_out == fold(r.doc_id) and r.predicted == (r.score >= 0.5) for r in got)
