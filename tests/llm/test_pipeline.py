"""The pipeline's stages, one after another, against plain versions of each on the smallest tables."""

import os

import numpy as np
import pytest

import corpus_pipeline
from tallgrass.llm import quality
from tallgrass.llm.common import materialise
from tallgrass.llm.tokens import Encoder, tokenizer_path
from tests.llm import brute
from tests.llm.test_corpus import distances
from tests.llm.test_near_texts import roots, shingles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, rows, out = docs.columns, {r.doc_id: r for r in docs.collect()}, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "token output"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, SF), "test")
        out[name] = docs.collect()
        if k < 4:
            assert docs.columns == names and all(r == rows[r.doc_id] for r in out[name])
    ids = lambda name: sorted(r.doc_id for r in out[name])
    far = distances([(r.doc_id, r.text, r.lang, r.source) for r in rows.values()])
    good = sorted(i for i, d in far.items() if d <= quality.chi2_quantile(quality.CUTOFF, 4))
    assert ids("quality rules") == good and len(good) < len(far)  # the method rejects some that pass the base rules
    single = sorted({good[r] for r in roots([shingles(rows[i].text) for i in good])})
    assert ids("near duplicates") == single and len(single) < len(good)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [i for i in single if not brute.decontaminated(rows[i].text, items)[4]]
    assert ids("decontamination") == clean
    sizes, words = {}, {i: len(rows[i].text.split()) for i in clean}
    for i in clean:
        sizes[rows[i].source] = sizes.get(rows[i].source, 0) + words[i]
    want, got = brute.targets(sizes), dict.fromkeys(sizes, 0)
    mixed = ids("mixing")
    for i in mixed:
        got[rows[i].source] += words[i]
    assert set(mixed) <= set(clean) and max(map(mixed.count, mixed)) <= 2
    for s in sizes:
        assert abs(got[s] - want[s]) <= max(words[i] for i in clean if rows[i].source == s) / 2 + 1
    coder, start = Encoder(tokenizer_path()), 0
    for r, i in zip(sorted(out["token output"], key=lambda r: r.start), mixed, strict=True):
        tokens = [*np.frombuffer(coder.library([rows[i].text])[0], np.uint32).tolist(), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(tokens), brute.crc(tokens))
        start += len(tokens)


def test_run_is_the_stages(spark):
    first, again = (sorted(map(str, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert first == again and first


def test_odd_documents_pass_all_stages(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, None, None, 7, "k"), (1, text, None, None, 7, "k"), (None, text + " more", "en", "a", None, None), (2, None, "en", "a", 0, "k"), (3, "", "en", "b", 0, "k"), (4, "x " * 200_000 + text, "en", "a", 1, "k")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key_number string"
    for name, n in (("some", len(rows)), ("none", 0)):
        spark.createDataFrame(rows[:n], schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert {r.doc_id for r in got} <= {1, None} and got
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
