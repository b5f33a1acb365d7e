"""Queries give their SQL's rows on inputs that the tables at hand don't hold."""

import duckdb

from tallgrass.plans.registry import ORACLES, QUERIES


def test_measures_of_odd_texts(spark, tmp_path):
    texts = [None, "", "\n", "a\n\n", "a\r\nb\r\n", "\r", " ", ".. code-block:: x", "code::", "APİ", "ToKen", "x\0y", *[f"x{chr(c)}y" for c in (*range(1, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF)]]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["f43_doc_measures"](spark, str(tmp_path)).collect())) == sorted(c.execute(ORACLES["f43_doc_measures"]).fetchall())
