"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tallgrass.llm import ranked_search as search

DOCS = "doc_id long, text string, rank int, score string"


def terms(text):
    return re.findall(search.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t, *_ in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        found = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, c in Counter(terms(text)).items() if t in b)
            found += [(-score, i is None, i)] * (score > 0)
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:k])]
    return sorted(map(str, out))


def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Été", "MIXED", "x1y", "日本", "😀"]
    made = [(i, " ".join(rng.choices(words, range(65, 0, -1), k=rng.choice((1, 5, 40)))), 0, "s") for i in range(300)]
    made += [(1000 + i, "same-text; w3 W3", 1, "t") for i in range(25)] + [(1003, "same-text; w3 W3", 1, "t")] * 3  # ties and repeated rows
    made += [(None, "same text w3 w3", 2, None), (5, None, 0, ""), (6, "", 0, ""), (7, "... !", 0, ""), (8, "w5," * 30_000 + "late", 0, "")]
    items = [(1, "w3 w3 same"), (2, "w59, W58 été ÉTÉ"), (3, "MIXED mixed 日本 😀 x1y"), (4, None), (5, "..."), (6, "nowhere"), (7, " ".join(words)), (7, "late"), (1, "w3 w3 same"), (None, "text")]
    return made, items


@pytest.mark.parametrize("shard_bytes, block_terms, dense, k", [(1 << 22, 200_000, 4 << 20, 10), (700, 5, 1, 10), (2000, 60, 100, 3)])
def test_ranking_by_brute_force(spark, monkeypatch, shard_bytes, block_terms, dense, k):
    monkeypatch.setattr(search, "DENSE", dense)
    docs, items = rows()
    df, asked = spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(items, "item_id long, text string")
    index = search.build_index(df, shard_bytes=shard_bytes)
    got = search.search(index, asked, k, block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(docs, items, k)


def test_index_written_and_opened(spark, tmp_path):
    docs, items = rows()
    search.build_index(spark.createDataFrame(docs, DOCS), str(tmp_path / "index"))
    index = search.read_index(spark, str(tmp_path / "index"))
    got = search.search(index, spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(docs, [(str(i), t) for i, t in items])


def test_pieces_of_a_long_text():
    text = b"ab cd" * 50 + b"x" * 100 + b" end."
    for most in (1, 7, 64, 1000):
        assert [w for piece in search._pieces(text, most) for w in piece] == search.split_words(text)


def test_nothing_to_find(spark):
    docs, items = rows()
    df, asked = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert search.search(search.build_index(df.limit(0)), asked).count() == 0
    assert search.search(search.build_index(df), asked.limit(0)).count() == 0
    assert search.search(search.build_index(df.where("text is null or text in ('', '... !')")), asked).count() == 0


def test_row_groups_are_a_few_shards(spark, monkeypatch, tmp_path):
    """Spark holds a row group whole to write or read it."""
    monkeypatch.setattr(search, "GROUP_BYTES", 10_000, raising=False)
    docs, _ = rows()
    search.build_index(spark.createDataFrame(docs, DOCS).coalesce(1), str(tmp_path / "index"), shard_bytes=700)
    groups = [meta.row_group(k) for f in (tmp_path / "index").glob("*.parquet") for meta in [pq.ParquetFile(f).metadata] for k in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 20 and max(g.num_rows for g in groups) < 15


@pytest.mark.parametrize("most", [1, 3, 1 << 20])
def test_terms_are_counted_over_cuts(most):
    for text in ("", "a", " a", "a ", "ab, cdé 日本-x", "...", "😀😀 1_2"):
        assert search.term_count(text.encode(), most) == len(terms(text))
