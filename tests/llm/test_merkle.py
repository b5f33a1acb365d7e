"""The Merkle manifest against a plain version, in every way of building the upper tree."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallgrass.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]])


def tree(nodes, fan):
    """Each node's siblings, level by level, and the root."""
    found, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(at)):
            run = at[k] // fan * fan
            found[k] += nodes[run : at[k]] + nodes[at[k] + 1 : run + fan]
        nodes = [h(*nodes[k : k + fan]) for k in range(0, len(nodes), fan)]
        at = [k // fan for k in at]
    return found, nodes[0]


def plain(rows, fan):
    """doc_id, leaf, subroot, root, proof_sha256 of each row."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        own[s] = tree([leaf(r) for r in by[s]], fan)
    above, root = tree([own[s][1] for s in sources], fan)
    return sorted(str((r[0], leaf(r), own[s][1], root, h(*found, *up))) for s, up in zip(sources, above, strict=True) for r, found in zip(by[s], own[s][0], strict=True))


def rows_of(counts):
    rows = [(k, s, "en", k % 3 or None, f"Text {s} {k} é", "x", 1) for s, n in counts.items() for k in range(n)]
    rows += [(None, None, None, None, None, "y", 2), (7, "s1", "de", 5, "", "z", 3), (7, "s1", "de", 5, "", "z", 3), (7, "s1", "de", 5, "Ä" * 50_000, "z", 3)]
    return rows + [(-3, "ünder", "", 0, "A-Z", "", None), (None, "s1", "", None, "null id", "", 4)]


@pytest.mark.parametrize("fan, levels, top", [(16, 3, 4096), (16, 1, 4), (2, 2, 1), (3, 1, 8)])
def test_manifest_by_brute_force(spark, fan, levels, top):
    rows = rows_of({"s1": 40, "s2": 17, "s3": 16, "s4": 1, "S": 2})
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = merkle.proofs(df, "doc_id", "leaf", "root", "text", fan=fan, levels=levels, top=top)
    assert out.columns == ["doc_id", "leaf", "root", "text", "_leaf", "path", "subroot", "_root"]  # own columns step aside
    got = out.withColumn("proof", merkle.siblings(F.col("path"))).withColumn("folded", merkle.folded(F.col("_leaf"), F.col("path"))).collect()
    assert sorted(str((r.doc_id, r._leaf, r.subroot, r._root, r.proof)) for r in got) == plain(rows, fan)
    assert all(r.folded == r._root for r in got)
    assert sorted(str((r.doc_id, r.leaf, r.root, r.text)) for r in got) == sorted(str((r[0], r[5], r[6], r[4])) for r in rows)


def test_blocks_of_a_large_source(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 40}", "en", k, f"t{k}", "", 0) for k in range(9000)]
    got = merkle.proofs(spark.createDataFrame(rows, SCHEMA), "doc_id", top=5).withColumn("proof", merkle.siblings(F.col("path"))).collect()
    assert sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof)) for r in got) == plain(rows, 16)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "s", "l", 1, "t", "", 0)], SCHEMA)
    r = merkle.proofs(one, "doc_id").first()
    assert r.leaf == r.subroot == r.root == leaf((1, "s", "l", 1, "t")) and r.path == []
    assert merkle.proofs(one.limit(0), "doc_id").count() == 0


def test_query_finds_what_was_tampered_with(spark, tmp_path):
    rows = rows_of({"s1": 60, "s2": 5})
    spark.createDataFrame(rows, SCHEMA).drop("leaf", "root").write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()
    import zlib

    assert len(got) == len(rows)
    assert sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256)) for r in got) == plain(rows, 16)
    text = {leaf(r): r[4] for r in rows}
    for r in got:
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        lowered = text[r.leaf] is not None and any("A" <= c <= "Z" for c in text[r.leaf])
        assert r.verified == (r.folded_root == r.root) == (not (changed and lowered))
