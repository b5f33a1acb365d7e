"""The pipeline's near duplicates against every pair's exact Jaccard similarity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallgrass.llm import near_texts, simhash

WORDS = [f"w{i}" for i in range(400)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def roots(sets):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s == sets[j] or len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def varied(seed):
    """Texts and copies with words changed, at similarities about 0.8; chains; one hot group; odd ones."""
    rng = random.Random(seed)
    out = [None, "", " \n", "One", "one TWO", "ONE two", "a b c d e", "a B c d e"]
    for _ in range(25):
        t = [rng.choice(WORDS) for _ in range(rng.randint(60, 400))]
        out.append(" ".join(t))
        for _ in range(4):
            u = list(t)
            for _ in range(rng.randint(1, max(1, len(t) // 35))):
                u[rng.randrange(len(u))] = rng.choice(WORDS)
            out.append(" ".join(u))
            t = u if rng.random() < 0.5 else t
    hot = [rng.choice(WORDS) for _ in range(100)]
    return out + [" ".join([*hot[:k], f"x{k}", *hot[k + 1 :]]) for k in range(40)]


@pytest.mark.parametrize("group", [1024, 7])
def test_one_document_of_each_group(spark, group):
    t = varied(5)
    rows = [(1000 - i, x, "k") for i, x in enumerate(t)] + [(1000 - 20, t[20], "k"), (None, t[30], "k"), (None, "only here", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    root = roots([shingles(x) for _, x, _ in rows])
    want = sorted((min((rows[k][0] for k in range(len(rows)) if root[k] == r), key=lambda x: (x is None, x or 0)) for r in set(root)), key=str)
    out = near_texts.without_similar_texts(df, group)
    got = sorted((r.doc_id for r in out.collect()), key=str)
    # whole sets confirm each link, so that no group loses all its rows and none are joined; fingerprints may miss a pair
    assert out.columns == df.columns and set(want) <= set(got) and len(got) == len(set(got))
    assert len(got) - len(want) <= 0.03 * (len(rows) - len(want))
    assert near_texts.without_similar_texts(df.limit(0)).count() == 0


def test_stage_drops_what_four_or_more_bits_part(spark):
    rng = random.Random(2)
    t = [rng.choice(WORDS) for _ in range(200)]
    u = list(t)
    for k in (20, 70, 120, 170):
        u[k] = "other"
    df = spark.createDataFrame([(1, " ".join(t)), (2, " ".join(u)), (3, " ".join(t[:100] + u[:100:-1]))], "doc_id long, text string")
    assert (simhash.fingerprint(" ".join(t).encode()) ^ simhash.fingerprint(" ".join(u).encode())).bit_count() > 3
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3]


def test_similar_by_brute_force():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 60, 100, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 1 << 60, 4, dtype=np.uint64)])) for _ in range(60)]
    n = len(sets)
    assert near_texts.similar(sets, np.arange(n) + 1, np.full(n, n)).tolist() == roots([set(s.tolist()) for s in sets])


def test_shingle_sets_are_those_of_words():
    for t in [*varied(3), "x " * 50_000, "a b c d", "d c b a", "A\x0bB\x85c"]:
        assert len(near_texts.shingles((t or "").encode())) == len(shingles(t))
    assert near_texts.shingles(b"a b").tolist() != near_texts.shingles(b"b a").tolist()


def test_fingerprint_is_the_majority():
    for t in varied(4)[8:14]:
        s = near_texts.shingles(t.encode())
        hashes = [np.concatenate([np.array([int(near_texts._mixed(np.array([h], np.uint64) + near_texts._SALTS[p])[0]) >> (63 - b) & 1 for b in range(64)]) for p in range(near_texts.PARTS)]) for h in s]
        want = 2 * np.sum(hashes, axis=0) > len(s)
        got = np.unpackbits(near_texts.fingerprint(s).astype(">i8").view(np.uint8))
        assert (got == want).all()


def test_recall_of_pairs_near_the_threshold(spark):
    """Pairs alone, of a similarity of 0.8 to 0.9: those that are left are what the fingerprints miss; pairs below 0.8 stay."""
    rng = random.Random(8)
    rows, similar = [], {}
    for k in range(400):
        t = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(100, 300))]
        u = list(t)
        for _ in range(max(1, round(len(t) * rng.uniform(0.012, 0.026)))):
            u[rng.randrange(len(u))] = "other"
        a, b = shingles(" ".join(t)), shingles(" ".join(u))
        similar[k] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join(u))]
    kept = {r.doc_id for r in near_texts.without_similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in similar)
    assert all(2 * k + 1 in kept for k, j in similar.items() if j < 0.8)
    near = [k for k, j in similar.items() if j >= 0.8]
    assert len(near) > 150 and sum(2 * k + 1 not in kept for k in near) >= 0.95 * len(near)


def test_a_round_of_components_counts_nothing_apart(spark):
    """What a round needs to know is seen while it writes: each further job leaves its plan and its broadcasts to the driver."""
    links = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.jobsList(None).size()
    tree = simhash.components(links)
    assert store.jobsList(None).size() - before < 100
    assert {(r.node, r.root) for r in tree.collect()} == {(k, 0) for k in range(1, 60)}
    assert simhash.components(links.where("a < 0")).count() == 0


def test_filed_rows_are_never_broadcast(spark):
    """Spark sizes the rows of an explode as if there were one for each fingerprint, so that it might broadcast them or their keys."""
    reps = spark.range(5000).select(F.xxhash64("id").alias("fp"), F.xxhash64("id", "id").alias("s0"), F.xxhash64("id", "id", "id").alias("s1"))
    found = near_texts.candidate_links(reps, near_texts.RADIUS, masks=near_texts.drawn_masks(), bits=near_texts.BITS)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
