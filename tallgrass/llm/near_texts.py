"""Texts of a Jaccard similarity of 0.8 or more over 5-word shingles: wide SimHash fingerprints propose, whole sets confirm.

This is `simhash` with a setting of its own: A-Z are lower-cased and words are as there; a text is the set of its `WORDS`-word
shingles (a text of fewer words is one shingle; of none, the set is empty); its fingerprint has `64 x PARTS` bits, each set if
it is in over half of the set's hashes. Two texts are linked if their sets' Jaccard similarity is `SIMILARITY` or more, and
documents are grouped by what they reach over links.

At a similarity of 0.8 a fingerprint's bits differ with a probability of 0.152 (the angle between the sets), so a radius that
five parts of 64 bits could find would miss nearly all such pairs. Here a fingerprint is filed under `KEYS` keys, each of
`DRAWN` bits drawn from all of them by a fixed seed; those filed together are compared bit plane by bit plane within `RADIUS`
(3 standard deviations above the mean at 0.8, 6 below that of unrelated texts). Computed recall of a pair: 0.96 at a
similarity of 0.8, 0.99 at 0.85, 0.998 at 0.9; a group is found where any chain of its pairs is. A file holds about
n / 2^DRAWN of n different texts; a corpus of over 10^9 texts should draw 24 bits and file 200 keys (recall 0.93 at 0.8).

Texts joined by such candidates, directly or over others, form a cluster; within it, every two sets whose fingerprints are
within the radius are compared exactly, whether or not they shared a file. Equal sets count once. In a cluster of more than
`GROUP` sets or `SHINGLES` shingles those similar to its smallest member are linked to that and meet the others alone.

Null and empty texts have the empty set and form a group. A very long text is one row of its set of hashes, 8 bytes a word.
A null doc_id stays null. Rows that share a doc_id are judged each by its text. Empty tables give an empty result. Further
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tallgrass.llm.common import fresh, materialise, row_digest, small_batches
from tallgrass.llm.simhash import SEED, candidate_links, components, dealt, links, tasks_of

WORDS = 5
SIMILARITY = 0.8
PARTS = 2
RADIUS = 32
DRAWN = 16
KEYS = 80
#: Sets, and shingles in all, that are compared in one task.
GROUP = 1024
SHINGLES = 1 << 20
BITS = tuple(f"s{k}" for k in range(PARTS))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(1, PARTS + 1, dtype=np.uint64) * _BASE


class _Hashes(dict):
    """XXH64 of words, bounded: it starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest as digest

        if len(self) >= 200_000:
            self.clear()
        h = self[word] = digest(word, SEED)
        return h


_HASHES = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of hashes of a text's shingles, each of its words' hashes and their order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(_HASHES.__getitem__, words)), np.uint64)
    size = min(WORDS, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        out = out * _BASE + h[k : len(h) - size + 1 + k]
    return np.unique(_mixed(out))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The fingerprint's words, as signed integers."""
    counts = np.zeros(64 * PARTS, np.int64)
    for k in range(0, len(found), 1 << 14):
        part = found[k : k + (1 << 14)]
        raw = np.stack([_mixed(part + salt) for salt in _SALTS], axis=1).astype(">u8")
        bits = np.unpackbits(raw.view(np.uint8).reshape(len(part), 8 * PARTS), axis=1)
        full = len(bits) // 255 * 255
        counts += bits[full:].sum(axis=0, dtype=np.int64)
        if full:
            counts += np.add.reduce(bits[:full].reshape(-1, 255, 64 * PARTS), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(found)).view(">i8").astype(np.int64)


def drawn_masks(keys: int = KEYS, drawn: int = DRAWN) -> list[tuple[int, ...]]:
    """For each key the masks of the bits drawn for it, by part."""
    rng, out = np.random.default_rng(SEED), []
    for _ in range(keys):
        chosen = rng.choice(64 * PARTS, drawn, replace=False).tolist()
        out.append(tuple(sum(1 << (b % 64) for b in chosen if b // 64 == p) for p in range(PARTS)))
    return out


def signatures(docs: DataFrame, *keep: str, sets: bool = False) -> DataFrame:
    """The columns `keep`, fp (a hash of the shingle set), n (its size), the fingerprint's words, and the set if asked for."""
    small_batches(docs.sparkSession)
    names = [*keep, "fp", "n", *BITS, *["shingles"] * sets]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_digest as digest

        for b in batches:
            found = [shingles(t.as_py() or b"") for t in b.column(0).cast(pa.binary())]
            fps = np.frombuffer(b"".join(digest(s.tobytes(), SEED) for s in found), ">i8").astype(np.int64)
            words = np.array([fingerprint(s) for s in found], np.int64).reshape(-1, PARTS)
            sizes = np.array([len(s) for s in found], np.int64)
            cols = [pa.array(fps), pa.array(sizes), *(pa.array(c) for c in words.T)]
            if sets:
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=names)

    made = [StructField(c, LongType()) for c in ("fp", "n", *BITS)] + [StructField("shingles", ArrayType(LongType()))] * sets
    return docs.select("text", *keep).mapInArrow(signed, StructType([docs.schema[c] for c in keep] + made))


def similar(sets: list[np.ndarray], low: np.ndarray, high: np.ndarray, words: np.ndarray | None = None, similarity: float = SIMILARITY, radius: int = RADIUS) -> np.ndarray:
    """For each set the smallest one that it reaches over links with others in [low, high) of its row."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64)
    starts, width = np.cumsum(sizes) - sizes, int(ids.max(initial=0)) + 1
    tagged = ids + np.repeat(np.arange(n), sizes) * width  # sorted: which set has which shingle
    label = np.arange(n)

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        swap = sizes[a] > sizes[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out, k = np.zeros(len(a), bool), 0
        ends = np.cumsum(sizes[a])
        while k < len(a):  # in portions of about a million shingles
            to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + (1 << 20), side="right")))
            each = sizes[a[k:to]]
            at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[a[k:to]], each)
            want = ids[at] + np.repeat(b[k:to] * width, each)
            found = np.minimum(np.searchsorted(tagged, want), len(tagged) - 1)
            common = np.bincount(np.repeat(np.arange(to - k), each), weights=tagged[found] == want, minlength=to - k)
            out[k:to] = common >= similarity * (sizes[a[k:to]] + sizes[b[k:to]] - common)
            k = to
        return out

    for a, b in links(np.array([fingerprint(s) for s in sets]).view(np.uint64) if words is None else words, low, high, radius):
        fits = (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])) & (sizes[a] > 0) & (sizes[b] > 0)
        a, b, some = a[fits], b[fits], 1
        while True:  # of each set a few pairs first: what they join needs no further look
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if not len(a):
                break
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            now = rank < some
            x, y = a[now], b[now]
            good = linked(x, y)
            for p, q in zip(x[good].tolist(), y[good].tolist(), strict=True):
                p, q = int(label[p]), int(label[q])
                if p != q:
                    label[label == max(p, q)] = min(p, q)
            a, b, some = a[~now], b[~now], 2 * some
    return label


def similar_links(clustered: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) within the clusters of clustered (root, fp, n, fingerprint, shingles): a spanning forest for each two pieces of one."""
    rows = clustered.withColumn("load", F.greatest(F.lit(1.0 / group), F.col("n") / SHINGLES))
    files = rows.groupBy("root").agg(F.sum("load").alias("load"))
    heads = clustered.where("fp = root").select("root", F.col("fp").alias("h_fp"), F.col("shingles").alias("h_shingles"))
    rows, found = dealt(rows, files, "root", _similar("shingles", "h_shingles"), heads, *BITS, "shingles")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, edge, size, low, high in tasks_of(batches, 256):
            fp, raw, words = cols[4], cols[-1], np.stack(cols[5:-1], axis=1).view(np.uint64)
            for x, m in zip(edge.tolist(), size.tolist(), strict=True):
                own = slice(x, x + m)
                reached = similar([np.asarray(s, np.int64).view(np.uint64) for s in raw[own]], low[own] - x, high[own] - x, words[own])
                child = np.flatnonzero(reached != np.arange(m))
                yield pa.RecordBatch.from_arrays([pa.array(fp[own][child]), pa.array(fp[own][reached[child]])], names=["a", "b"])

    out = rows.mapInArrow(compared, "a long, b long")
    return (out if found is None else out.union(found)).distinct()


def _similar(a: str, b: str) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common >= SIMILARITY * (F.size(a) + F.size(b) - common)


def _with_roots(tree: DataFrame) -> DataFrame:
    return tree.select(F.col("node").alias("fp"), "root").union(tree.select(F.col("root").alias("fp"), "root").distinct())


def without_similar_texts(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """docs with one row of each group: one of the smallest doc_id there, null last, and of such rows the one of smallest digest."""
    none, number, digest = fresh(docs, "key_none"), fresh(docs, "key_number"), fresh(docs, "key_digest")
    marked = docs.withColumns({number: F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), digest: row_digest("doc_id", "text")})
    signed = materialise(signatures(marked.withColumn(none, F.col("doc_id").isNull()), none, number, digest), "signatures")
    first = F.min(F.struct(F.col(none).alias("none"), F.col(number).alias("number"), F.col(digest).alias("digest"), "n", *BITS))
    sets = materialise(signed.groupBy("fp").agg(first.alias("x")).select("fp", "x.*"), "sets")

    near = candidate_links(sets.where("n > 0").select("fp", *BITS), RADIUS, group=2 * group, masks=drawn_masks(), bits=BITS)
    clusters = _with_roots(components(near)).join(sets.select("fp", "number", "digest"), "fp")
    clusters = materialise(clusters.select("root", F.col("number").alias(number), F.col("digest").alias(digest)), "clusters")
    # equal rows repeat; one is enough
    texts = marked.select("text", number, digest).join(clusters, [number, digest])
    clustered = materialise(signatures(texts, "root", sets=True).dropDuplicates(["fp"]), "clustered")

    roots = materialise(_with_roots(components(similar_links(clustered, group))), "roots")
    grouped = sets.select("fp", "none", "number", "digest").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = grouped.groupBy("root").agg(F.min(F.struct("none", "number", "digest")).alias("best"))
    kept = best.select(F.col("best.number").alias(number), F.col("best.digest").alias(digest))
    return marked.join(kept, [number, digest], "left_semi").dropDuplicates([number, digest]).select(*docs.columns)
