"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Text is normalised by lower-casing A-Z and taking the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A benchmark item gives
all its windows of `n` consecutive words, or, where it has fewer words but some, one window of them all. The n-grams go
to the executors as a map from a 64-bit rolling hash to the windows that have it. Each document is scanned once for each
window length: a rolling hash over vocabulary numbers proposes windows, the words themselves confirm them.

A broadcast holds `BLOCK_WORDS` benchmark words at most, 16 bytes each and their vocabulary: items are filled into blocks one
after another, and an item longer than a block is cut into parts that share their border windows. A benchmark of one block
takes one scan and nothing else. Of more blocks each takes a scan that writes what it hits alone (keys, spans and items, no
texts); hits are then merged by document and joined to the documents once, by broadcast while they are few. So the result is
the same for a benchmark of any size, and the scans are as many as its blocks.

Null and empty texts have no words, no hits, and are not contaminated. An empty benchmark hits nothing. Items that repeat
count once by item_id; an item without item_id marks words as hit, and counts as an item whose id is the empty string.
Repeated documents are judged each for themselves; further columns are passed through `scan` untouched. A very long text is
scanned whole, in memory of a few times its size, and Arrow batches are bounded by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tallgrass.llm.common import LOWER, UPPER, bounded, documents, fresh, materialise, row_digest, small_batches

WINDOW = 13
#: The benchmark words that one broadcast may hold.
BLOCK_WORDS = 2_000_000
#: A document is contaminated if this many times its hit words reach its words.
SHARE = 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Grams:
    """The n-grams of parts of benchmark items (item, words): for each window length the sorted hashes of its windows, and where each stands."""

    def __init__(self, parts: list[tuple[str, list[bytes]]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.items = sorted({item for item, _ in parts})
        place = {item: k for k, item in enumerate(self.items)}
        lengths = np.array([len(words) for _, words in parts], np.int64)
        self.tokens = np.array([number(w, len(self.vocabulary) + 1) for _, words in parts for w in words], np.uint32)
        owner = np.repeat(np.array([place[item] for item, _ in parts], np.uint32), lengths)
        size = np.repeat(np.minimum(lengths, n), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(self.tokens))  # words from here to the part's end
        self.by_length = {}
        for k in np.unique(size).tolist():
            at = np.flatnonzero((size == k) & (left >= k))
            hashes = rolling(self.tokens.astype(np.uint64), k)[at]
            order = np.argsort(hashes, kind="stable")
            self.by_length[k] = (hashes[order], at[order].astype(np.uint32), owner[at[order]])

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items whose windows occur."""
        hit, items = np.zeros(len(words), bool), set()
        ids = np.array(list(map(self.vocabulary.get, words, repeat(0))), np.uint64)
        for size, (hashes, at, owner) in self.by_length.items():
            if len(ids) < size:
                continue
            unknown = np.concatenate(([0], np.cumsum(ids == 0)))
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])  # windows of known words only
            if not len(starts):
                continue
            got = rolling(ids, size)[starts]
            low = np.searchsorted(hashes, got)
            near = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == got)
            high = np.searchsorted(hashes, got[near], side="right")
            for i, lo, hi in zip(starts[near].tolist(), low[near].tolist(), high.tolist(), strict=True):
                same = (self.tokens[at[lo:hi, None].astype(np.int64) + np.arange(size)] == ids[i : i + size]).all(axis=1)
                if same.any():
                    hit[i : i + size] = True
                    items.update(owner[lo:hi][same].tolist())
        return hit, {self.items[k] for k in items}


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash, modulo 2 to the 64, of each window of ids."""
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        out = out * _BASE + ids[k : len(ids) - size + 1 + k]
    return out


def spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words, ends exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


HIT = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
_HIT = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def blocks(items: Iterator[tuple[str, list[bytes]]], n: int, most: int) -> Iterator[Grams]:
    """The items' n-grams in blocks of at most `most` words (or n, if that is more)."""
    most, held, size = max(most, n), [], 0
    for item, words in items:
        for at in range(0, max(1, len(words) - n + 1), most - n + 1):
            part = words[at : at + most]
            if held and size + len(part) > most:
                yield Grams(held, n)
                held, size = [], 0
            held.append((item, part))
            size += len(part)
    yield Grams(held, n)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_words: int = BLOCK_WORDS, result: str = "hits", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, or all) and a column `result`: n_words, the hit words as spans of word numbers, and the items hit, sorted."""
    spark, keep = docs.sparkSession, keep or docs.columns
    small_batches(spark)
    bench = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("body")).distinct()
    each = blocks(((r["item"], split_words(r["body"].encode())) for r in bench.toLocalIterator()), n, block_words)
    first, second = next(each), next(each, None)
    if second is None:
        return _pass(docs, spark.sparkContext.broadcast(first), result, keep)
    number, digest, hits = fresh(docs, "key_number"), fresh(docs, "key_digest"), fresh(docs, "part_hits")
    keyed = docs.withColumns({number: F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), digest: row_digest("doc_id", "text")})
    parts = None
    for grams in chain((first, second), each):
        shared = spark.sparkContext.broadcast(grams)
        part = _pass(keyed, shared, hits, [number, digest]).where(F.size(f"{hits}.spans") > 0)
        part = materialise(part.select(number, digest, f"{hits}.*"), "hits")
        shared.unpersist()
        parts = part if parts is None else parts.union(part)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))  # noqa: E731  of one document's blocks
    merged = parts.groupBy(number, digest).agg(flat("spans").alias("spans"), F.array_sort(flat("items")).alias("items"))
    merged = materialise(merged.select(number, digest, F.expr(_MERGED).alias("spans"), "items"), "hits")
    words = F.size(F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")
    none = [F.array().cast(kind) for kind in ("array<struct<start:bigint,end:bigint>>", "array<string>")]
    m = merged.select(F.col(number), F.col(digest), F.struct("spans", "items").alias(hits))
    found = F.struct(words.alias("n_words"), F.coalesce(f"{hits}.spans", none[0]).alias("spans"), F.coalesce(f"{hits}.items", none[1]).alias("items"))
    return keyed.join(bounded(m, merged), [number, digest], "left").withColumn(result, found).select(*keep, result)


#: Spans put in order and joined where they meet.
_MERGED = """aggregate(array_sort(spans), cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) ->
  if(size(a) > 0 and s.start <= element_at(a, -1).end,
     concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))),
     concat(a, array(named_struct('start', s.start, 'end', s.end)))))"""


def _pass(docs: DataFrame, grams: Broadcast, result: str, keep: list[str]) -> DataFrame:
    columns = docs.columns
    schema = StructType([docs.schema[c] for c in keep] + [StructField(result, _parse_datatype_string(HIT))])
    at, kept = columns.index("text"), [columns.index(c) for c in keep]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grams.value
        for b in batches:
            found = []
            for text in b.column(at).cast(pa.binary()):
                words = split_words(text.as_py() or b"")
                hit, items = g.scan(words)
                found.append({"n_words": len(words), "spans": [{"start": s, "end": e} for s, e in spans(hit)], "items": sorted(items)})
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(found, _HIT)], names=[*keep, result])

    return docs.mapInArrow(scanned, schema)


def n_hit(result: str = "hits"):
    return F.aggregate(F.col(f"{result}.spans"), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated(result: str = "hits"):
    return (n_hit(result) > 0) & (SHARE * n_hit(result) >= F.col(f"{result}.n_words"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that the benchmark contaminates; the others stay as they are."""
    hits = fresh(docs, "hits")
    return scan(docs, benchmark, result=hits).where(~contaminated(hits)).drop(hits)


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs with the hit words cut from their texts, each run from its first word's start to its last word's end."""
    import re

    hits = fresh(docs, "hits")
    out = scan(docs, benchmark, n, result=hits)
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def cut(texts, found):
        import pandas as pd

        done = []
        for t, s in zip(texts, found, strict=True):
            if t is not None and len(s):
                at, pieces, last = [m.span() for m in word.finditer(t)], [], 0
                for x in s:
                    pieces.append(t[last : at[x["start"]][0]])
                    last = at[x["end"] - 1][1]
                t = "".join([*pieces, t[last:]])
            done.append(t)
        return pd.Series(done, dtype=object)

    from pyspark.sql.functions import pandas_udf

    return out.withColumn("text", pandas_udf(cut, "string")(F.col("text"), F.col(f"{hits}.spans"))).drop(hits)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = scan(docs, bench, keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
    row_number() OVER () AS r FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM grams),
occurs AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT o.r, o.i, o.size, g.item FROM occurs o JOIN grams g USING (size, gram)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""
