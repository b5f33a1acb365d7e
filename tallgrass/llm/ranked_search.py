"""Ranked lexical search over document-sharded CSR postings with integer impacts.

Terms are the maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased. With N the documents that have a
term, L all their terms, n a document's terms and tf a term's occurrences in it, a posting's impact is
(10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L. A term in df documents weighs floor(1000 ln((2N + 2) / (2 df + 1))).
A document scores the sum of weight times impact over a query's terms, repeats included; all of it in 64-bit integers.

The index: one pass counts N and L, a second tokenises the documents where they are read. Each task cuts what it reads into
shards of about `SHARD_BYTES` of text; a shard is one row: its documents in order of doc_id, its terms in order, and for
each term (between two of `starts`) the places of its documents and their impacts. Shards are written once, in row groups of
a few shards, as Spark writes and reads a row group whole; no posting is shuffled, and every document that has a term is in one.

Search takes queries in blocks of at most `BLOCK_TERMS` terms, which are broadcast; a block takes two scans of the shards.
The first adds up df of its terms. The second goes term by term through a shard and adds to one dense accumulator for each
query (at most `DENSE` cells at a time); a partition of the scores gives the k-th highest, all above it are taken, and of
those equal to it the ones of smallest doc_id. Tasks carry a query's k best from shard to shard, so that k rows a query and task are merged,
first in groups of tasks and then once. So no row is left out, and ties don't depend on how documents are dealt.

Null and empty texts have no terms, are in no shard and never found. A very long text is tokenised piece by piece and is a shard of
its own. Documents that repeat are found each, next to one another; a null doc_id comes after others of its score. Queries
that repeat with item_id and text count once; different texts of one item_id are ranked each for itself. A query without
terms, or with none that scores, has no rows. An empty table gives an empty result. Further columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallgrass.llm.common import LOWER, UPPER, documents, shared_path, small_batches
from tallgrass.llm.decontaminate import _FOLD, split_words

#: Bytes of text in a shard, of which a text that is longer has more.
SHARD_BYTES = 4 << 20
#: Bytes of a row group of shards, which a task holds in memory to write or read it.
GROUP_BYTES = 8 << 20
#: Different terms in a block of queries, each counted once a query; one query may have more.
BLOCK_TERMS = 200_000
#: Cells of accumulators at a time.
DENSE = 4 << 20
TOP = 10
#: Groups of tasks whose best rows are merged first.
GROUPS = 64

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD = "doc_ids array<bigint>, n_terms bigint, terms array<binary>, starts array<bigint>, places binary, impacts binary"
_SHARD = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_terms", pa.int64()), ("terms", pa.list_(pa.binary())), ("starts", pa.list_(pa.int64())), ("places", pa.binary()), ("impacts", pa.binary())])

_INSIDE = np.frombuffer(_FOLD, np.uint8) != 32


@dataclass
class Index:
    shards: DataFrame
    n_docs: int


def _pieces(text: bytes, most: int = SHARD_BYTES) -> Iterator[list[bytes]]:
    """A text's terms in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + most
        while end < len(text) and len(split_words(text[end : end + 1])):  # inside a term
            end += 1
        yield split_words(text[at:end])
        at = end


def term_count(text: bytes, most: int = SHARD_BYTES) -> int:
    """The terms of a text, repeats included: the bytes in a term that follow none."""
    found, before = 0, False
    for at in range(0, len(text), most):
        inside = _INSIDE[np.frombuffer(text, np.uint8, min(most, len(text) - at), at)]
        found += int(inside[0] and not before) + int(np.count_nonzero(inside[1:] > inside[:-1]))
        before = inside[-1]
    return found


class Postings:
    """The postings of a shard's documents."""

    def __init__(self, n_docs: int, n_terms: int):
        self.totals, self.bytes = (n_docs, n_terms), 0
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.found: list[tuple[np.ndarray, np.ndarray, int]] = []  # terms, occurrences, document

    def add(self, doc_id: int | None, text: bytes) -> None:
        size, number = 0, self.vocabulary.__getitem__
        for words in _pieces(text):
            if words:
                terms, times = np.unique(np.fromiter(map(number, words), np.int64, len(words)), return_counts=True)
                self.found.append((terms, times, len(self.ids)))
                size += len(words)
        if size:
            self.ids.append(doc_id)
            self.sizes.append(size)
            self.bytes += len(text)

    def row(self) -> dict:
        n_docs, n_terms = self.totals
        by_id = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        by_term = sorted(self.vocabulary)
        place, rank = np.empty(len(by_id), np.int64), np.empty(len(by_term), np.int64)
        place[by_id] = np.arange(len(by_id))
        rank[[self.vocabulary[t] for t in by_term]] = np.arange(len(by_term))
        keys = np.concatenate([rank[t] * len(place) + place[d] for t, _, d in self.found])
        keys, inverse = np.unique(keys, return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, inverse, np.concatenate([c for _, c, _ in self.found]))
        terms, docs = np.divmod(keys, len(place))
        m = np.array([25 + 75 * self.sizes[k] * n_docs // n_terms for k in by_id], np.int64)
        impacts = 10**9 * times // (1000 * times + 8 * m[docs])
        starts = np.searchsorted(terms, np.arange(len(by_term) + 1))
        return {"doc_ids": [self.ids[k] for k in by_id], "n_terms": sum(self.sizes), "terms": by_term, "starts": starts, "places": docs.astype("<i4").tobytes(), "impacts": impacts.astype("<i4").tobytes()}


def build_index(docs: DataFrame, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of docs (doc_id, text), written to path or the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, terms = 0, 0
        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                size = term_count(text.as_py() or b"")
                n, terms = n + (size > 0), terms + size
        yield pa.RecordBatch.from_pydict({"n": [n], "terms": [terms]})

    seen = docs.select("text").mapInArrow(sizes, "n bigint, terms bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("terms").alias("terms")).first()
    totals = (seen["n"], seen["terms"] or 0)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Postings(*totals)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                held.add(doc_id, text.as_py() or b"")
                if held.bytes >= shard_bytes:
                    yield pa.RecordBatch.from_pylist([held.row()], _SHARD)
                    held = Postings(*totals)
        if held.ids:
            yield pa.RecordBatch.from_pylist([held.row()], _SHARD)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(shards, SHARD)
    path = path or shared_path(spark, "shards")
    # rows are large: the writer is to look at its size after each few, not after hundreds
    made.write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 2).option("parquet.block.size.row.check.min", 2).option("compression", "zstd").parquet(path)
    return Index(spark.read.schema(SHARD).parquet(path), totals[0])


def read_index(spark: SparkSession, path: str) -> Index:
    shards = spark.read.schema(SHARD).parquet(path)
    return Index(shards, shards.agg(F.sum(F.size("doc_ids").cast("long"))).first()[0] or 0)


class Queries:
    """A block of queries: vocabulary, and for each of its terms the queries that hold it and how often."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.items = [item for item, _ in items]
        holders: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(items):
            for term, times in Counter(words).items():
                holders[term].append((k, times))
        self.terms = sorted(holders)
        self.starts = np.cumsum([0, *(len(holders[t]) for t in self.terms)])
        self.queries = np.array([k for t in self.terms for k, _ in holders[t]], np.int64)
        self.times = np.array([n for t in self.terms for _, n in holders[t]], np.int64)
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(self.terms))], np.int64)

    def met(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which of a shard's terms are in the vocabulary, and their places there."""
        at = pc.index_in(terms, value_set=pa.array(self.terms, terms.type))
        mine = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        return mine, at.drop_null().to_numpy()


def query_blocks(items: Iterator[tuple[object, list[bytes]]], most: int) -> Iterator[Queries]:
    held, size = [], 0
    for item, words in items:
        if held and size + len(words) > most:
            yield Queries(held)
            held, size = [], 0
        held.append((item, words))
        size += len(words)
    if held:
        yield Queries(held)


def _df(shards: DataFrame, shared) -> dict[int, int]:
    """The documents that hold each of the vocabulary's terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.terms), np.int64)
        for b in batches:
            for terms, starts in zip(b.column(0), b.column(1), strict=True):
                mine, at = shared.value.met(terms.values)
                total[at] += np.diff(starts.values.to_numpy())[mine]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    found = shards.select("terms", "starts").mapInArrow(counted, "term bigint, df bigint")
    return {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # at most a block's terms


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows of each query's k highest scores, equal ones by id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    number = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[number < k]


def shard_best(q: Queries, terms: pa.Array, starts: np.ndarray, places: np.ndarray, impacts: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, place and score of a shard's k best documents of each query."""
    mine, at = q.met(terms)
    found = [], [], []
    rows = max(1, DENSE // n_docs)
    for low in range(0, len(q.items), rows):
        dense = np.zeros((min(rows, len(q.items) - low), n_docs), np.int64)
        for j, v in zip(mine.tolist(), at.tolist(), strict=True):
            lo, hi = q.starts[v : v + 2]
            own = q.queries[lo:hi] - low
            inside = (own >= 0) & (own < len(dense))
            if q.weights[v] and inside.any():
                posting = slice(starts[j], starts[j + 1])
                gain = q.weights[v] * impacts[posting].astype(np.int64)
                docs, times = places[posting], q.times[lo:hi][inside]
                for row, n in zip(own[inside].tolist(), times.tolist(), strict=True):
                    dense[row][docs] += n * gain
        # the k-th highest of each query: all above it, and of those equal to it the first in order of doc_id
        kth = np.maximum(dense[np.arange(len(dense)), np.argpartition(dense, n_docs - k, axis=1)[:, n_docs - k]] if k < n_docs else 0, 1)
        above = dense > kth[:, None] if k < n_docs else dense > 0
        if k < n_docs:
            equal = dense == kth[:, None]
            above |= equal & (np.cumsum(equal, axis=1) <= (k - above.sum(axis=1))[:, None])
        row, place = np.nonzero(above)
        for out, values in zip(found, (row + low, place, dense[row, place]), strict=True):
            out.append(values)
    return tuple(map(np.concatenate, found))


def search(index: Index, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text)."""
    spark = items.sparkSession
    small_batches(spark)
    kind = items.schema["item_id"]
    schema = StructType([StructField("query", LongType()), kind, StructField("doc_id", LongType()), StructField("score", LongType())])
    asked = items.where("text is not null").select("item_id", "text").distinct()
    found = None
    for q in query_blocks(((r["item_id"], split_words(r["text"].encode())) for r in asked.toLocalIterator()), block_terms):
        shared = spark.sparkContext.broadcast(q)
        q.weigh(_df(index.shards, shared), index.n_docs)
        weighed = spark.sparkContext.broadcast(q)
        part = _block(index.shards, weighed, schema, k)
        part = part.select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], StructType([kind, StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())]))
    return found


def _block(shards: DataFrame, queries, schema: StructType, k: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    last = np.iinfo(np.int64).max

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = queries.value
        query, score, ids, null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        for b in batches:
            for doc_ids, terms, starts, places, impacts in zip(*(b.column(c) for c in ("doc_ids", "terms", "starts", "places", "impacts")), strict=True):
                own = doc_ids.values
                got = shard_best(q, terms.values, starts.values.to_numpy(), np.frombuffer(places.as_buffer(), "<i4"), np.frombuffer(impacts.as_buffer(), "<i4"), len(own), k)
                none = own.is_null().to_numpy(zero_copy_only=False)
                filled = own.fill_null(last).to_numpy()
                query, score, ids, null = (np.concatenate(x) for x in ((query, got[0]), (score, got[2]), (ids, filled[got[1]]), (null, none[got[1]])))
                keep = best(query, score, ids, k)
                query, score, ids, null = query[keep], score[keep], ids[keep], null[keep]
        items = pa.array(q.items, arrow.field("item_id").type)
        yield pa.RecordBatch.from_arrays([pa.array(query), items.take(pa.array(query)), pa.array(ids, mask=null), pa.array(score)], schema=arrow)

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = shards.select("doc_ids", "terms", "starts", "places", "impacts").mapInArrow(searched, schema).withColumn("part", F.spark_partition_id() % GROUPS)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(documents(spark, sf_dir, "doc_id", "text"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY t, big_n),
m AS (SELECT r, doc_id, 25 + (75 * CAST(len(w) AS BIGINT) * big_n) // big_l AS m FROM d, s WHERE len(w) > 0),
b AS (SELECT item_id, row_number() OVER () AS q, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
bt AS (SELECT q, item_id, t, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS t FROM b) GROUP BY q, item_id, t),
scores AS (
  SELECT q, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM bt JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS k FROM scores WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked WHERE k <= {TOP}"""
