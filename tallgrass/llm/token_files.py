"""Token-ID output: documents as token ids in Simple-8b words, in files whose order is the order of the ids of documents.

Documents are dealt by ranges of doc_id and sorted within each, then encoded, so that file by file and row by row the
ids of all documents stand in one sequence. The container is Parquet, which Spark can write to any store; a row holds

    doc_id, shard (the range's number), local (ids of this shard before it), n_tokens (with the end id),
    blocks (little-endian unsigned 32-bit word offsets of its blocks), words (little-endian 64-bit Simple-8b words).

A document's `start` is its shard's start (a running sum over shards, one row each) and `local`. Reading decodes the
words and needs neither text nor tokenizer.

A null text is an empty one: it has the end id alone. A null doc_id comes first. Rows that share a doc_id are ordered by
a hash of their texts, so that reruns agree. A very long text is encoded and decoded whole, one row by itself in an Arrow batch, in memory
of a few times its size. Empty tables give an empty file set. Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallgrass.llm import simple8b
from tallgrass.llm.common import documents, partitions, shared_path, small_batches
from tallgrass.llm.tokens import encoder, tokenizer_path

END = 2
FILE_SCHEMA = "doc_id long, shard int, local long, n_tokens long, blocks binary, words binary"


def _chunks(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in groups of about `most` characters, which bounds what is encoded at once."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    """A binary array over data, whose values end at ends."""
    edges = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data)])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """docs (doc_id, text) encoded to the format at path."""
    spark = docs.sparkSession
    small_batches(spark)
    body, tie = F.coalesce("text", F.lit("")), F.xxhash64("text")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), tie.alias("tie"))
    dealt = dealt.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", F.spark_partition_id().alias("shard"), "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, local, stop = encoder(tokenizer), 0, np.array([end], np.uint32).tobytes()
        for b in batches:
            at = 0
            for group in _chunks(b.column(2).to_pylist()):
                own = b.slice(at, len(group))
                at += len(group)
                ids = [x + stop for x in coder.encode(group)]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                words, by_doc, offsets, blocks = simple8b.encode(np.frombuffer(b"".join(ids), np.uint32), sizes)
                starts = local + np.cumsum(sizes) - sizes
                local += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(starts), pa.array(sizes), _binary(offsets.astype("<u4").tobytes(), 4 * np.cumsum(blocks)), _binary(words.astype("<u8").tobytes(), 8 * np.cumsum(by_doc))],
                    names=["doc_id", "shard", "local", "n_tokens", "blocks", "words"],
                )

    dealt.mapInArrow(encoded, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def token_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, with each document's start among all ids."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each shard: as many as write_token_files dealt, which bounds the broadcast
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("shard", before.alias("shard_start"))
    return rows.join(F.broadcast(starts), "shard").withColumn("start", F.col("shard_start") + F.col("local")).drop("shard_start")


def decoded(batch: pa.RecordBatch, sizes: str = "n_tokens", blocks: str = "blocks", words: str = "words") -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch's documents in a row, and how many each has."""
    n = batch.column(sizes).to_numpy(zero_copy_only=False).astype(np.int64)
    w, o = batch.column(words).to_pylist(), batch.column(blocks).to_pylist()
    by_doc = np.array([len(x) // 8 for x in w], np.int64)
    return simple8b.decode(np.frombuffer(b"".join(w), "<u8").astype(np.uint64), by_doc, np.frombuffer(b"".join(o), "<u4").astype(np.int64), n), n


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32 (and the ids)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = decoded(b)
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(n)
            sums = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            cols = [b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return token_rows(spark, path).mapInArrow(read, schema)


def tokenised(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_token_files(docs, path, tokenizer or tokenizer_path())
    return read_token_files(spark, path)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(spark, documents(spark, sf_dir, "doc_id", "text"))
