"""Mixing sources to target weights along a curriculum whose weights change over training.

Sources in code point order (null last) weigh 3, 1, 2, again and again, and share `TOTAL` times all words. No target goes
beyond `MOST` times its source's words; what is cut off is shared again by weight among the rest, until none is above.
This is the level at which the sum of min(most, level x weight) is the total; it is found by a few passes over one row
for each source.

Within a source documents stand in the order of a hash, epoch after epoch, until the target's words are taken; the last
one is taken in part. The order is cut into hash buckets, about `BUCKETS` times the root of the table's count of documents
(the result doesn't depend on it): bucket sums are added up over the rows of a source, one for each bucket, and words before
a document within its own bucket. Both are then about the root of the count, so that no task holds a whole source.

Each source's weight changes over training: a piecewise linear schedule. Its integral up to time t, times the target, is
the source's token demand; a document that starts at word c of its source's stream stands where the demand reaches c,
the inverse of that integral. Documents are sorted by ranges of that position.

Null and empty texts have size 0 and take nothing. A very long text's words are counted in the scan, and it moves whole. A null source is a source of its own. Rows that repeat are mixed like
different ones: which of them is taken is arbitrary, what is taken of them together is not. Empty tables give an empty
result. Further columns are not read by `mixture` and are kept by `mixed_documents`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallgrass.llm.common import WORD, documents, fresh, materialise, partitions, row_digest

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2
BUCKETS = 4
#: For each of WEIGHTS the schedule's (time, weight) knots: the first wanes, the second grows, the third peaks halfway.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.75), (0.5, 1.25), (1.0, 0.75)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """df with each row's place (from 0) in the order: dealt by ranges, numbered within each, and moved by the counts of the ranges before."""
    spark, part, row = df.sparkSession, fresh(df, "part"), fresh(df, "row")
    dealt = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    dealt = materialise(dealt, "numbered")
    counts = dealt.groupBy(part).agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select(part, F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return dealt.join(before, part).withColumn(name, F.col("before") + F.col(row)).drop(part, row, "before")


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """source, source_size, place (of its weight), target, from rows (source, size)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(by, F.col("source").isNull(), F.col("source"))
    place = F.pmod("number", F.lit(len(weights)))
    ranked = materialise(ranked.withColumn("place", place.cast("int")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place").cast("int") + 1)), "sources")
    want = total * (ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > most * F.col("source_size")
        got = ranked.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most * F.col("source_size"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if got["n"] == capped:
            break
        capped = got["n"]
        level = (want - (got["full"] or 0)) / got["open"] if got["open"] else math.inf
    target = F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double"))
    return ranked.select("source", "source_size", "place", target.alias("target"))


def position(share: Column, knots) -> Column:
    """The time at which the integral of the schedule reaches this share of its whole."""
    area = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        area.append(area[-1] + (t1 - t0) * (w0 + w1) / 2)
    y, out = share * area[-1], None
    for k in reversed(range(len(knots) - 1)):
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        slope, rest = (w1 - w0) / (t1 - t0), y - area[k]
        t = t0 + (rest / w0 if slope == 0 else (F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0))) - w0) / slope)
        out = t if out is None else F.when(y < area[k + 1], t).otherwise(out)
    return out


def mixture(docs: DataFrame, *keep: str, schedules=SCHEDULES, buckets: float = BUCKETS, most: int = MOST) -> DataFrame:
    """keep, size, source_size, target, taken, copies (whole documents, the boundary's rounded), positions: one for each epoch that the document is in."""
    keep = keep or ("doc_id",)
    h = F.xxhash64("doc_id", "text")
    sizes = materialise(docs.select(*keep, "source", word_count(F.col("text")).alias("size"), h.alias("h")), "sizes")
    bits = max(1, math.ceil(math.log2(max(2.0, buckets * math.sqrt(sizes.count())))))
    sizes = sizes.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    goal = targets(sizes, most=most)
    by_bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    g = goal.select(F.col("source").alias("g_source"), "source_size", "place", "target")
    base = by_bucket.withColumn("base", before).join(g, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source", "n")
    b = base.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "base", "source_size", "place", "target")
    inner = F.coalesce(F.sum("size").over(W.partitionBy("source", "bucket").orderBy("h", *keep, "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = sizes.withColumn("inner", inner).join(b, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    start, want = F.col("base") + F.col("inner"), F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(want / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rows = rows.withColumns({"start": start, "want": want, "full": full})
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("want") - F.col("full") * F.col("source_size") - F.col("start")))
    rows = rows.withColumn("part", part.cast("long"))
    taken = F.col("full") * F.col("size") + F.col("part")
    copies = F.col("full") + ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("long")

    def at(epoch: int) -> Column:
        share = (F.col("start") + epoch * F.col("source_size")) / F.greatest("want", F.lit(1))
        by_place = position(share, schedules[0])
        for k in range(1, len(schedules)):
            by_place = F.when(F.col("place") == k, position(share, schedules[k])).otherwise(by_place)
        return F.when((taken > epoch * F.col("size")) | (F.col("copies") > epoch), by_place)

    out = rows.withColumn("copies", copies)
    positions = F.array_compact(F.array(*[at(k) for k in range(math.ceil(most))]))
    return out.select(*keep, "size", "source_size", "target", taken.alias("taken"), "copies", positions.alias("positions"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixture's documents in training order, each as often as it is taken; rows are whole documents, so the one that a source's target cuts is there if at least half of its words are taken."""
    number, digest, at = fresh(docs, "key_number"), fresh(docs, "key_digest"), fresh(docs, "mix_position")
    marked = docs.withColumns({number: F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), digest: row_digest("doc_id", "text", "source")})
    made = mixture(marked.select("doc_id", "text", "source", number, digest), number, digest).where("copies > 0")
    places = made.select(number, digest, F.explode(F.slice("positions", 1, F.col("copies").cast("int"))).alias(at))
    # rows of one key are the same here; each of their copies has a place of its own
    out = marked.dropDuplicates([number, digest]).join(places, [number, digest])
    return out.repartitionByRange(partitions(docs.sparkSession), at, number, digest).sortWithinPartitions(at, number, digest).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixture(documents(spark, sf_dir, "doc_id", "text", "source"), "doc_id")
    made = made.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), F.get("positions", F.lit(1)).alias("position_2"))
    order = (F.col("position").isNull(), F.col("position"), F.col("doc_id"))
    return made.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
