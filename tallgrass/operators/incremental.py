"""Analysis as files change: a feed of file changes keeps a catalog up to date, and only what a change touches is analysed.

A change is a file's new content or its removal. The catalog keeps each file's last state with the hash of its content (table
`sources`); a change that is older than what is there, or says the same, is none. The repositories with a real change are analysed as
they now stand, their facts, relations, nodes and edges replace the earlier ones in one commit, and all others stay as they are. So a batch
that comes again leaves no trace, and the catalog is at any time what one analysis of all files would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators.analysis import analyse
from tallgrass.operators.packages import saved
from tallgrass.operators.versions import commit, snapshot
from tallgrass.sources.corpus import prepared
from tallgrass.sources.rules import Rules

CHANGES = "repository_id string, path string, content string, deleted boolean, at timestamp"
SOURCES = "repository_id string, path string, content string, deleted boolean, at timestamp, hash string"


def sources(spark: SparkSession, root: str) -> DataFrame:
    """The files of the catalog, removed ones too."""
    rows = snapshot(spark, root).rows("sources")
    return spark.createDataFrame([], SOURCES) if rows is None else rows.select("repository_id", "path", "content", "deleted", "at", "hash")


def listing_changes(listing: DataFrame, root: str) -> DataFrame:
    """The changes that a full listing (repository_id, path, content, at) of some repositories means: what is there, and the removal of what isn't any more."""
    there = listing.select("repository_id", "path", "content", F.lit(False).alias("deleted"), "at")
    last = listing.groupBy("repository_id").agg(F.max("at").alias("at"))
    known = sources(listing.sparkSession, root).where("not deleted").select("repository_id", "path")
    gone = known.join(listing.select("repository_id", "path"), ["repository_id", "path"], "left_anti").join(last, "repository_id")
    return there.unionByName(gone.select("repository_id", "path", F.lit(None).cast("string").alias("content"), F.lit(True).alias("deleted"), "at"))


def apply_changes(changes: DataFrame, repositories: DataFrame, root: str, rules: Rules | None = None) -> int | None:
    """Brings the catalog up to date with changes (CHANGES, in any order); the new version, or None where they change nothing."""
    spark = changes.sparkSession
    gone = F.coalesce(F.col("deleted"), F.lit(False))
    told = changes.where("repository_id IS NOT NULL AND path IS NOT NULL").select("repository_id", "path", F.when(~gone, F.coalesce("content", F.lit(""))).alias("content"), gone.alias("deleted"), "at")
    told = told.withColumn("hash", F.sha2("content", 256))
    rest = F.struct("at", "deleted", "hash", "content")
    last = told.groupBy("repository_id", "path").agg(F.max(rest).alias("e")).select("repository_id", "path", "e.content", "e.deleted", "e.at", "e.hash")
    had = sources(spark, root)
    was = had.select("repository_id", "path", F.col("hash").alias("was_hash"), F.col("deleted").alias("was_deleted"), F.col("at").alias("was_at"))
    both = last.join(was, ["repository_id", "path"], "left")
    new = F.col("was_deleted").isNull() & ~F.col("deleted")
    other = F.col("was_deleted").isNotNull() & (F.col("at") >= F.col("was_at")) & ((F.col("deleted") != F.col("was_deleted")) | ~F.col("hash").eqNullSafe(F.col("was_hash")))
    real = saved(both.where(new | other).select("repository_id", "path", "content", "deleted", "at", "hash"))
    touched = saved(real.select("repository_id").distinct())
    if touched.isEmpty():
        return None
    kept = had.join(touched, "repository_id", "left_semi").join(real, ["repository_id", "path"], "left_anti")
    now = saved(kept.unionByName(real))
    files = prepared(now.where("not deleted").select("repository_id", "path", "content"))
    tables = analyse(files, repositories.join(touched.withColumnRenamed("repository_id", "id"), "id", "left_semi"), rules)
    return commit(spark, root, {k: v for k, v in tables.items() if "repository_id" in v.columns} | {"sources": now}, touched)


def analyse_changes(feed: DataFrame, repositories: DataFrame, root: str, checkpoint: str, rules: Rules | None = None):
    """The same over a stream of changes, batch by batch."""
    return feed.writeStream.foreachBatch(lambda df, _: apply_changes(df, repositories, root, rules)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
