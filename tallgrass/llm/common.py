"""What the operators share: the shared folder, written intermediates, row identity and byte tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch (one row at least). Texts are read whole, so that these bound a Python worker's memory.
ARROW_ROWS = 256
ARROW_BYTES = 16 << 20

#: Rows of a few numbers each that a join may broadcast.
BROADCAST_ROWS = 200_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space that parts words, as a Java and RE2 class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, for a local master alone, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master := spark.sparkContext.master):
        raise RuntimeError(f"spark.checkpoint.dir is unset: executors of {master} share no local folder for what is written between steps")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="tallgrass-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = f"file://{folder}"
    return _own[app]


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; the driver's file system deletes it when the driver ends."""
    path = f"{shared_dir(spark)}/tallgrass/{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and its path."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def counted(df: DataFrame, tag: str, **more: Column) -> tuple[DataFrame, str, dict]:
    """As `written`, with n, the rows written, and the aggregates `more`: all found by the write itself, with no job of their own."""
    seen = Observation()
    df, path = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()]), tag)
    return df, path, {"n": 0} | seen.get


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, and safe when executors are lost."""
    return written(df, tag)[0]


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more, before the driver ends.

    Spark drops what was broadcast and shuffled for them when the driver's garbage is collected, which a loop must not leave to chance.
    """
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    spark._jvm.System.gc()


def shuffled(df: DataFrame) -> DataFrame:
    """df marked for a join that never broadcasts. Spark sizes what comes after an explode as if it had the rows before it."""
    return df.hint("merge")


def bounded(df: DataFrame, written: DataFrame | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if the written table that it is, or comes from, has at most `most` rows; else for a shuffle."""
    return F.broadcast(df) if (df if written is None else written).count() <= most else shuffled(df)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that later plans of this session send to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """name, or a variant of it that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def row_digest(*names: str) -> Column:
    """64 bits that tell rows of one id apart: rows that agree in these columns share it."""
    return F.xxhash64(*[F.coalesce(F.col(n).cast("string"), F.lit("\0")) for n in names])


def text_bytes(name: str = "text") -> Column:
    """A text's UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
