"""Writing single tables: a repository's rows replace its earlier ones by dynamic partition overwrite; other repositories stay. Tables that belong together go through `versions`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECRET_COLUMNS = ("auth_value",)


def replace_rows(df: DataFrame, path: str, repository_ids: list | None = None) -> None:
    """Partitions (repositories) of df are replaced at path, all in one job; of repository_ids those without rows in df are emptied."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_id").parquet(path)
    if repository_ids:
        listed = F.col("repository_id").isin([x for x in repository_ids if x is not None]) | F.col("repository_id").isNull()
        there = {r["repository_id"] for r in df.where(listed).select("repository_id").distinct().collect()}  # as many as the caller listed
        root, name = path.rstrip("/").rsplit("/", 1)
        for x in repository_ids:
            if x not in there:
                delete_repository(df.sparkSession, root, [name], x)


def save_catalog(tables: dict[str, DataFrame], root: str, repository_ids: list | None = None) -> None:
    """The tables of a run (facts, graph nodes and edges alike), without secrets."""
    for name, df in tables.items():
        replace_rows(df.drop(*SECRET_COLUMNS), f"{root.rstrip('/')}/{name}", repository_ids)


def create_repositories(df: DataFrame, root: str) -> None:
    """Rows of the repositories table whose repository_id isn't there are added."""
    path = f"{root.rstrip('/')}/repositories"
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(hadoop):
        df = df.join(df.sparkSession.read.parquet(path).select("repository_id"), "repository_id", "left_anti")
    df.dropDuplicates(["repository_id"]).drop(*SECRET_COLUMNS).write.mode("append").partitionBy("repository_id").parquet(path)


def touch_repository(spark: SparkSession, root: str, repository_id, **values) -> bool:
    """Sets columns of a repository's row (such as last_analyzed_at); false where it isn't there."""
    path = f"{root.rstrip('/')}/repositories"
    df = load_table(spark, root, "repositories", repository_id)
    rows = df.collect()  # one
    if not rows:
        return False
    new = [tuple(values.get(c, r[c]) for c in df.columns) for r in rows]
    replace_rows(spark.createDataFrame(new, df.schema), path)
    return True


def load_table(spark: SparkSession, root: str, name: str, repository_id=None) -> DataFrame:
    """A table, or a repository's partition of it."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    return df if repository_id is None else df.where(F.col("repository_id") == repository_id)


def delete_repository(spark: SparkSession, root: str, names: list[str], repository_id: str | None) -> int:
    """Drops the repository's partition of each table; how many there were. The id is escaped as Spark's writer does, so that it names one folder of the table."""
    folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("repository_id", None if repository_id is None else str(repository_id))
    gone = 0
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}/{folder}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        gone += bool(fs.exists(path) and fs.delete(path, True))
    return gone


def as_json(df: DataFrame) -> DataFrame:
    """One column of JSON text."""
    return df.drop(*SECRET_COLUMNS).select(F.to_json(F.struct("*")).alias("json"))
