"""The catalog in versions: all tables of a run are seen together or not at all.

A run writes its tables to a folder of its own, `runs/<run>/<table>`, and the map from each repository to the run that holds
its rows to `live/<run>`. Then one small file, `versions/<number>`, which names the run, is renamed into place: a rename that
fails where the number is taken. Only then is the run there. A run that is killed before leaves the version before as it
was; of two runs that start from one version the second gets a `Conflict` and may run again. A snapshot reads the files of
one version, whatever is committed meanwhile.

No row is rewritten: a row is seen while its repository is mapped to its run. An edge holds the runs of both its ends'
repositories at its time, too, and is seen while both are still mapped to them: so replacing a repository takes with it the
edges of other repositories that end there, by either end. Ids stand in columns, so any text may be one. `compact` writes what is
seen as one run, `vacuum` deletes what no kept version needs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators.sinks import SECRET_COLUMNS

LIVE = "repository_id string, run string"
ENDS = ("source", "target")
OWN = ("_run", *[f"_{end}_{what}" for end in ENDS for what in ("repository", "run")])


class Conflict(RuntimeError):
    """Another run has committed since this one began."""


class Files:
    """The store's file system, as Spark sees it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """name with this text, or false where it is there already: written aside and renamed without overwriting."""
        aside = self.path(f".aside-{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        none = SparkContext._gateway.new_array(rename, 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(aside), self.fs.makeQualified(self.path(name)), none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self.fs.delete(aside, False)
            return False


@dataclass
class Snapshot:
    """One version of the catalog; version 0 is empty."""

    spark: SparkSession
    root: str
    version: int
    run: str | None

    @property
    def live(self) -> DataFrame:
        """repository_id and the run that holds its rows."""
        return self.spark.createDataFrame([], LIVE) if self.run is None else self.spark.read.schema(LIVE).parquet(f"{self.root}/live/{self.run}")

    def rows(self, name: str) -> DataFrame | None:
        """A table's rows with the columns in OWN; None where no run has it."""
        files = Files(self.spark, self.root)
        runs = [r["run"] for r in self.live.select("run").distinct().collect()]  # few: compact() makes them one
        paths = [f"{self.root}/runs/{r}/{name}" for r in sorted(runs) if files.fs.exists(files.path(f"runs/{r}/{name}"))]
        if not paths:
            return None
        df = self.spark.read.option("mergeSchema", True).parquet(*paths)
        seen = df.join(self.live.select("repository_id", F.col("run").alias("_run")), ["repository_id", "_run"], "left_semi")
        for end in ENDS if "_source_run" in df.columns else ():
            seen = seen.join(self.live.select(F.col("repository_id").alias(f"_{end}_repository"), F.col("run").alias(f"_{end}_run")), [f"_{end}_repository", f"_{end}_run"], "left_semi")
        return seen

    def table(self, name: str, repository_id: str | None = None) -> DataFrame:
        df = self.rows(name)
        if df is None:
            raise KeyError(f"no run of version {self.version} has a table {name}")
        df = df.drop(*OWN)
        return df if repository_id is None else df.where(F.col("repository_id") == repository_id)

    def tables(self) -> list[str]:
        files = Files(self.spark, self.root)
        runs = [r["run"] for r in self.live.select("run").distinct().collect()]
        return sorted({n for r in runs for n in files.names(f"runs/{r}")})


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The catalog's version, or its last one."""
    root, files = root.rstrip("/"), Files(spark, root)
    there = [int(n) for n in files.names("versions") if n.isdigit()]
    if version is None:
        version = max(there, default=0)
    elif version not in there and version != 0:
        raise KeyError(f"no version {version}")
    return Snapshot(spark, root, version, files.read(f"versions/{version:012d}") if version else None)


def _as_rows(spark: SparkSession, repository_ids: list[str] | DataFrame) -> DataFrame:
    if isinstance(repository_ids, DataFrame):
        return repository_ids.select(F.col("repository_id").cast("string")).where("repository_id IS NOT NULL").distinct()
    return spark.createDataFrame([(str(x),) for x in dict.fromkeys(repository_ids) if x is not None], "repository_id string")


def _with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the repository and run of both ends: the edge's own repository where it has such a node, else the first that has. Edges without an end go."""
    own = nodes.select("repository_id", "id", "run").distinct()
    other = own.groupBy("id").agg(F.min(F.struct("repository_id", "run")).alias("o"))
    for end in ENDS:
        same = own.select("repository_id", F.col("id").alias(f"{end}_node_id"), F.col("run").alias("own_run"))
        far = other.select(F.col("id").alias(f"{end}_node_id"), "o")
        edges = edges.join(same, ["repository_id", f"{end}_node_id"], "left").join(far, f"{end}_node_id", "left")
        here = F.col("own_run").isNotNull()
        edges = edges.withColumns({f"_{end}_repository": F.when(here, F.col("repository_id")).otherwise(F.col("o.repository_id")), f"_{end}_run": F.coalesce("own_run", "o.run")})
        edges = edges.where(F.col(f"_{end}_run").isNotNull()).drop("own_run", "o")
    return edges


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], repository_ids: list[str] | DataFrame, base: Snapshot | None = None) -> int:
    """The tables' rows of these repositories in place of all their earlier rows, in all tables: the new version. Secrets aren't written."""
    base = snapshot(spark, root) if base is None else base
    run, touched = uuid.uuid4().hex, _as_rows(spark, repository_ids)
    kept = base.live.join(touched, "repository_id", "left_anti")
    for name, df in tables.items():
        rows = df.drop(*SECRET_COLUMNS).withColumn("repository_id", F.col("repository_id").cast("string")).join(touched, "repository_id", "left_semi").withColumn("_run", F.lit(run))
        if name == "edges":
            nodes = tables["nodes"].select(F.col("repository_id").cast("string").alias("repository_id"), "id", F.lit(run).alias("run"))
            nodes = nodes.join(touched, "repository_id", "left_semi")
            if (old := base.rows("nodes")) is not None:
                nodes = nodes.union(old.join(touched, "repository_id", "left_anti").select("repository_id", "id", F.col("_run").alias("run")))
            rows = _with_ends(rows, nodes)
        rows.write.parquet(f"{base.root}/runs/{run}/{name}")
    return _publish(base, kept.union(touched.withColumn("run", F.lit(run))), run)


def delete(spark: SparkSession, root: str, repository_ids: list[str] | DataFrame) -> int:
    """A version without these repositories, and without the edges that end at them."""
    base = snapshot(spark, root)
    return _publish(base, base.live.join(_as_rows(spark, repository_ids), "repository_id", "left_anti"), uuid.uuid4().hex)


def compact(spark: SparkSession, root: str) -> int:
    """A version with the same rows, all of one run."""
    base = snapshot(spark, root)
    names = [n for n in base.tables() if n != "edges"] + ["edges"] * ("edges" in base.tables())
    return commit(spark, root, {n: base.table(n) for n in names}, base.live, base)


def _publish(base: Snapshot, live: DataFrame, run: str) -> int:
    live.select("repository_id", "run").write.parquet(f"{base.root}/live/{run}")
    if not Files(base.spark, base.root).publish(f"versions/{base.version + 1:012d}", run):
        raise Conflict(f"version {base.version + 1} is there already")
    return base.version + 1


def vacuum(spark: SparkSession, root: str, keep: int = 1, idle_seconds: float = 86_400) -> int:
    """Deletes earlier versions than the last `keep`, and folders that none of these needs and that nobody has touched for so long; how many folders."""
    import time

    files, last = Files(spark, root), snapshot(spark, root).version
    used: set[str] = set()
    for name in files.names("versions"):
        if name.isdigit() and int(name) > last - keep:
            s = snapshot(spark, root, int(name))
            used |= {s.run, *[r["run"] for r in s.live.select("run").distinct().collect()]}
        elif name.isdigit():
            files.fs.delete(files.path(f"versions/{name}"), False)
    gone = 0
    for folder in ("runs", "live"):
        for run in files.names(folder):
            path = files.path(f"{folder}/{run}")
            if run not in used and time.time() - files.fs.getFileStatus(path).getModificationTime() / 1000 >= idle_seconds:
                gone += bool(files.fs.delete(path, True))
    return gone
