"""Package dependency graphs: closure, version conflicts, roots and statistics."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir; in local tests a folder of our own), deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import re
        import tempfile

        if not re.fullmatch(r"local(\[[^\]]*\])?", master := spark.sparkContext.master):
            raise RuntimeError(f"spark.checkpoint.dir is unset: executors of {master} share no local folder for what is written between steps")

        base = f"file://{tempfile.mkdtemp(prefix='tallgrass-')}"
    path = f"{base.rstrip('/')}/tallgrass/{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that a loop's plan stays short and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, "loop")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(pairs: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """start and every name reached from it over pairs (name, dependency). A start is there itself only if it is on a cycle.

    Breadth first for all starts at once: the frontier is joined to the pairs and what was seen before is taken out.
    """
    edges = pairs.select(F.col("name").alias("at"), F.col("dependency").alias("reached")).distinct()
    frontier = saved(starts.select(F.col("name").alias("start"), F.col("name").alias("at")).distinct())
    seen: DataFrame | None = None
    depth = 0
    while most is None or depth < most:
        step = frontier.join(edges, "at").select("start", "reached").distinct()
        fresh = saved(step if seen is None else step.join(seen, ["start", "reached"], "left_anti"))
        if fresh.isEmpty():
            break
        seen = fresh if seen is None else seen.unionByName(fresh)
        frontier = fresh.withColumnRenamed("reached", "at")
        depth += 1
    return seen if seen is not None else frontier.limit(0).withColumnRenamed("at", "reached")


#: Pairs for each piece that a set of names is cut into, so that a set may be of any size.
PIECE = 1 << 22


def closures(pairs: DataFrame, piece: int = PIECE) -> DataFrame:
    """As `closure`, for all names as starts: start and every name reached from it.

    A name's set is the union of its dependencies and of their sets, so that each set is made once, from whole sets, and
    nothing found before is looked at again. Names are taken in layers: first those with no dependency that has some itself,
    then those whose dependencies are in layers before. What never gets into a layer is on a cycle or leads to one; these
    names go breadth first among themselves, and then take the sets of the layers below.
    """
    ends = pairs.select("name", "dependency").where(F.col("name").isNotNull()).distinct()
    rest, gone, before, depth = saved(ends), [], -1, 0
    while (left := rest.count()) not in (0, before):
        known = rest.select(F.col("name").alias("dependency"), F.lit(True).alias("open")).distinct()
        step = saved(rest.join(known, "dependency", "left").select("name", "dependency", "open"))
        gone.append(step.where("open IS NULL").select("name", "dependency", F.lit(depth).alias("lower")))
        rest, before, depth = step.where("open").select("name", "dependency"), left, depth + 1
    never = depth + 1
    edges = rest.withColumn("lower", F.lit(never))
    for x in gone:
        edges = edges.unionByName(x)
    edges = saved(edges.withColumn("layer", F.max("lower").over(Window.partitionBy("name"))))
    wanted: dict[int, list[int]] = {}
    for layer, lower in edges.where(F.col("layer") != never).select("layer", "lower").distinct().collect():
        wanted.setdefault(layer, []).append(lower)

    pieces = 1 + edges.count() // piece
    number = F.when(F.col("dependency").isNull(), -1).otherwise(F.pmod(F.xxhash64("dependency"), F.lit(pieces)).cast("int"))
    # collect_list leaves out nulls: the null stands alone in its piece
    items = F.when(F.col("piece") < 0, F.array(F.first("item"))).otherwise(F.collect_list("item"))
    made: dict[int, DataFrame] = {}

    def united(own: DataFrame, below: list[int]) -> DataFrame:
        """name, piece and item of the dependencies of own and of their sets, which are in the layers below."""
        parts = own.select("name", number.alias("piece"), F.array("dependency").alias("items"))
        sets = [made[x - 1] for x in below if x]
        if sets:
            found = reduce(DataFrame.unionByName, sets).withColumnRenamed("name", "dependency")
            parts = parts.unionByName(own.join(found, "dependency").select("name", "piece", "items"))
        return parts.repartition("name", "piece").select("name", "piece", F.explode("items").alias("item")).distinct()

    for layer in sorted(wanted):
        rows = united(edges.where(F.col("layer") == layer).select("name", "dependency"), wanted[layer])
        made[layer] = saved(rows.groupBy("name", "piece").agg(items.alias("items")))
    reached = [sets.select(F.col("name").alias("start"), F.explode("items").alias("reached")) for sets in made.values()]
    if left:
        inner = saved(closure(rest, rest.select("name")))
        through = inner.unionByName(rest.select(F.col("name").alias("start"), F.col("name").alias("reached")).distinct())
        out = edges.where((F.col("layer") == never) & (F.col("lower") != never))
        leads = through.join(out, F.col("reached") == F.col("name")).select(F.col("start").alias("name"), "dependency").distinct()
        below = united(leads, [0, *(x + 1 for x in made)])
        reached += [inner, below.select(F.col("name").alias("start"), F.col("item").alias("reached"))]
    if not reached:
        return ends.select(F.col("name").alias("start"), F.col("dependency").alias("reached"))
    return reduce(DataFrame.unionByName, reached)


def dependency_pairs(packages: DataFrame) -> DataFrame:
    return packages.select("name", F.explode("dependencies").alias("dependency"))


def conflicts(deps: DataFrame) -> DataFrame:
    """Names with more than one version, with the versions."""
    found = deps.groupBy("name").agg(F.array_sort(F.collect_set("version")).alias("versions")).where(F.size("versions") > 1)
    return found.select("name", F.size("versions").cast("long").alias("n_versions"), F.array_join("versions", ",").alias("versions"))


def roots(packages: DataFrame) -> DataFrame:
    """Packages whose name is nobody's dependency."""
    used = dependency_pairs(packages).select(F.col("dependency").alias("name")).distinct()
    return packages.join(used, "name", "left_anti")


def statistics(deps: DataFrame) -> DataFrame:
    """One row: packages (name and version), names, names in conflict."""
    versions = deps.groupBy("name").agg(F.countDistinct("version").alias("v"))
    return versions.agg(F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("total_packages"), F.count("*").alias("unique_names"), F.count_if(F.col("v") > 1).alias("conflicts"))


def manager_counts(deps: DataFrame) -> DataFrame:
    """Packages (name and version) by package manager."""
    return deps.select("package_manager", "name", "version").distinct().groupBy("package_manager").agg(F.count("*").alias("n"))


def upward_chains(calls: DataFrame, targets: DataFrame, starts: int = 5, length: int = 5) -> DataFrame:
    """For each target the chains that start at its first callers and go on to the first caller of each: path and depth.

    A fixed number of joins with the table of first callers, which has one row for each element.
    """
    from tallgrass.operators.catalog import first_rows

    pairs = calls.select(F.col("callee_id").alias("at"), F.col("caller_id").alias("up")).distinct()
    first = pairs.groupBy("at").agg(F.min("up").alias("up"))
    begun = first_rows(pairs.join(targets.select(F.col("id").alias("at")), "at", "left_semi"), "at", ["up"], starts)
    chains = begun.select(F.col("at").alias("target_id"), F.array("at", "up").alias("path"))
    for _ in range(length - 1):
        nxt = first.select(F.col("at").alias("last"), F.col("up").alias("next"))
        joined = chains.withColumn("last", F.element_at("path", -1)).join(nxt, "last", "left")
        goes_on = F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))
        chains = joined.select("target_id", F.when(goes_on, F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"))
    return chains.select("target_id", "path", F.size("path").alias("depth"))
