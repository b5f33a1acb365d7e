"""Merges, counts and statistics. "First wins" always names its order; counts are pre-aggregated by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.catalog import first_rows

GROUP_LIMITS = {"dependencies": 50, "services": 30, "security": 20, "code": 50, "endpoints": 100}


def counts_by(df: DataFrame, column: str | Column, name: str | None = None) -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    return df.groupBy(c.alias(name or (column if isinstance(column, str) else "value"))).agg(F.count("*").alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In and out degree together. A loop counts twice, a lone node 0, and an end that is no node is there too."""
    ends = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "full_outer").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def top_degrees(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(k)


def merged_services(df: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each repository, name, provider and type: the first row's id, the highest confidence with its line, all files."""
    best = F.max_by(F.struct("confidence", "line_number"), F.struct("confidence", -F.col(order)))
    return df.groupBy("repository_id", "name", "provider", "service_type").agg(
        F.min_by("id", order).alias("id"),
        best["confidence"].alias("confidence"),
        best["line_number"].alias("line_number"),
        F.array_join(F.array_sort(F.collect_set("file_path")), ",").alias("file_paths"),
    )


def merged_tools(df: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each repository, name, category and type: scripts united by name (the first wins), settings by key (the last wins)."""
    keys = ["repository_id", "name", "category", "tool_type"]
    base = df.groupBy(*keys).agg(F.min_by("id", order).alias("id"), F.max("confidence").alias("confidence"))
    scripts = df.select(*keys, order, F.posexplode("scripts").alias("k", "s")).groupBy(*keys, F.col("s.name").alias("script")).agg(F.min_by("s", F.struct(order, "k")).alias("s"))
    scripts = scripts.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("scripts"))
    config = df.select(*keys, order, F.explode("configuration").alias("key", "value")).groupBy(*keys, "key").agg(F.max_by("value", order).alias("value"))
    config = config.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("configuration"))
    null_safe = lambda a, b: a.join(b, keys, "left")
    out = null_safe(null_safe(base, scripts), config)
    return out.withColumns({"scripts": F.coalesce("scripts", F.array().cast(scripts.schema["scripts"].dataType)), "configuration": F.coalesce("configuration", F.create_map().cast("map<string,string>"))})


def deduplicated(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row by the order for each key."""
    return first_rows(df, keys, order, 1)


def report_groups(df: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """Each group's count with its first rows, for a report's section."""
    sizes = counts_by(df, group)
    return first_rows(df, group, order, limit).join(sizes, group)


def evidence(parts: list[tuple[Column, float, Column]], least: float = 0.3) -> tuple[Column, Column]:
    """Confidence and evidence text from (condition, weight, text): weights add up to 1 at most; null below `least`."""
    total = F.lit(0).cast("decimal(6,2)")
    for condition, weight, _ in parts:
        total = total + F.when(condition, F.lit(str(weight)).cast("decimal(6,2)")).otherwise(F.lit(0).cast("decimal(6,2)"))
    text = F.array_join(F.array_compact(F.array(*[F.when(c, t) for c, _, t in parts])), "; ")
    kept = total >= F.lit(str(least)).cast("decimal(6,2)")
    return F.when(kept, F.least(total, F.lit("1.00").cast("decimal(6,2)")).cast("double")), F.when(kept, text)


def risk_level(affected: Column, depth: Column) -> Column:
    return F.when((affected > 10) | (depth > 4), "high").when((affected > 5) | (depth > 2), "medium").otherwise("low")


def run_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """The numbers of an analysis: totals by table, and counts by the columns that the summary names. One union."""
    by = {"code_elements": ("element_type", "language"), "tests": ("test_framework",), "security_entities": ("entity_type",), "dependencies": ("package_manager",), "services": ("provider",)}
    parts = []
    for name, df in tables.items():
        parts.append(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), F.lit("total").alias("value"), "n"))
        for c in by.get(name, ()):
            parts.append(counts_by(df, c, "value").select(F.lit(f"{name}.{c}").alias("measure"), F.coalesce(F.col("value").cast("string"), F.lit("unknown")).alias("value"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
