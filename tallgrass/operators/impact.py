"""Change impact: who is affected by changing an element, along which chains, and how risky that is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.aggregates import risk_level
from tallgrass.operators.packages import upward_chains

ADVICE = {"high": "Plan a staged change with tests for every caller.", "medium": "Update the callers together and run their tests.", "low": "A direct change is safe."}


def affected(calls: DataFrame, relationships: DataFrame, elements: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, affected_id, affected_name): callers of the target, and elements related to it."""
    ids = targets.select(F.col("id").alias("target_id"))
    by_call = calls.select(F.col("callee_id").alias("target_id"), F.col("caller_id").alias("affected_id")).join(ids, "target_id", "left_semi")
    by_relation = relationships.select("target_id", F.col("code_element_id").alias("affected_id")).join(ids, "target_id", "left_semi")
    return by_call.unionByName(by_relation).distinct().join(elements.select(F.col("id").alias("affected_id"), F.col("name").alias("affected_name")), "affected_id")


def impact(calls: DataFrame, relationships: DataFrame, elements: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: how many are affected, the deepest chain, the risk, and advice."""
    n = affected(calls, relationships, elements, targets).groupBy("target_id").agg(F.countDistinct("affected_id").alias("n_affected"))
    deep = upward_chains(calls, targets).groupBy("target_id").agg(F.max("depth").cast("long").alias("max_depth"), F.count("*").alias("n_chains"))
    base = targets.select(F.col("id").alias("target_id"), "name").join(n, "target_id", "left").join(deep, "target_id", "left")
    base = base.fillna(0, ["n_affected", "max_depth", "n_chains"])
    risk = risk_level(F.col("n_affected"), F.col("max_depth"))
    told = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    return base.withColumn("risk", risk).withColumn("advice", F.element_at(told, F.col("risk")))
