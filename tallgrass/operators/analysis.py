"""One analysis from files to graph: detectors, relations, the property graph and a summary, for all repositories at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import stable_id
from tallgrass.operators import code, docs, endpoints, manifests, ports, relate, secrets, security, services, tests, tools
from tallgrass.operators.aggregates import run_summary
from tallgrass.operators.graph import build_graph
from tallgrass.operators.packages import saved
from tallgrass.operators.versions import commit
from tallgrass.sources.rules import Rules


def with_ids(deps: DataFrame) -> DataFrame:
    return deps.withColumn("id", stable_id(F.lit("dependency"), *[F.col(c) for c in ("repository_id", "package_manager", "name", "version", "file_path")]))


def facts(files: DataFrame, rules: Rules | None = None) -> dict[str, DataFrame]:
    """The fact tables, each written once: every detector reads the files once."""
    deps = saved(with_ids(manifests.dependencies(files)))
    t = {"dependencies": deps, "services": saved(services.detect_services(files, deps, rules)), "tools": saved(tools.detect_tools(files, deps))}
    t["code_elements"] = saved(code.code_elements(files))
    t |= {"tests": saved(tests.detect_tests(files)), "ports": saved(ports.detect_ports(files)), "endpoints": saved(endpoints.detect_endpoints(files)), "documentation": saved(docs.index_documentation(files))}
    entities, relations, findings = (saved(x) for x in security.detect_security(files))
    keys = saved(secrets.detect_keys(files, t["code_elements"]))
    t["keys"], t["security_relationships"] = keys, relations
    t["security_entities"] = saved(entities.unionByName(secrets.key_entities(keys), allowMissingColumns=True))
    t["vulnerabilities"] = saved(findings.unionByName(secrets.key_vulnerabilities(keys), allowMissingColumns=True))
    e = t["code_elements"]
    index = relate.word_index(files)  # once for both
    t["code_relationships"] = saved(relate.service_relationships(e, files, t["services"], index).unionByName(relate.dependency_relationships(e, files, deps, index)))
    return t


def analyse(files: DataFrame, repositories: DataFrame, rules: Rules | None = None, root: str | None = None) -> dict[str, DataFrame]:
    """The fact tables, `nodes`, `edges` and `summary` of prepared files; committed to the catalog below root, where given, in place of the repositories' earlier rows."""
    t = facts(files, rules)
    nodes, edges = build_graph({"repositories": repositories, **t})
    t |= {"nodes": saved(nodes), "edges": saved(edges)}
    if root is not None:
        commit(files.sparkSession, root, {k: v for k, v in t.items() if "repository_id" in v.columns}, repositories.select(F.col("id").alias("repository_id")))
    t["summary"] = run_summary({k: t[k] for k in ("dependencies", "services", "tools", "code_elements", "tests", "ports", "endpoints", "security_entities", "vulnerabilities")})
    return t
