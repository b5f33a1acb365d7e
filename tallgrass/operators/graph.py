"""The property graph of a repository's facts: node and edge tables, and questions about them.

Node ids are hashes of (repository, type, key), so that an edge's ends are computed, not looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import stable_id
from tallgrass.operators.aggregates import counts_by, top_degrees
from tallgrass.operators.catalog import first_rows
from tallgrass.operators.joins import endpoint_first_port, shown_elements, tool_dependencies

NODE_TYPES = ("repository", "dependency", "service", "package_manager", "service_provider", "tool", "code_element", "security_entity", "test", "test_framework", "port", "endpoint")
EDGE_TYPES = ("depends_on", "uses_service", "has_dependency", "uses_package_manager", "provided_by", "uses_tool", "tool_uses_dependency", "tool_uses_service", "tool_generates", "code_uses_service", "code_uses_dependency", "has_test", "test_uses_framework", "test_tests_code", "has_port", "has_endpoint", "endpoint_uses_port", "related_to")
NODE = ("id", "repository_id", "node_type", "name", "properties")
EDGE = ("id", "repository_id", "source_node_id", "target_node_id", "edge_type", "properties")


def known_type(c: Column, types: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*types), c).otherwise(F.lit(default))


def node_id(kind: str, *key) -> Column:
    return stable_id(F.col("repository_id"), F.lit(kind), *[F.col(k) if isinstance(k, str) else k for k in key])


def flattened(config: Column) -> Column:
    """A settings map with its keys prefixed; null values are left out."""
    return F.transform_keys(F.map_filter(config, lambda k, v: v.isNotNull()), lambda k, v: F.concat(F.lit("config_"), k))


def nodes_of(df: DataFrame, kind: str, key: list, name, properties: dict | None = None, config: Column | None = None) -> DataFrame:
    pairs = [x for k, v in (properties or {}).items() for x in (F.lit(k), (F.col(v) if isinstance(v, str) else v).cast("string"))]
    props = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    props = F.map_concat(props, flattened(config)) if config is not None else props
    named = F.col(name) if isinstance(name, str) else name
    return df.select(node_id(kind, *key).alias("id"), "repository_id", F.lit(kind).alias("node_type"), named.cast("string").alias("name"), props.alias("properties"))


def edges_of(df: DataFrame, source: Column, target: Column, kind: str, properties: Column | None = None) -> DataFrame:
    props = F.create_map().cast("map<string,string>") if properties is None else properties
    out = df.select("repository_id", source.alias("source_node_id"), target.alias("target_node_id"), F.lit(kind).alias("edge_type"), props.alias("properties"))
    return out.select(stable_id(F.col("repository_id"), F.col("edge_type"), F.col("source_node_id"), F.col("target_node_id"), F.to_json("properties")).alias("id"), *EDGE[1:])


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_graph(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all repositories from the fact tables; a table that isn't there adds nothing."""
    repo = node_id("repository")
    nodes, edges = [], []
    t = tables
    repos = t["repositories"].select(F.col("id").alias("repository_id"), "name", *(["url"] if "url" in t["repositories"].columns else []))
    nodes.append(nodes_of(repos, "repository", [], "name", {"url": "url"} if "url" in repos.columns else None))
    if "dependencies" in t:
        d = t["dependencies"]
        managers = d.select("repository_id", "package_manager").distinct()
        first = first_rows(d, ["repository_id", "name"], ["package_manager", "version", "is_dev"], 1)
        nodes.append(nodes_of(managers, "package_manager", ["package_manager"], "package_manager"))
        nodes.append(nodes_of(first, "dependency", ["name"], "name", {"version": "version", "package_manager": "package_manager", "is_dev": "is_dev", "is_optional": "is_optional"}))
        edges.append(edges_of(managers, repo, node_id("package_manager", "package_manager"), "uses_package_manager"))
        edges.append(edges_of(d, node_id("dependency", "name"), node_id("package_manager", "package_manager"), "uses_package_manager"))
    if "services" in t:
        s = t["services"]
        providers = s.select("repository_id", "provider").distinct()
        config = F.col("configuration") if "configuration" in s.columns else None
        nodes.append(nodes_of(providers, "service_provider", ["provider"], "provider"))
        nodes.append(nodes_of(s, "service", ["id"], "name", {"provider": "provider", "service_type": "service_type", "confidence": "confidence"}, config))
        edges.append(edges_of(s, repo, node_id("service", "id"), "uses_service"))
        edges.append(edges_of(s, node_id("service", "id"), node_id("service_provider", "provider"), "provided_by"))
    if "tests" in t:
        x = t["tests"]
        frameworks = x.select("repository_id", "test_framework").distinct()
        nodes.append(nodes_of(frameworks, "test_framework", ["test_framework"], "test_framework"))
        nodes.append(nodes_of(x, "test", ["id"], "name", {"file_path": "file_path", "line_number": "line_number"}))
        edges.append(edges_of(x, repo, node_id("test", "id"), "has_test"))
        edges.append(edges_of(x, node_id("test", "id"), node_id("test_framework", "test_framework"), "test_uses_framework"))
    if "tools" in t:
        x = t["tools"]
        config = F.col("configuration") if "configuration" in x.columns else None
        nodes.append(nodes_of(x, "tool", ["id"], "name", {"tool_type": "tool_type", "category": "category"}, config))
        edges.append(edges_of(x, repo, node_id("tool", "id"), "uses_tool"))
        if "dependencies" in t:
            own = tool_dependencies(x, t["dependencies"])
            edges.append(edges_of(own, node_id("tool", "tool_id"), node_id("dependency", "name"), "tool_uses_dependency"))
    if "code_elements" in t:
        e, r = t["code_elements"], t.get("code_relationships")
        if r is None:
            used = e.where(F.col("element_type") == "module")
        else:
            used = shown_elements(e, r)
            props = F.create_map(F.lit("confidence"), F.col("confidence").cast("string"), F.lit("evidence"), F.col("evidence"))
            r = r.join(used.select(F.col("id").alias("code_element_id")), "code_element_id", "left_semi")
            if "services" in t:
                ids = t["services"].select(F.col("id").alias("target_id")).distinct()
                to_service = r.where(F.col("target_type") == "service").join(ids, "target_id", "left_semi")
                edges.append(edges_of(to_service, node_id("code_element", "code_element_id"), node_id("service", "target_id"), "code_uses_service", props))
            if "dependencies" in t and "id" in t["dependencies"].columns:
                names = t["dependencies"].select(F.col("id").alias("target_id"), "name")
                to_dep = r.where(F.col("target_type") == "dependency").join(names, "target_id")
                edges.append(edges_of(to_dep, node_id("code_element", "code_element_id"), node_id("dependency", "name"), "code_uses_dependency", props))
        nodes.append(nodes_of(used, "code_element", ["id"], "name", {"element_type": "element_type", "file_path": "file_path", "line_number": "line_number", "language": "language"}))
    if "ports" in t:
        p = t["ports"]
        first = first_rows(p, ["repository_id", "port"], ["file_path", F.col("line_number").asc_nulls_first(), "id"], 1)
        nodes.append(nodes_of(first, "port", ["port"], "port", {"port_type": "port_type", "framework": "framework"}))
        edges.append(edges_of(p, repo, node_id("port", "port"), "has_port", F.create_map(F.lit("file_path"), F.col("file_path"))))
    if "endpoints" in t:
        x = t["endpoints"]
        first = first_rows(x, ["repository_id", "method", "path"], ["file_path", F.col("line_number").asc_nulls_first(), "id"], 1)
        nodes.append(nodes_of(first, "endpoint", ["method", "path"], F.concat_ws(" ", "method", "path"), {"framework": "framework", "handler": "handler"} if "handler" in x.columns else {"framework": "framework"}))
        edges.append(edges_of(x, repo, node_id("endpoint", "method", "path"), "has_endpoint", F.create_map(F.lit("file_path"), F.col("file_path"))))
        if "ports" in t:
            near = endpoint_first_port(x, t["ports"]).join(x.select(F.col("id").alias("endpoint_id"), "method", "path"), "endpoint_id")
            edges.append(edges_of(near, node_id("endpoint", "method", "path"), node_id("port", "port"), "endpoint_uses_port"))
    return union(nodes), union(edges)


def nodes_by_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("node_type") == node_type)


def incident_edges(edges: DataFrame, node) -> DataFrame:
    return edges.where((F.col("source_node_id") == node) | (F.col("target_node_id") == node))


def neighbors(nodes: DataFrame, edges: DataFrame, node) -> DataFrame:
    """Nodes at the other end of an edge of this node, each once; none for an unknown node."""
    out = edges.where(F.col("source_node_id") == node).select(F.col("target_node_id").alias("id"))
    back = edges.where(F.col("target_node_id") == node).select(F.col("source_node_id").alias("id"))
    return nodes.join(out.union(back).distinct(), "id", "left_semi")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """measure, value, n: totals, and counts by type."""
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), F.lit("total").alias("value"), "n")
    by = lambda df, c, name: counts_by(df, c, "value").select(F.lit(name).alias("measure"), "value", "n")
    return union([total(nodes, "nodes"), total(edges, "edges"), by(nodes, "node_type", "nodes_by_type"), by(edges, "edge_type", "edges_by_type")])


def most_connected(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of highest degree, with names where they have one."""
    top = top_degrees(nodes, edges, k)
    return top.join(nodes.select("id", "name"), "id", "left").orderBy(F.desc("degree"), "id")


def rolled_up(nodes: DataFrame, edges: DataFrame, expanded: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Code elements as one parent for each element type with a count; those of expanded types stay, below their parent.

    Edges that touch a collapsed node go.
    """
    kind = F.coalesce(F.try_element_at("properties", F.lit("element_type")), F.lit("unknown"))
    code = nodes.where(F.col("node_type") == "code_element").withColumn("kind", kind)
    parent_id = stable_id(F.col("repository_id"), F.lit("code_group"), F.col("kind"))
    parents = code.groupBy("repository_id", "kind").agg(F.count("*").alias("n"))
    parents = parents.select(parent_id.alias("id"), "repository_id", F.lit("code_group").alias("node_type"), F.col("kind").alias("name"), F.create_map(F.lit("count"), F.col("n").cast("string")).alias("properties"))
    open_ = F.col("kind").isin(*expanded) if expanded else F.lit(False)
    shown = nodes.where(F.col("node_type") != "code_element").unionByName(code.where(open_).drop("kind"))
    ids = shown.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_semi").join(ids.withColumnRenamed("id", "target_node_id"), "target_node_id", "left_semi")
    child = edges_of(code.where(open_), parent_id, F.col("id"), "has_child")
    return shown.unionByName(parents), kept.select(*EDGE).unionByName(child)
