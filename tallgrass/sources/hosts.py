"""Fact tables for queries over the star-schema tables: each is one plain SELECT that both Spark and DuckDB run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "h_service_rules": """SELECT 'api' AS family, p_partkey AS key, lpad(CAST(p_partkey AS STRING), 9, '0') AS word, concat('host-', lpad(CAST(p_partkey AS STRING), 9, '0'), '.example') AS pattern, p_brand, p_type, p_size FROM part
  UNION ALL SELECT 'env', p_partkey, lpad(CAST(p_partkey AS STRING), 9, '0'), concat('SKU', lpad(CAST(p_partkey AS STRING), 9, '0')), p_brand, p_type, p_size FROM part""",
    # a program and a settings file for each customer, with a line for each order
    "h_service_lines": """SELECT o_custkey % 25 AS repository_id, concat('c', CAST(o_custkey AS STRING), '/', CASE kind WHEN 'py' THEN 'main.py' ELSE '.env' END) AS path, kind, o_orderkey % 3000 AS key,
  row_number() OVER (PARTITION BY o_custkey, kind ORDER BY o_orderkey) AS line,
  CASE kind WHEN 'py' THEN concat('u = ', chr(39), 'https://host-', lpad(CAST(o_orderkey % 3000 AS STRING), 9, '0'), '.example/v1', chr(39)) ELSE concat('SKU', lpad(CAST(o_orderkey % 3000 AS STRING), 9, '0'), '_API_KEY=x') END AS line_text
  FROM (SELECT o_custkey, o_orderkey, 'py' AS kind FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'env' FROM orders) o""",
    "h_routes": """SELECT o_custkey % 25 AS repository_id, concat('c', CAST(o_custkey AS STRING), '/routes.js') AS path, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line,
  CASE o_orderkey % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'post' WHEN 2 THEN 'put' ELSE 'delete' END AS method FROM orders""",
    "h_suppliers": "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN concat('@v', CAST(s_nationkey AS STRING), '/', lower(replace(s_name, '#', '-'))) ELSE lower(replace(s_name, '#', '-')) END AS dep FROM supplier",
    # a line for each part, 500 lines a file and a series of files for each of five repositories; a supplier is named on one line
    "h_code_lines": """SELECT p_partkey % 5 AS repository_id, concat('src/f', CAST(CAST(floor(p_partkey / 2500) AS BIGINT) AS STRING), '.js') AS path,
  CAST(floor(p_partkey / 5) AS BIGINT) % 500 + 1 AS line, p_partkey AS element_id,
  CASE WHEN s_suppkey IS NULL THEN concat('function f', CAST(p_partkey AS STRING), '()')
    WHEN s_suppkey % 4 = 0 THEN concat('import x from ', chr(39), dep, chr(39), ';')
    ELSE concat('run(', chr(39), s_name, chr(39), ', ', dep, ')', CASE WHEN s_suppkey % 2 = 0 THEN concat(' // vendor-', CAST(s_nationkey AS STRING)) ELSE '' END) END AS line_text
  FROM part LEFT JOIN h_suppliers ON p_partkey = 17 * s_suppkey + 3""",
    "h_repositories": "SELECT n_nationkey AS id, n_name AS name, concat('region/', r_name) AS url, 'main' AS branch, (n_nationkey * 7) % 25 AS created_at, 'secret' AS auth_value FROM nation JOIN region ON n_regionkey = r_regionkey",
    "h_dependencies": """SELECT c_nationkey AS repository_id, p_name AS name, p_brand AS version, p_type AS package_manager,
  max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS is_dev, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 AS is_optional
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
  GROUP BY c_nationkey, p_name, p_brand, p_type""",
    "h_dependency_ids": "SELECT concat(CAST(repository_id AS STRING), '|', name, '|', version, '|', package_manager) AS id, repository_id, name, package_manager FROM h_dependencies",
    "h_services": """SELECT s_suppkey AS id, s_nationkey AS repository_id, s_name AS name, r_name AS provider,
  CASE s_suppkey % 5 WHEN 0 THEN 'database' WHEN 1 THEN 'api' WHEN 2 THEN 'auth' WHEN 3 THEN 'ai' ELSE 'cdn' END AS service_type,
  concat('src/f', CAST(s_suppkey % 7 AS STRING)) AS file_path, CAST(s_suppkey % 40 AS INT) AS line_number, CAST(s_suppkey % 8 + 3 AS DOUBLE) / 10 AS confidence
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "h_code_elements": "SELECT p_partkey AS id, p_partkey % 25 AS repository_id, p_name AS name, p_type AS element_type, p_brand AS file_path, p_size AS line_number, 'python' AS language FROM part",
    "h_code_calls": "SELECT DISTINCT a.l_partkey AS caller_id, b.l_partkey AS callee_id, a.l_linenumber AS line_number FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1",
    "h_relationships": """SELECT p_partkey AS code_element_id, CASE WHEN p_partkey % 3 = 0 THEN 'dependency' ELSE 'service' END AS target_type,
  CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 1 ELSE p_partkey % 13 END AS target_id, 'uses' AS relationship_type, CAST(p_size % 8 + 3 AS DOUBLE) / 10 AS confidence, p_brand AS evidence FROM part""",
    "h_package_dag": "SELECT p_partkey AS name, CAST(floor(p_partkey / 2.0) AS BIGINT) AS dependency FROM part WHERE p_partkey > 1 UNION SELECT p_partkey AS name, CAST(floor(p_partkey / 3.0) AS BIGINT) AS dependency FROM part WHERE p_partkey > 2",
    "h_endpoints": """SELECT page_id AS id, page_id % 25 AS repository_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path,
  CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method,
  CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'express' END AS framework, concat('api/f', CAST(page_id % 30 AS STRING)) AS file_path, CAST(page_id % 50 AS INT) AS line_number FROM pages""",
    "h_ports": """SELECT o_orderkey AS id, o_custkey % 25 AS repository_id, CAST(1024 + o_orderkey % 5000 AS INT) AS port,
  CASE o_orderkey % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'cache' ELSE 'http_server' END AS port_type,
  concat('api/f', CAST(o_custkey % 30 AS STRING)) AS file_path, CAST(o_orderkey % 60 AS INT) AS line_number, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS framework FROM orders""",
    "h_documentation": "SELECT doc_id AS id, doc_id % 25 AS repository_id, concat('docs/', source, '/', CAST(doc_id AS STRING), '.md') AS file_path, concat(source, '.md') AS file_name, source AS doc_type, lang AS title, substr(text, 101, 60) AS description, substr(text, 1, 500) AS content_preview, text AS content FROM documents",
    "h_security_entities": "SELECT c_custkey AS id, c_nationkey AS repository_id, c_mktsegment AS entity_type, c_name AS name FROM customer",
    "h_security_relationships": "SELECT DISTINCT o_custkey AS source_entity_id, (o_custkey * 7) % 149 AS target_entity_id, o_orderpriority AS relationship_type, o_custkey % 25 AS repository_id FROM orders",
    "h_vulnerabilities": """SELECT o_orderkey AS id, o_custkey % 25 AS repository_id, o_custkey AS entity_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' WHEN '4' THEN 'Low' ELSE 'Info' END AS severity FROM orders""",
    "h_tests": "SELECT event_id AS id, user_id % 25 AS repository_id, concat('test_', event_type) AS name, event_type AS test_framework, concat('tests/t', CAST(user_id % 50 AS STRING)) AS file_path, CAST(event_id % 300 AS INT) AS line_number FROM events",
    "h_tools": "SELECT s_suppkey AS id, s_nationkey AS repository_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'linter' ELSE 'build_tool' END AS tool_type, concat('c', CAST(s_suppkey % 6 AS STRING)) AS category FROM supplier",
    "h_tool_scripts": "SELECT p_partkey AS id, p_partkey % 100 AS tool_id, p_name AS name, p_type AS command FROM part",
    "h_progress": "SELECT user_id AS repository_id, event_id, event_type AS step_name, ts AS last_updated, value, CASE WHEN event_type IN ('purchase', 'logout') THEN 'complete' ELSE 'running' END AS status FROM events",
    "h_progress_events": """SELECT user_id AS repository_id, event_id, CASE event_id % 11 WHEN 0 THEN 'start' WHEN 5 THEN 'clear' WHEN 7 THEN 'complete' WHEN 8 THEN 'fail' WHEN 9 THEN 'message' ELSE 'update' END AS kind,
  CAST(CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id % 12 END AS INT) AS step, CAST(CASE WHEN event_id % 11 = 0 THEN 11 END AS INT) AS total_steps, event_type AS step_name, concat('m', CAST(event_id AS STRING)) AS message, ts AS at FROM events""",
    "h_keys": "SELECT c_custkey AS id, c_nationkey AS repository_id, CASE c_custkey % 6 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' WHEN 2 THEN 'supplier#00' WHEN 3 THEN NULL ELSE 'generic' END AS provider, concat('Brand#', CAST(c_custkey % 5 + 1 AS STRING), CAST(c_custkey % 5 + 1 AS STRING)) AS file_path, CAST(c_custkey % 200 AS INT) AS line_number FROM customer",
    "h_nodes": """SELECT concat('r', CAST(n_nationkey AS STRING)) AS id, CAST(n_nationkey AS BIGINT) AS repository_id, 'repository' AS node_type, n_name AS name FROM nation
  UNION ALL SELECT concat('c', CAST(p_partkey AS STRING)), CAST(p_partkey % 25 AS BIGINT), 'code_element', p_name FROM part""",
    "h_edges": """SELECT concat('c', CAST(caller_id AS STRING)) AS source_node_id, concat('c', CAST(callee_id AS STRING)) AS target_node_id, 'related_to' AS edge_type FROM h_code_calls
  UNION ALL SELECT concat('r', CAST(p_partkey % 25 AS STRING)), concat('c', CAST(p_partkey AS STRING)), 'has_dependency' FROM part""",
}


def parts_of(sql: str) -> list[str]:
    """The views that sql needs, each after those that it needs itself."""
    out: list[str] = []
    for name in re.findall(r"\bh_\w+", sql):
        if name in VIEWS and name not in out:
            for x in [*parts_of(VIEWS[name]), name]:
                if x not in out:
                    out.append(x)
    return out


def with_views(sql: str) -> str:
    """sql for DuckDB, with the views that it names."""
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in parts_of(sql))
    if not views:
        return sql
    bare = sql.lstrip()
    return f"WITH RECURSIVE {views}, {bare[14:].lstrip()}" if bare.upper().startswith("WITH RECURSIVE") else f"WITH {views}, {bare[4:].lstrip()}" if bare.upper().startswith("WITH ") else f"WITH {views}\n{bare}"


class Hosts:
    """hosts.services and so on, as DataFrames over the tables at sf_dir."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {n: self.table(n) for n in TABLES if re.search(rf"\b{n}\b", text)}
        used |= {n: self.sql(VIEWS[n]) for n in VIEWS if re.search(rf"\b{n}\b", text)}
        marked = re.sub(rf"(?<=FROM |JOIN )({'|'.join(used)})\b", r"{\1}", text)
        return self.spark.sql(marked, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if f"h_{name}" not in VIEWS:
            raise AttributeError(name)
        return self.sql(VIEWS[f"h_{name}"])
