"""Catalog queries: filters, searches, lookups and list pages over the fact tables.

Filters are columns that are put together before anything runs, so that they reach the scan; a filter that isn't given
is not there. Every limit is of the feature (a page, ten peers) and has a total order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallgrass.functions.text import folded_like

PAGE = 50
PEERS = 10
SEVERITIES = ("Critical", "High", "Medium", "Low")


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """df where every given condition holds; a null condition never does."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def equal(name: str, value) -> Column | None:
    return None if value is None else F.col(name) == value


def contains(name: str, value: str | None) -> Column | None:
    """Case-sensitive."""
    return None if value is None else F.col(name).contains(value)


def folded(name: str, value: str | None) -> Column | None:
    """Equal but for case."""
    return None if value is None else F.lower(name) == value.lower()


def like(name: str, value: str | None) -> Column | None:
    """Anywhere in the text, A-Z folded; % and _ of the value are wildcards."""
    return None if value is None else folded_like(F.col(name), f"%{value}%")


def by_id(df: DataFrame, key, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == key).limit(1)


def repositories(df: DataFrame, root: str = "/data/repos") -> DataFrame:
    """Newest first, without credentials, with the local path."""
    shown = [c for c in df.columns if c not in ("auth_type", "auth_value")]
    return df.select(*shown, F.concat_ws("/", F.lit(root), "name").alias("local_path")).orderBy(F.desc("created_at"), "id")


def dependencies(df: DataFrame, repository_id=None, name: str | None = None, package_manager: str | None = None, is_dev: bool | None = None) -> DataFrame:
    return where_all(df, equal("repository_id", repository_id), contains("name", name), equal("package_manager", package_manager), equal("is_dev", is_dev)).orderBy("package_manager", "name", "version")


def services(df: DataFrame, repository_id=None, provider: str | None = None, service_type: str | None = None) -> DataFrame:
    return where_all(df, equal("repository_id", repository_id), equal("provider", provider), equal("service_type", service_type)).orderBy("provider", "name", "id")


def code_elements(df: DataFrame, repository_id=None, element_type: str | None = None, exact: bool = False) -> DataFrame:
    chosen = equal("element_type", element_type) if exact else folded("element_type", element_type)
    return where_all(df, equal("repository_id", repository_id), chosen).orderBy("file_path", "line_number", "id")


def code_calls(df: DataFrame, repository_id=None) -> DataFrame:
    return where_all(df, equal("repository_id", repository_id)).orderBy("line_number", "caller_id", "callee_id")


def code_relationships(df: DataFrame, element=None, target_type: str | None = None, target_id=None) -> DataFrame:
    """Of an element, or of a target; one of the two has to be named."""
    if element is not None:
        return df.where(F.col("code_element_id") == element)
    if target_type is None or target_id is None:
        raise ValueError("name code_element_id, or target_type and target_id")
    return df.where((F.col("target_type") == target_type) & (F.col("target_id") == target_id))


def security_entities(df: DataFrame, repository_id=None, entity_type: str | None = None) -> DataFrame:
    return where_all(df, equal("repository_id", repository_id), equal("entity_type", entity_type)).orderBy("entity_type", "name", "id")


def security_relationships(df: DataFrame, repository_id=None) -> DataFrame:
    return where_all(df, equal("repository_id", repository_id)).orderBy("relationship_type", "source_entity_id", "target_entity_id")


def severity_rank(c: Column) -> Column:
    return reduce(lambda a, p: a.when(c == p[1], p[0] + 1), list(enumerate(SEVERITIES))[1:], F.when(c == SEVERITIES[0], 1)).otherwise(5)


def vulnerabilities(df: DataFrame, repository_id=None, severity: str | None = None) -> DataFrame:
    return where_all(df, equal("repository_id", repository_id), equal("severity", severity)).orderBy(severity_rank(F.col("severity")), "id")


def ports(df: DataFrame, repository_id=None, port: int | None = None, port_type: str | None = None, framework: str | None = None) -> DataFrame:
    return where_all(df, equal("repository_id", repository_id), equal("port", port), equal("port_type", port_type), equal("framework", framework)).orderBy("port", "id")


def endpoints(df: DataFrame, repository_id=None, path: str | None = None, method: str | None = None, framework: str | None = None) -> DataFrame:
    return where_all(df, equal("repository_id", repository_id), contains("path", path), folded("method", method), equal("framework", framework)).orderBy("path", "method", "id")


def search_dependencies(df: DataFrame, name: str, version: str | None = None) -> DataFrame:
    """Exact name, in all repositories."""
    return where_all(df, equal("name", name), equal("version", version))


def search_services(df: DataFrame, provider: str | None = None, service_type: str | None = None) -> DataFrame:
    """The first parameter present decides."""
    return df.where(equal("provider", provider) if provider is not None else equal("service_type", service_type))


def search_ports(df: DataFrame, port: int | None = None, port_type: str | None = None, repository_id=None) -> DataFrame:
    return where_all(df, equal("port", port) if port is not None else equal("port_type", port_type), equal("repository_id", repository_id))


def search_endpoints(df: DataFrame, path: str | None = None, method: str | None = None, framework: str | None = None, repository_id=None) -> DataFrame:
    """The first of path, method and framework that is present decides."""
    chosen = like("path", path) if path is not None else equal("method", method) if method is not None else equal("framework", framework)
    return where_all(df, chosen, equal("repository_id", repository_id))


def search_documentation(df: DataFrame, query: str, repository_id=None) -> DataFrame:
    if not query:
        raise ValueError("an empty query")
    fields = [like(c, query) for c in ("file_name", "title", "description", "content_preview") if c in df.columns]
    return where_all(df, reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in fields]), equal("repository_id", repository_id))


def documentation(df: DataFrame, repository_id=None, doc_type: str | None = None) -> DataFrame:
    return where_all(df, equal("repository_id", repository_id), equal("doc_type", doc_type)).orderBy("file_path")


def tests(df: DataFrame, repository_id=None, framework: str | None = None) -> DataFrame:
    return where_all(df, equal("repository_id", repository_id), equal("test_framework", framework)).orderBy("file_path", "line_number", "id")


def tools(df: DataFrame, repository_id=None, category: str | None = None, tool_type: str | None = None, name: str | None = None) -> DataFrame:
    return where_all(df, equal("repository_id", repository_id), equal("category", category), equal("tool_type", tool_type), contains("name", name)).orderBy("name", "id")


@dataclass(frozen=True)
class ListConfig:
    """What a list page searches and groups by."""

    search: tuple[str, ...]
    groups: dict[str, Column] = field(default_factory=dict)
    name: str = "name"


def list_configs() -> dict[str, ListConfig]:
    """By entity. Made where a session exists, since group keys are columns."""
    folder = lambda c: F.when(F.col(c).contains("/"), F.regexp_extract(c, "^(.*)/[^/]*$", 1)).otherwise(F.lit("root"))
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    return {
        "dependencies": ListConfig(("name", "version", "package_manager"), {"package_manager": known("package_manager"), "is_dev": F.when(F.col("is_dev"), "dev").otherwise("prod")}),
        "services": ListConfig(("name", "provider", "service_type"), {"provider": known("provider"), "service_type": known("service_type")}),
        "code_elements": ListConfig(("name", "element_type", "file_path"), {"element_type": known("element_type"), "language": known("language"), "folder": folder("file_path")}),
        "security_entities": ListConfig(("name", "entity_type"), {"entity_type": known("entity_type")}),
        "tools": ListConfig(("name", "tool_type", "category"), {"category": known("category"), "tool_type": known("tool_type")}),
        "tests": ListConfig(("name", "test_framework", "file_path"), {"test_framework": known("test_framework"), "folder": folder("file_path")}),
        "documentation": ListConfig(("file_name", "title", "description"), {"doc_type": known("doc_type")}, "file_name"),
        "ports": ListConfig(("port", "port_type", "framework"), {"port_type": known("port_type"), "framework": known("framework")}, "port"),
        "endpoints": ListConfig(("path", "method", "framework"), {"method": known("method"), "framework": known("framework")}, "path"),
    }


def list_matches(df: DataFrame, config: ListConfig, filters: dict | None = None, term: str | None = None) -> DataFrame:
    out = where_all(df, *[equal(k, v) for k, v in (filters or {}).items()])
    if term:
        hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(term.lower()), F.lit(False)) for c in config.search]
        out = out.where(reduce(lambda a, b: a | b, hits))
    return out


def list_page(df: DataFrame, config: ListConfig, filters: dict | None = None, term: str | None = None, page: int = PAGE) -> DataFrame:
    """The page's rows, by name in the Unicode collation, then by id."""
    order = F.collate(F.col(config.name).cast("string"), "UNICODE")
    return list_matches(df, config, filters, term).orderBy(order, F.col(config.name).cast("string"), "id").limit(page)


def list_groups(df: DataFrame, config: ListConfig, group: str, filters: dict | None = None, term: str | None = None) -> DataFrame:
    return list_matches(df, config, filters, term).groupBy(config.groups[group].alias("group_key")).agg(F.count("*").alias("n"))


def union_search(deps: DataFrame, svcs: DataFrame, term: str) -> DataFrame:
    """Dependencies and services whose name holds the term, in one shape."""
    hit = F.lower("name").contains(term.lower())
    a = deps.where(hit).select(F.lit("dependency").alias("type"), "name", F.col("version").alias("detail"), F.concat_ws(" ", "package_manager", F.lit("package")).alias("description"))
    b = svcs.where(hit).select(F.lit("service").alias("type"), "name", F.col("provider").alias("detail"), F.concat_ws(" ", "service_type", F.lit("service")).alias("description"))
    return a.unionByName(b)


def options(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value")


def first_rows(df: DataFrame, group: str | list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    keys = [group] if isinstance(group, str) else group
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def peers(df: DataFrame, group: str | list[str], k: int = PEERS) -> DataFrame:
    """For every row the first k others of its group, by id: pairs (id, peer_id).

    The first k + 1 of a group hold the k first others of every member, so that a group of n gives n x k rows, never n x n.
    """
    keys = [group] if isinstance(group, str) else group
    head = first_rows(df.select(*keys, F.col("id").alias("peer_id")), keys, ["peer_id"], k + 1)
    lists = head.groupBy(*keys).agg(F.array_sort(F.collect_list("peer_id")).alias("head"))
    each = df.select(*keys, "id").join(lists, keys)
    return each.select("id", F.explode(F.slice(F.filter("head", lambda p: p != F.col("id")), 1, k)).alias("peer_id"))


def dashboard(df: DataFrame, k: int = 10) -> DataFrame:
    """The k newest repositories."""
    return df.orderBy(F.desc("created_at"), "id").limit(k)
