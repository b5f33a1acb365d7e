"""The catalog's joins. A join on one key or another is a union of two equi-joins, so that none is a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import grams
from tallgrass.operators.catalog import first_rows

BAND = 50
#: Ids of one line that meet others together.
PACK = 1024
KEYS = 20


def edges_in_repository(edges: DataFrame, nodes: DataFrame, repository_id) -> DataFrame:
    """Edges both of whose ends are nodes of the repository."""
    own = nodes.where(F.col("repository_id") == repository_id).select("id")
    return edges.join(own.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_semi").join(own.withColumnRenamed("id", "target_node_id"), "target_node_id", "left_semi")


def tool_scripts(scripts: DataFrame, tools: DataFrame, repository_id) -> DataFrame:
    own = tools.where(F.col("repository_id") == repository_id).select(F.col("id").alias("tool_id"), F.col("name").alias("tool_name"))
    return scripts.join(own, "tool_id").orderBy("tool_name", "name")


def edges_touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among the nodes, each once."""
    ids = nodes.select("id").distinct()
    source = edges.join(ids.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_semi")
    target = edges.join(ids.withColumnRenamed("id", "target_node_id"), "target_node_id", "left_semi")
    return source.unionByName(target).distinct()


def endpoint_first_port(endpoints: DataFrame, ports: DataFrame) -> DataFrame:
    """For each endpoint the first port in its file, by line and number."""
    first = first_rows(ports.select("repository_id", "file_path", F.col("id").alias("port_id"), "port", "line_number"), ["repository_id", "file_path"], [F.col("line_number").asc_nulls_first(), "port", "port_id"], 1)
    return endpoints.select(F.col("id").alias("endpoint_id"), "repository_id", "file_path").join(first.drop("line_number"), ["repository_id", "file_path"])


def key_services(keys: DataFrame, services: DataFrame, k: int = 10) -> DataFrame:
    """For each API key the services of its provider, and those whose name holds the provider's (underscores removed).

    The second half joins on the provider as well: names are looked up in the distinct providers of keys, which the
    vocabulary bounds, and only then joined to keys.
    """
    providers = keys.where(F.col("provider").isNotNull()).select("repository_id", "provider").distinct()
    s = services.select("repository_id", F.col("name").alias("service"), F.col("provider").alias("s_provider"))
    same = providers.join(s, (providers["provider"] == s["s_provider"]) & (providers["repository_id"] == s["repository_id"])).select(providers["repository_id"], providers["provider"], "service")
    held = providers.join(s, "repository_id").where(F.contains(F.lower("service"), F.lower(F.replace(F.col("provider"), F.lit("_"), F.lit(""))))).select("repository_id", "provider", "service")
    lists = same.union(held).groupBy("repository_id", "provider").agg(F.slice(F.array_sort(F.collect_set("service")), 1, k).alias("related_services"))
    return keys.select("id", "repository_id", "provider").join(lists, ["repository_id", "provider"], "left").select("id", F.coalesce("related_services", F.array().cast("array<string>")).alias("related_services"))


def key_band(keys: DataFrame, elements: DataFrame, band: int = BAND) -> DataFrame:
    """API keys with the elements of their file within `band` lines.

    Rows of one line of a file are packed in lists of about `PACK` ids, and lists meet: lines are dealt into bins of the
    band's width, and a list of keys looks into its own bin and the two beside it. Pairs of lists are spread over all tasks
    before ids meet, so that a few files or lines that hold most rows are no few tasks' work, and no pair of ids is moved.
    """
    k = _packed(keys.select(F.col("id").alias("key_id"), "file_path", F.col("line_number").alias("key_line")), "key_id", "key_line")
    k = k.withColumn("bin", F.explode(F.array(*[F.floor(F.col("key_line") / band) + d for d in (-1, 0, 1)])))
    e = _packed(elements.select(F.col("id").alias("element_id"), "file_path", F.col("line_number").alias("element_line")), "element_id", "element_line").withColumn("bin", F.floor(F.col("element_line") / band))
    met = k.join(e, ["file_path", "bin"]).where(F.abs(F.col("key_line") - F.col("element_line")) <= band).select("key_ids", "element_ids")
    # a number of tasks by itself, which no later step joins: lists are small, what they give is not
    tasks = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = met.repartition(tasks).select(F.inline("key_ids"), "element_ids")
    # to as many tasks, so nothing moves: it ends the compiled loop, which would hold all pairs of two lists before it passes one on
    return each.coalesce(tasks).select("key_id", F.inline("element_ids"))


def _packed(rows: DataFrame, name: str, line: str) -> DataFrame:
    """Lists `name`s of about PACK ids of one line of a file at most."""
    lists = rows.where(F.col("file_path").isNotNull() & F.col(line).isNotNull()).groupBy("file_path", line).agg(F.ceil(F.count("*") / PACK).alias("lists"))
    dealt = rows.join(lists, ["file_path", line]).withColumn("list", F.pmod(F.xxhash64(name), "lists"))
    return dealt.groupBy("file_path", line, "list").agg(F.collect_list(F.struct(name)).alias(f"{name}s"))


def service_keys(services: DataFrame, keys: DataFrame, k: int = KEYS) -> DataFrame:
    """For each service the first k keys of its repository that are of its provider or list it as related.

    The first k of each provider and of each listed name hold the first k of both, so that a provider of n services and
    m keys never gives n x m rows.
    """
    s = services.select(F.col("id").alias("service_id"), "repository_id", "name", "provider")
    own = keys.select("repository_id", F.col("id").alias("key_id"), "provider", "related_services")
    of_provider = first_rows(own.where(F.col("provider").isNotNull()).select("repository_id", "provider", "key_id"), ["repository_id", "provider"], ["key_id"], k)
    listed = own.select("repository_id", "key_id", F.explode("related_services").alias("name")).distinct()
    of_name = first_rows(listed, ["repository_id", "name"], ["key_id"], k)
    a = s.join(of_provider, ["repository_id", "provider"]).select("service_id", "key_id")
    b = s.join(of_name, ["repository_id", "name"]).select("service_id", "key_id")
    return first_rows(a.union(b).distinct(), "service_id", ["key_id"], k)


def names_held(a: DataFrame, b: DataFrame) -> DataFrame:
    """(repository_id, name, held): names of a that hold a name of b of the same repository, in lower case."""
    x = a.select("repository_id", F.lower("name").alias("name")).distinct()
    y = b.select("repository_id", F.lower("name").alias("held")).where("held != ''").distinct()
    x = x.select("repository_id", "name", F.explode(grams("name")).alias("gram"))
    return x.join(y.withColumn("gram", F.substring("held", 1, 3)), ["repository_id", "gram"]).where(F.contains("name", "held")).select("repository_id", "name", "held")


def tool_dependencies(tools: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(repository_id, tool_id, name): a tool and a dependency of which one's name holds the other's, whatever the case."""
    t = tools.select("repository_id", F.col("id").alias("tool_id"), F.lower("name").alias("tool"))
    d = dependencies.select("repository_id", "name", F.lower("name").alias("low")).distinct()
    both = names_held(tools, dependencies).select("repository_id", F.col("name").alias("tool"), F.col("held").alias("low"))
    both = both.union(names_held(dependencies, tools).select("repository_id", F.col("held").alias("tool"), F.col("name").alias("low"))).distinct()
    return both.join(t, ["repository_id", "tool"]).join(d, ["repository_id", "low"]).select("repository_id", "tool_id", "name")


def shown_elements(elements: DataFrame, relationships: DataFrame, always: str = "module", end: str = "code_element_id") -> DataFrame:
    """Elements of the type that is always shown, and those at this end of a relationship, each once."""
    related = elements.join(relationships.select(F.col(end).alias("id")).distinct(), "id", "left_semi")
    return elements.where(F.col("element_type") == always).unionByName(related).dropDuplicates(["id"])


def related_kinds(relationships: DataFrame) -> DataFrame:
    """For each element the kinds of targets that it is related to, sorted."""
    return relationships.groupBy("code_element_id").agg(F.array_sort(F.collect_set("target_type")).alias("kinds"))


def callers(calls: DataFrame, elements: DataFrame) -> DataFrame:
    """element_id with each element that calls it; calls from unknown elements are dropped."""
    e = elements.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"))
    return calls.join(e, "caller_id").select(F.col("callee_id").alias("element_id"), "caller_id", "caller_name", "line_number")


def callees(calls: DataFrame, elements: DataFrame) -> DataFrame:
    e = elements.select(F.col("id").alias("callee_id"), F.col("name").alias("callee_name"))
    return calls.join(e, "callee_id").select(F.col("caller_id").alias("element_id"), "callee_id", "callee_name", "line_number")


def relationship_targets(relationships: DataFrame, services: DataFrame, elements: DataFrame) -> DataFrame:
    """Each relationship with its target: a service of that id, or else a code element."""
    s = services.select(F.col("id").alias("target_id"), F.col("name").alias("service_name"))
    e = elements.select(F.col("id").alias("target_id"), F.col("name").alias("element_name"))
    both = relationships.join(s, "target_id", "left").join(e, "target_id", "left")
    kind = F.when(F.col("service_name").isNotNull(), "service").when(F.col("element_name").isNotNull(), "code_element")
    return both.select("code_element_id", "target_id", kind.alias("found_as"), F.coalesce("service_name", "element_name").alias("target_name"))


def incoming_relationships(relationships: DataFrame, elements: DataFrame) -> DataFrame:
    """The elements that refer to a target, marked as incoming."""
    e = elements.select(F.col("id").alias("code_element_id"), F.col("name").alias("from_name"))
    return relationships.join(e, "code_element_id").select("target_id", "code_element_id", "from_name", F.lit("incoming").alias("direction"))


def related_entities(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Security entities with those at the other end of a relationship, either way round."""
    out = relationships.select(F.col("source_entity_id").alias("id"), F.col("target_entity_id").alias("other_id"), "relationship_type", F.lit("outgoing").alias("direction"))
    back = relationships.select(F.col("target_entity_id").alias("id"), F.col("source_entity_id").alias("other_id"), "relationship_type", F.lit("incoming").alias("direction"))
    names = entities.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
    return out.unionByName(back).join(names, "other_id").join(entities.select("id"), "id", "left_semi").select("id", "other_id", "other_name", "relationship_type", "direction")


def entity_vulnerabilities(entities: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    return entities.select(F.col("id").alias("entity_id"), "name").join(vulnerabilities.select(F.col("id").alias("vulnerability_id"), "entity_id", "severity"), "entity_id")
