"""What an entity's page shows: for every entity of a kind, what is related to it, in sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.catalog import peers
from tallgrass.operators.joins import callees, callers, key_services, relationship_targets, related_entities, service_keys

KINDS = ("dependency", "service", "code_element", "security_entity")
RELATED = 10


def _section(df: DataFrame, name: str, entity: str, other: str, note=None) -> DataFrame:
    note = F.lit(None) if note is None else F.col(note) if isinstance(note, str) else note
    return df.select(F.col(entity).alias("id"), F.lit(name).alias("section"), F.col(other).cast("string").alias("other"), note.cast("string").alias("note"))


def details(kind: str, tables: dict[str, DataFrame]) -> DataFrame:
    """(id, section, other, note) for all entities of the kind: others of their group (the first 10 by id) and what they are joined to.

    tables: the fact tables; a section whose table isn't there is left out.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown entity type: {kind}")
    t = tables
    if kind == "dependency":
        parts = [_section(peers(t["dependencies"], ["repository_id", "package_manager"], RELATED), "related_dependencies", "id", "peer_id")]
    elif kind == "service":
        parts = [_section(peers(t["services"], ["repository_id", "provider"], RELATED), "related_services", "id", "peer_id")]
        if "keys" in t:
            keys = t["keys"]
            if "related_services" not in keys.columns:
                keys = keys.join(key_services(keys, t["services"]), "id")
            parts.append(_section(service_keys(t["services"], keys), "api_keys", "service_id", "key_id"))
    elif kind == "code_element":
        e = t["code_elements"]
        parts = [_section(peers(e, ["repository_id", "file_path"], RELATED), "related_elements", "id", "peer_id")]
        if "code_calls" in t:
            parts.append(_section(callers(t["code_calls"], e), "callers", "element_id", "caller_id", "line_number"))
            parts.append(_section(callees(t["code_calls"], e), "callees", "element_id", "callee_id", "line_number"))
        if "code_relationships" in t:
            parts += _relations(t["code_relationships"], t, e)
    else:
        e = t["security_entities"]
        parts = [_section(peers(e, ["repository_id", "provider"], RELATED), "related_entities", "id", "peer_id")]
        if "security_relationships" in t:
            parts.append(_section(related_entities(t["security_relationships"], e), "relationships", "id", "other_id", "relationship_type"))
        if "vulnerabilities" in t:
            v = t["vulnerabilities"].join(e.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
            parts.append(_section(v, "vulnerabilities", "entity_id", "id", "severity"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _relations(r: DataFrame, t: dict[str, DataFrame], elements: DataFrame) -> list[DataFrame]:
    """Services (or code elements, where no service has the id), dependencies, and the elements that refer to one."""
    parts = []
    if "services" in t:
        found = relationship_targets(r.where("target_type = 'service'"), t["services"], elements)
        parts.append(_section(found.where("found_as = 'service'"), "related_services", "code_element_id", "target_id", "target_name"))
        parts.append(_section(found.where("found_as = 'code_element'"), "related_code_elements", "code_element_id", "target_id", "target_name"))
    if "dependencies" in t and "id" in t["dependencies"].columns:
        d = t["dependencies"].select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
        parts.append(_section(r.where("target_type = 'dependency'").join(d, "target_id"), "related_dependencies", "code_element_id", "target_id", "target_name"))
    known = elements.select(F.col("id").alias("target_id"))
    parts.append(_section(r.join(known, "target_id", "left_semi"), "incoming", "target_id", "code_element_id", "relationship_type"))
    return parts


def entity_details(kind: str, tables: dict[str, DataFrame], entity_id) -> DataFrame:
    """The sections of one entity: its filter reaches every join's input."""
    return details(kind, tables).where(F.col("id") == entity_id)
