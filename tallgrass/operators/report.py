"""The HTML report: small aggregates and the first rows of each group, collected and put into a page."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.aggregates import GROUP_LIMITS, counts_by, report_groups
from tallgrass.operators.graph import statistics

#: section: (grouping column, name column, rows shown of each group)
SECTIONS = {
    "dependencies": ("package_manager", "name", GROUP_LIMITS["dependencies"]),
    "services": ("provider", "name", GROUP_LIMITS["services"]),
    "security_entities": ("entity_type", "name", GROUP_LIMITS["security"]),
    "code_elements": ("element_type", "name", GROUP_LIMITS["code"]),
    "ports": ("port_type", "port", GROUP_LIMITS["code"]),
    "endpoints": ("framework", "path", GROUP_LIMITS["endpoints"]),
}
GROUPS = 200


def section(df: DataFrame, group: str, name: str, limit: int) -> list[tuple]:
    """(group, count, names) for the largest groups; at most GROUPS x limit names come to the driver."""
    top = counts_by(df, group).orderBy(F.desc("n"), group).limit(GROUPS)
    shown = df.join(F.broadcast(top.select(group)), group, "left_semi") if df.columns else df
    rows = report_groups(shown.select(group, F.col(name).cast("string").alias("name")), group, ["name"], limit).groupBy(group).agg(F.max("n").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
    return [(r[group], r["n"], r["names"]) for r in rows.orderBy(F.desc("n"), group).collect()]


def render(title: str, tables: dict[str, DataFrame], nodes: DataFrame | None = None, edges: DataFrame | None = None) -> str:
    out = ["<!doctype html><html><head><meta charset='utf-8'>", f"<title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    if nodes is not None and edges is not None:
        out.append("<h2>Graph</h2><ul>")
        out += [f"<li>{html.escape(r.measure)} {html.escape(str(r.value))}: {r.n}</li>" for r in statistics(nodes, edges).orderBy("measure", "value").collect()]
        out.append("</ul>")
    for name, (group, column, limit) in SECTIONS.items():
        if name not in tables:
            continue
        out.append(f"<h2>{name.replace('_', ' ').title()}</h2>")
        for key, n, names in section(tables[name], group, column, limit):
            more = f"<p>and {n - len(names)} more</p>" if n > len(names) else ""
            out.append(f"<h3>{html.escape(str(key))} ({n})</h3><ul>" + "".join(f"<li>{html.escape(str(x))}</li>" for x in names) + f"</ul>{more}")
    return "\n".join([*out, "</body></html>"])
