"""Questions in plain words: an ordered table of intents picks the plan, topics and names fill its filters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Intents in order with patterns of which one has to be found; topics; words that are no names.
INTENTS = (
    ("find_functions", (r"what functions", r"show.*functions", r"list.*functions", r"functions.*available", r"how.*function", r"which functions")),
    ("list_services", (r"what services", r"which services", r"services.*used", r"show.*services", r"list.*services")),
    ("find_dependencies", (r"what dependencies", r"which dependencies", r"dependencies.*used", r"list.*dependencies")),
    ("refactoring_impact", (r"what would break", r"what.*impact", r"refactor", r"rename", r"remove", r"change", r"can i.*remove", r"can i.*rename", r"safe.*remove")),
    ("tool_discovery", (r"what tools", r"build tools", r"test.*tools", r"linter", r"which tools")),
    ("find_tests", (r"what tests", r"which tests", r"test.*files", r"test.*functions", r"test.*cases", r"show.*tests", r"list.*tests", r"test.*coverage", r"test.*framework")),
    ("find_documentation", (r"what documentation", r"which documentation", r"what docs", r"which docs", r"docs exist", r"documentation exist", r"readme", r"api.*docs", r"documentation.*files", r"show.*docs", r"list.*docs", r"documentation.*available")),
)
TOPICS = ("authentication", "auth", "storage", "database", "api", "firebase", "aws", "stripe", "payment", "email", "notification", "user", "admin", "file", "upload", "download", "session", "token", "security", "encryption", "validation")
COMMON = frozenset({"what", "which", "show", "list", "the", "are", "is", "a", "an", "to", "for", "with", "from"})
LIMIT = 50


def parse(text: str) -> dict:
    """intent, topics (in their table's order) and entities (sorted)."""
    low = text.lower()
    intent = next((name for name, patterns in INTENTS if any(re.search(p, low) for p in patterns)), "unknown")
    names = re.findall(r'"([^"]+)"', text) + re.findall(r"\b([a-z][a-zA-Z0-9_]*)\b", text)
    return {"intent": intent, "topics": [t for t in TOPICS if t in low], "entities": sorted({n for n in names if n.lower() not in COMMON})}


def parse_column(text, topics=TOPICS):
    """The intent of each row's text, as a column."""
    low = F.lower(text)
    out = None
    for name, patterns in INTENTS:
        hit = reduce(lambda a, b: a | b, [low.rlike(p) for p in patterns])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown"), F.filter(F.array(*[F.when(low.contains(t), F.lit(t)) for t in topics]), lambda t: t.isNotNull())


def about(df: DataFrame, columns: tuple[str, ...], words: list[str]) -> DataFrame:
    """Rows in which some column holds some word; all rows where there is no word."""
    if not words:
        return df
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(w.lower()), F.lit(False)) for c in columns for w in words]
    return df.where(reduce(lambda a, b: a | b, hits))


def ask(text: str, tables: dict[str, DataFrame], limit: int = LIMIT) -> DataFrame:
    """The sources that answer: kind, name, detail, file_path. No language model is called."""
    q = parse(text)
    intent, topics = q["intent"], q["topics"]

    def shape(df: DataFrame, kind: str, detail: str, name: str = "name", n: int = limit) -> DataFrame:
        path = F.col("file_path") if "file_path" in df.columns else F.lit(None).cast("string")
        return df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(detail).cast("string").alias("detail"), path.alias("file_path")).orderBy("name", "detail", "file_path").limit(n)

    t = tables
    if intent == "find_functions":
        return shape(about(t["code_elements"].where(F.lower("element_type") == "function"), ("name", "file_path"), topics), "function", "language")
    if intent == "list_services":
        return shape(about(t["services"], ("name", "provider", "service_type"), topics), "service", "provider")
    if intent == "find_dependencies":
        return shape(about(t["dependencies"], ("name",), topics), "dependency", "version")
    if intent == "tool_discovery":
        return shape(t["tools"], "tool", "category")
    if intent == "find_tests":
        return shape(about(t["tests"], ("name", "file_path"), topics), "test", "test_framework")
    if intent == "find_documentation":
        return shape(about(t["documentation"], ("file_name", "title"), topics), "documentation", "doc_type", "file_name")
    if intent == "refactoring_impact":
        return shape(t["code_elements"].where(F.col("name").isin(*q["entities"])) if q["entities"] else t["code_elements"].limit(0), "code_element", "element_type")
    mixed = [shape(about(t["code_elements"], ("name",), topics), "code_element", "element_type", n=max(1, limit // 3)), shape(about(t["services"], ("name", "provider"), topics), "service", "provider", n=max(1, limit // 5)), shape(about(t["dependencies"], ("name",), topics), "dependency", "version", n=max(1, limit // 5))]
    return mixed[0].unionByName(mixed[1]).unionByName(mixed[2])
