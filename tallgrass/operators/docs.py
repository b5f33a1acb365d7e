"""Documentation files: type, title, description and measures, each a column of the file's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import any_of, ends_with_any, file_name, first_case, stable_id, strip
from tallgrass.sources.corpus import documented, minified_document

API_WORDS = ("api", "endpoint", "route", "method", "request", "response", "curl", "http", "rest", "graphql", "openapi", "swagger")
DIAGRAMS = ("```mermaid", "```plantuml", "```graphviz", "```dot", ".. graphviz::", ".. mermaid::")
CODE = ("```", "code::", ".. code-block::")
SPACE = r"(?U)\s+"
PREVIEW = 500


def doc_type(path: Column) -> Column:
    """By the first rule that the lower-cased name or path meets."""
    low = F.lower(F.concat(F.lit("/"), path))
    name = file_name(low)
    api = (name.isin("api") | name.startswith("api.") | any_of(name, "api-docs", "api_docs")) & (ends_with_any(name, ".md", ".txt", ".rst") | ~name.contains("."))
    return first_case(
        [
            (name.isin("readme.md", "readme.txt", "readme.rst"), "readme"),
            (name.contains("contributing"), "contributing"),
            (any_of(name, "changelog", "changes"), "changelog"),
            (name.isin("license", "licence"), "license"),
            (api, "api_docs"),
            (name.contains("arch"), "architecture"),
            (any_of(name, "setup", "install", "getting-started"), "setup"),
            (any_of(name, "tutorial", "guide", "howto"), "tutorial"),
            (any_of(low, "/docs/", "/documentation/"), "reference"),
        ],
        "other",
    )


def title(lines: Column) -> Column:
    """The first heading of one or two marks, or else the first line that is not empty and under 100 bytes."""
    bare = F.transform(lines, strip)
    heading = F.get(F.filter(bare, lambda x: x.startswith("# ") | x.startswith("## ")), F.lit(0))
    plain = F.get(F.filter(bare, lambda x: (x != "") & (F.octet_length(x) < 100)), F.lit(0))
    return F.coalesce(strip(F.regexp_replace(heading, "^##? ", "")), plain)


def description(lines: Column) -> Column:
    """The first line of 21 to 299 bytes that is no heading and in no code fence."""
    bare = F.transform(lines, strip)
    fences = F.filter(F.transform(bare, lambda x, i: F.when(x.startswith("```"), i)), lambda i: i.isNotNull())
    # a line is fenced if an odd number of fence lines stand before it
    open_ = lambda i: F.size(F.filter(fences, lambda f: f < i)) % 2 == 1
    fits = F.filter(bare, lambda x, i: ~x.startswith("```") & ~x.startswith("#") & F.octet_length(x).between(21, 299) & ~open_(i))
    return F.get(fits, F.lit(0))


def measures(content: Column, lines: Column, space: str = SPACE, code: tuple[str, ...] = CODE) -> dict[str, Column]:
    low = F.lower(content)
    drawn = content.contains("![") & any_of(content, "diagram", "arch")
    return {
        "content_preview": F.substring(content, 1, PREVIEW),
        "word_count": F.size(F.filter(F.split(content, space), lambda w: w != "")).cast("long"),
        "line_count": F.size(lines).cast("long"),
        "has_code_examples": any_of(content, *code),
        "has_api_references": any_of(low, *API_WORDS),
        "has_diagrams": any_of(content, *DIAGRAMS) | drawn,
    }


def metadata(content: Column, lines: Column, kind: Column) -> Column:
    """Frontmatter, headings, and the languages that a README mentions; what is false is left out."""
    low, front = F.lower(content), F.regexp_extract(content, r"(?s)\A---(.*?)---", 1)
    readme = kind == "readme"
    flags = {
        "has_frontmatter": any_of(front, "title:", "description:"),
        "mentions_rust": readme & any_of(low, "rust", "cargo"),
        "mentions_python": readme & any_of(low, "python", "pip"),
        "mentions_javascript": readme & any_of(low, "javascript", "node", "npm"),
    }
    headings = F.size(F.filter(lines, lambda x: strip(x).startswith("#"))).cast("string")
    pairs = F.array_compact(F.array(F.struct(F.lit("heading_count").alias("key"), headings.alias("value")), *[F.when(v, F.struct(F.lit(k).alias("key"), F.lit("true").alias("value"))) for k, v in flags.items()]))
    return F.map_from_entries(pairs)


def index_documentation(files: DataFrame) -> DataFrame:
    """Rows of the documentation table; of paths that differ in case alone the smallest stays."""
    used = files.where(documented() & ~minified_document())
    content, lines = F.col("content"), F.col("lines")
    df = used.withColumn("doc_type", doc_type(F.col("path")))
    rows = df.select(
        stable_id(F.lit("doc"), F.col("repository_id"), F.col("path")).alias("id"),
        "repository_id",
        F.col("path").alias("file_path"),
        "file_name",
        "doc_type",
        title(lines).alias("title"),
        description(lines).alias("description"),
        *[c.alias(n) for n, c in measures(content, lines).items()],
        metadata(content, lines, F.col("doc_type")).alias("metadata"),
        F.lower("path").alias("low"),
    )
    first = rows.groupBy("repository_id", "low").agg(F.min("file_path").alias("file_path"))
    return rows.drop("low").join(first.drop("low"), ["repository_id", "file_path"], "left_semi").select(*[c for c in rows.columns if c != "low"])
