"""The file corpus: one shared scan, with the columns and skip rules that every detector uses.

Paths are relative to the repository, so that a parent folder's name never decides. A file that is not UTF-8 is dropped,
on its bytes, before anything else reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.text import any_of, ends_with_any, extension, file_name, first_case, lines, starts_with_any

SCHEMA = "repository_id string, path string, content string"

#: Language by extension.
LANGUAGES = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "rs": "rust", "go": "go", "swift": "swift", "m": "objective-c", "mm": "objective-c", "java": "java"}
#: Language and file type by extension, for the general index.
INDEX_LANGUAGES = LANGUAGES | {"c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "scala": "scala", "sh": "shell", "bash": "shell", "sql": "sql", "html": "html", "css": "css", "scss": "scss", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "md": "markdown", "dart": "dart", "lua": "lua", "r": "r"}
FILE_TYPES = {
    "infrastructure": ("tf", "tfvars", "hcl"),
    "config": ("json", "yaml", "yml", "toml", "ini", "cfg", "conf", "env", "properties"),
    "documentation": ("md", "rst", "txt", "adoc"),
    "code": ("js", "jsx", "mjs", "ts", "tsx", "py", "rs", "go", "swift", "m", "mm", "java", "c", "h", "cpp", "cc", "cxx", "hpp", "cs", "rb", "php", "kt", "scala", "sh", "bash", "sql", "dart", "lua", "r"),
    "web": ("html", "css", "scss", "xml"),
}
SKIPPED_PARTS = ("node_modules", "target", ".git", "/dist/", "/build/", "/.next/", "/out/", "/.nuxt/", "/.cache/", "/coverage/")
SKIPPED_ENDS = (".min.js", ".min.css", ".bundle.js", ".chunk.js", ".class", ".pyc", ".pyo", ".so", ".dll", ".dylib", ".a", ".o", ".rlib")
VENV_PARTS = ("venv/", "/venv/", "site-packages", ".venv/")
SECURITY_PARTS = ("node_modules", "target", ".git/", *VENV_PARTS, "/dist/", "/build/")
CONFIG_ENDS = (".env", ".config", ".json", ".yaml", ".yml", ".toml", ".properties")


def read_repository(spark: SparkSession, folder: str, repository_id: str) -> DataFrame:
    """The files under folder, from any store that Spark reads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").split("://")[-1]
    relative = F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/"), "^" + r"\Q" + root + r"\E/*", "")
    good = raw.where(F.is_valid_utf8(F.col("content").cast("string")))
    return prepared(good.select(F.lit(repository_id).alias("repository_id"), relative.alias("path"), F.col("content").cast("string").alias("content")))


def prepared(files: DataFrame) -> DataFrame:
    """files (repository_id, path, content) with file_name, ext, language, size and lines."""
    p = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    df = files.select("repository_id", p.alias("path"), F.coalesce("content", F.lit("")).alias("content"))
    df = df.withColumns({"file_name": file_name(F.col("path")), "low_path": F.lower(F.concat(F.lit("/"), "path")), "size": F.octet_length("content").cast("long"), "lines": lines(F.col("content"))})
    df = df.withColumns({"low_name": F.lower("file_name"), "ext": extension(F.col("file_name"))})
    return df.withColumn("language", language(F.col("ext"), F.col("low_path")))


def language(ext: Column, low_path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    apple = (ext == "h") & any_of(low_path, ".xcodeproj", "ios", "iphone", "macos")
    return F.when(apple, F.lit("objective-c")).otherwise(F.try_element_at(table, ext))


def indexed(files: DataFrame) -> DataFrame:
    """path with the general index's file_type and language."""
    table = F.create_map(*[F.lit(x) for pair in INDEX_LANGUAGES.items() for x in pair])
    kind = first_case([(F.col("low_name").isin("dockerfile", "makefile", "jenkinsfile"), "config"), *[(F.col("ext").isin(*v), k) for k, v in FILE_TYPES.items()]], "other")
    return files.select("repository_id", "path", kind.alias("file_type"), F.coalesce(F.try_element_at(table, F.col("ext")), F.lit("unknown")).alias("language"), "size")


def skipped() -> Column:
    """The general rule: hidden, generated, vendored and binary files."""
    return F.col("low_name").startswith(".") | any_of(F.col("low_path"), *SKIPPED_PARTS) | ends_with_any(F.col("low_name"), *SKIPPED_ENDS)


def skipped_by_services() -> Column:
    return skipped() | any_of(F.col("low_path"), *VENV_PARTS)


def skipped_by_security() -> Column:
    """Environment templates are read, although hidden."""
    return (F.col("low_name").startswith(".") & ~F.col("low_name").startswith(".env")) | any_of(F.col("low_path"), *SECURITY_PARTS)


def is_config_file(*more: str) -> Column:
    return ends_with_any(F.col("low_name"), *CONFIG_ENDS) | any_of(F.col("low_name"), "config", *more)


def skipped_by_ports() -> Column:
    return (F.col("low_name").startswith(".") & ~is_config_file()) | any_of(F.col("low_path"), "node_modules", "target", ".git", *VENV_PARTS)


def skipped_by_endpoints() -> Column:
    return (F.col("low_name").startswith(".") & ~is_config_file("openapi", "swagger", "api-gateway")) | any_of(F.col("low_path"), "node_modules", "target", ".git", *VENV_PARTS)


def skipped_by_secrets(limit: int = 1 << 20) -> Column:
    return skipped_by_services() | F.col("low_path").contains("vendor") | (F.col("size") > limit)


def documented() -> Column:
    """What the documentation scan reads."""
    hidden = any_of(F.col("low_path"), "node_modules", "target", "/.git/", "/dist/", "/build/", "/.next/", "/vendor/", *VENV_PARTS) | F.col("low_name").startswith(".")
    named = F.col("low_name").isin("readme", "license", "licence", "changelog", "contributing", "authors")
    return ~hidden & (F.col("ext").isin("md", "txt", "rst", "adoc", "markdown") | named)


def bare_length() -> Column:
    return F.length(F.regexp_replace("content", r"(?U)\s", ""))


def minified() -> Column:
    """The general test for generated code; lengths are bytes."""
    n, size = F.greatest(F.size("lines"), F.lit(1)), F.col("size")
    dense = bare_length() / F.greatest(size, F.lit(1))
    bundle = any_of(F.col("path"), "bundle", "chunk") & any_of(F.col("content"), "webpackChunkName", "__webpack_require__")
    packed = F.col("content").contains("!function") & F.col("content").contains("(function") & (dense > 0.9)
    mapped = any_of(F.col("content"), "//# sourceMappingURL=", "//@ sourceMappingURL=")
    return (size >= 100) & (F.size("lines") > 0) & ((F.floor(size / n) > 200) | (F.size("lines") < F.floor(size / 500)) | ((dense > 0.95) & (size > 1000)) | packed | mapped | bundle)


def minified_document() -> Column:
    """The documentation scan's own test."""
    n, size = F.greatest(F.size("lines"), F.lit(1)), F.greatest(F.col("size"), F.lit(1))
    white = 1.0 - bare_length() / size
    mean = F.aggregate(F.transform("lines", F.octet_length), F.lit(0), lambda a, x: a + x) / n
    few = (F.size("lines") / size < 0.01) & (F.col("size") > 1000)
    script = F.col("content").contains("function(") & F.col("content").contains("=>") & (white < 0.15)
    mapped = any_of(F.col("content"), "//# sourceMappingURL=", "//@ sourceMappingURL=")
    return (F.size("lines") > 0) & ((mean > 200) | few | ((white < 0.1) & (F.col("size") > 500)) | script | mapped)


def build_artifact(path: Column) -> Column:
    """What the list pages flag as built."""
    low = F.lower(F.concat(F.lit("/"), path))
    return any_of(low, "/dist/", "/build/", "/.next/", "/out/", "/node_modules/", "/target/", "/coverage/") | ends_with_any(low, ".min.js", ".min.css", ".bundle.js", ".chunk.js", ".map") | starts_with_any(low, "/static/chunks/")
