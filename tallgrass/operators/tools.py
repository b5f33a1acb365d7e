"""Developer tools: scripts, configuration files, packages, shell scripts and environments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import any_of, ends_with_any, first_case, stable_id
from tallgrass.operators.aggregates import merged_tools

SCRIPT = "array<struct<name:string,command:string>>"
# Fixed values: (words, name, type, category, confidence), the first held decides. Words of a later row that an earlier one holds are never reached.
COMMANDS = (
    (("webpack",), "webpack", "build_tool", "webpack", 0.9),
    (("vite",), "vite", "build_tool", "vite", 0.9),
    (("tsc", "typescript"), "TypeScript Compiler", "build_tool", "tsc", 0.85),
    (("jest",), "jest", "test_framework", "jest", 0.9),
    (("mocha",), "mocha", "test_framework", "mocha", 0.9),
    (("eslint",), "eslint", "linter", "eslint", 0.9),
    (("prettier",), "prettier", "formatter", "prettier", 0.9),
)
CONFIG_FILES = (
    (("eslintrc",), ("eslint.config.js",), "eslint", "linter", "eslint", 0.95),
    (("prettierrc",), ("prettier.config.js",), "prettier", "formatter", "prettier", 0.95),
    (("webpack.config",), (), "webpack", "build_tool", "webpack", 0.9),
    (("vite.config",), (), "vite", "build_tool", "vite", 0.9),
    (("jest.config",), (), "jest", "test_framework", "jest", 0.9),
    ((), ("makefile", "makefile.am", "makefile.in"), "make", "task_runner", "make", 0.9),
)
PACKAGES = ((("eslint", "eslint-"), "linter", "eslint"), (("prettier", None), "formatter", "prettier"), (("jest", "jest-"), "test_framework", "jest"), (("webpack", "webpack-"), "build_tool", "webpack"), (("vite", None), "build_tool", "vite"))
COLUMNS = ("repository_id", "name", "tool_type", "category", "version", "file_path", "detection_method", "scripts", "configuration", "confidence")


def row(name, kind: str, category: str, method: str, confidence: float, version: Column | None = None, scripts: Column | None = None) -> list[Column]:
    return [
        (name if isinstance(name, Column) else F.lit(name)).alias("name"),
        F.lit(kind).alias("tool_type"),
        F.lit(category).alias("category"),
        (F.lit(None).cast("string") if version is None else version).alias("version"),
        F.col("path").alias("file_path"),
        F.lit(method).alias("detection_method"),
        (F.array().cast(SCRIPT) if scripts is None else scripts).alias("scripts"),
        F.create_map().cast("map<string,string>").alias("configuration"),
        F.lit(float(confidence)).alias("confidence"),
    ]


def command_tool(command: Column) -> Column:
    low = F.lower(command)
    made = lambda n, t, c, x: F.struct(F.lit(n).alias("name"), F.lit(t).alias("tool_type"), F.lit(c).alias("category"), F.lit(x).alias("confidence"))
    return first_case([(any_of(low, *words), made(n, t, c, x)) for words, n, t, c, x in COMMANDS], F.lit(None).cast("struct<name:string,tool_type:string,category:string,confidence:double>"))


def npm_scripts(files: DataFrame) -> DataFrame:
    """One tool for all scripts of a package.json, and one for the command of each that is known."""
    df = files.where(F.col("path") == "package.json")
    listed = F.transform(F.map_entries(F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), F.coalesce(e["value"], F.lit("")).alias("command")))
    df = df.withColumn("listed", listed).where(F.size("listed") > 0)
    whole = df.select("repository_id", *row("npm scripts", "task_runner", "npm_scripts", "package_script", 0.9, scripts=F.col("listed")))
    each = df.select("repository_id", "path", F.explode("listed").alias("s")).withColumn("t", command_tool(F.col("s.command"))).where(F.col("t").isNotNull())
    known = each.select("repository_id", F.col("t.name").alias("name"), "t.tool_type", "t.category", F.lit(None).cast("string").alias("version"), F.col("path").alias("file_path"), F.lit("package_script").alias("detection_method"), F.array().cast(SCRIPT).alias("scripts"), F.create_map().cast("map<string,string>").alias("configuration"), "t.confidence")
    return whole.unionByName(known)


def config_files(files: DataFrame) -> DataFrame:
    n = F.col("low_name")
    used = files.where(~any_of(F.col("low_path"), "node_modules", "target", ".git/")).where(~n.startswith(".") | n.rlike(r"^\.(eslintrc|prettierrc|editorconfig)"))
    out = None
    for parts, names, name, kind, category, confidence in CONFIG_FILES:
        hit = n.isin(*names) if names else F.lit(False)
        part = used.where((any_of(n, *parts) if parts else F.lit(False)) | hit).select("repository_id", *row(name, kind, category, "config_file", confidence))
        out = part if out is None else out.unionByName(part)
    return out


def package_tools(dependencies: DataFrame) -> DataFrame:
    """npm development packages, with versions."""
    low, df = F.lower("name"), dependencies.where((F.col("package_manager") == "npm") & F.col("is_dev")).withColumn("path", F.col("file_path"))
    out = None
    for (name, prefix), kind, category in PACKAGES:
        part = df.where((low == name) | (low.startswith(prefix) if prefix else F.lit(False))).select("repository_id", *row(F.col("name"), kind, category, "dependency", 0.9, version=F.col("version")))
        out = part if out is None else out.unionByName(part)
    return out


def shell_scripts(files: DataFrame) -> DataFrame:
    used = files.where(ends_with_any(F.col("file_name"), ".sh", ".bash") & ~any_of(F.col("low_path"), "node_modules", "target", ".git/"))
    bash = F.coalesce(F.get("lines", F.lit(0)), F.lit("")).contains("bash")
    a = used.where(bash).select("repository_id", *row(F.concat("file_name", F.lit(" (bash script)")), "shell_script", "bash", "script_file", 0.8))
    b = used.where(~bash).select("repository_id", *row(F.concat("file_name", F.lit(" (shell script)")), "shell_script", "bash", "script_file", 0.7))
    return a.unionByName(b)


def environments(files: DataFrame) -> DataFrame:
    """Virtual environment folders (by the folders of files), dev containers and version files."""
    folders = files.select("repository_id", F.explode(F.sequence(F.lit(1), F.size(F.split("path", "/")))).alias("k"), F.split("path", "/").alias("p")).where(F.col("k") < F.size("p"))
    folder = folders.where(F.lower(F.element_at("p", F.col("k"))).isin(".venv", "venv", "env", ".virtualenv")).select("repository_id", F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("path")).distinct()
    a = folder.select("repository_id", *row("Python Virtual Environment", "dev_environment", "venv", "directory_pattern", 0.9))
    b = files.where(F.col("path") == ".devcontainer/devcontainer.json").select("repository_id", *row("Dev Container", "dev_environment", "dev_container", "config_file", 0.95))
    c = files.where(F.col("path") == ".nvmrc").select("repository_id", *row("Node Version Manager", "dev_environment", "unknown", "version_file", 0.8))
    return a.unionByName(b).unionByName(c)


def detect_tools(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Rows of the tools table, merged by name, category and type."""
    parts = [npm_scripts(files), config_files(files), package_tools(dependencies), shell_scripts(files), environments(files)]
    out = None
    for k, p in enumerate(parts):
        p = p.select(*COLUMNS).withColumn("ord", F.concat_ws("\u0001", F.lit(str(k)), "file_path", "name"))
        out = p if out is None else out.unionByName(p)
    return merged_tools(out.withColumn("id", stable_id(F.lit("tool"), F.col("repository_id"), F.col("ord"))))
