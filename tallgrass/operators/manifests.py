"""Dependencies from package manifests: a column expression for each line format, a parser for TOML alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import any_of, first_case, found, starts_with_any, strip

COLUMNS = ("repository_id", "name", "version", "package_manager", "is_dev", "is_optional", "file_path")
ROW = "array<struct<name:string,version:string,is_dev:boolean,is_optional:boolean>>"
MAVEN_SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "target", "build", "dist", ".idea", ".vscode")


def dep(name: Column, version: Column, is_dev: Column | bool = False, is_optional: Column | bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(name.alias("name"), version.alias("version"), lit(is_dev).alias("is_dev"), lit(is_optional).alias("is_optional"))


def rows(files: DataFrame, manager: str, found_: Column, file_path: Column | None = None) -> DataFrame:
    df = files.select("repository_id", (file_path if file_path is not None else F.col("path")).alias("file_path"), F.explode(found_).alias("d"))
    return df.select("repository_id", "d.name", "d.version", F.lit(manager).alias("package_manager"), "d.is_dev", "d.is_optional", "file_path")


def from_lines(files: DataFrame, each) -> Column:
    return F.array_compact(F.transform(F.transform("lines", strip), each))


def npm(files: DataFrame) -> DataFrame:
    """Three sections of the root package.json; a version that is no string is `unknown`."""

    def section(key: str, dev: bool, optional: bool) -> Column:
        raw = F.from_json(F.get_json_object("content", f"$.{key}"), "map<string,variant>")
        text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.lit("unknown"))
        return F.transform(F.map_entries(raw), lambda e: dep(e["key"], text(e["value"]), dev, optional))

    parts = [section("dependencies", False, False), section("devDependencies", True, False), section("optionalDependencies", False, True)]
    each = F.concat(*[F.coalesce(p, F.array().cast(ROW)) for p in parts])
    return rows(files.where(F.col("path") == "package.json"), "npm", each)


def pip(files: DataFrame) -> DataFrame:
    """The first token of each line, cut at the first operator present of ==, >=, <=, ~=, >, <."""

    def each(x: Column) -> Column:
        spec = F.regexp_extract(x, r"(?U)^[^\s]+", 0)
        cases = []
        for op in ("==", ">=", "<=", "~=", ">", "<"):
            name, rest = F.substring_index(spec, op, 1), F.substring(spec, F.instr(spec, op) + len(op), F.length(spec))
            cases.append((spec.contains(op), dep(name, rest if op == "==" else F.concat(F.lit(op), rest))))
        return F.when((x != "") & ~x.startswith("#"), first_case(cases, dep(spec, F.lit("latest"))))

    df = files.where(F.col("path") == "requirements.txt")
    return rows(df, "pip", from_lines(df, each))


def go(files: DataFrame) -> DataFrame:
    """Single `require` lines, and every other line that is no keyword, comment or bracket."""

    def each(x: Column) -> Column:
        word = F.split(x, r"(?U)\s+")
        at = lambda k: F.coalesce(F.get(word, F.lit(k)), F.lit("latest"))
        one = x.startswith("require ") & ~x.contains("(")
        block = ~starts_with_any(x, "require ", "module ", "go ", "//") & (x != "") & ~any_of(x, "require", "(", ")")
        return F.when(one & (F.size(word) >= 2), dep(word[1], at(2))).when(block, dep(word[0], at(1)))

    df = files.where(F.col("path") == "go.mod")
    return rows(df, "go", from_lines(df, each))


def maven(files: DataFrame) -> DataFrame:
    """Every pom.xml: blocks of lines between <dependency> and </dependency>, each tag within one line."""
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, MAVEN_SKIPPED)))
    df = files.where((F.col("file_name") == "pom.xml") & ~skipped)
    blocks = F.regexp_extract_all("content", F.lit(r"(?s)<dependency>[^\n]*\n(.*?)</dependency>"), F.lit(1))

    def each(b: Column) -> Column:
        own = F.split(b, "\n")
        tag = lambda t: F.try_element_at(F.filter(F.transform(own, lambda x: F.when(x.rlike(f"<{t}>.*</{t}>"), strip(F.regexp_extract(x, f"<{t}>(.*)</{t}>", 1)))), lambda v: v.isNotNull()), F.lit(-1))
        group, name = tag("groupId"), tag("artifactId")
        full = F.when(F.coalesce(group, F.lit("")) != "", F.concat(group, F.lit(":"), name)).otherwise(name)
        version = F.coalesce(F.when(tag("version") != "", tag("version")), F.lit("unknown"))
        return F.when(F.coalesce(name, F.lit("")) != "", dep(full, version, F.coalesce(tag("scope") == "test", F.lit(False)), F.coalesce(tag("optional") == "true", F.lit(False))))

    return rows(df, "maven", F.array_compact(F.transform(blocks, each)))


def swift(files: DataFrame) -> DataFrame:
    """The root's Package.swift, or else the first by path one folder down; .package(url:) lines of its dependencies."""
    df = files.where((F.col("file_name") == "Package.swift") & (F.size(F.split("path", "/")) <= 2))
    first = df.groupBy("repository_id").agg(F.min_by("path", F.struct(F.size(F.split("path", "/")), "path")).alias("path"))
    df = df.join(first, ["repository_id", "path"], "left_semi")
    bare = F.transform("lines", strip)
    begins = F.array_position(F.transform(bare, lambda x: any_of(x, "dependencies:", "dependencies =")), True)
    after = F.when(begins > 0, F.slice(bare, begins.cast("int") + 1, F.size(bare))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(after, lambda x: starts_with_any(x, "targets:", "products:", "name:")), True)
    section = F.when(stop > 0, F.slice(after, 1, stop.cast("int"))).otherwise(after)

    def value(x: Column, key: str) -> Column:
        return found(x, key + """\\s*["']?([^"',)]*)""")

    def each(x: Column) -> Column:
        name = F.regexp_replace(F.substring_index(value(x, "url:"), "/", -1), r"(\.git)+$", "")
        version = first_case([(x.contains("from:"), F.coalesce(value(x, "from:"), F.lit("unknown"))), (x.contains("exact:"), F.coalesce(value(x, "exact:"), F.lit("unknown")))], "latest")
        return F.when(x.contains(".package(") & x.contains("url:") & name.isNotNull() & ~any_of(x, "dependencies:", "dependencies ="), dep(name, version))

    return rows(df, "swift-package-manager", F.array_compact(F.transform(section, each)))


def cocoapods(files: DataFrame) -> DataFrame:
    """`pod` lines: the first quoted string is the name; the version follows ~> or is the second quoted string."""

    def each(x: Column) -> Column:
        body = strip(F.regexp_replace(x, "^pod ", ""))
        name = F.coalesce(found(body, "'([^']*)'"), found(body, '"([^"]*)"'))
        op = F.regexp_extract(body, "~>(.*)$", 1)
        tail = first_case([(op.contains(q), strip(F.substring_index(op, q, 1))) for q in ("'", '"', ",")], strip(op))
        rest = F.regexp_extract(body, ",(.*)$", 1)
        second = F.coalesce(found(rest, "'([^']*)'"), F.when(~rest.contains("'"), found(rest, '"([^"]*)"')), F.lit("latest"))
        version = first_case([(body.contains("~>"), tail), (body.contains(","), second)], "latest")
        return F.when(x.startswith("pod ") & name.isNotNull(), dep(name, version))

    df = files.where(F.col("path") == "Podfile")
    return rows(df, "cocoapods", from_lines(df, each))


def xcode(files: DataFrame) -> DataFrame:
    """Remote packages of project.pbxproj files, one for each URL of a repository."""
    df = files.where(F.col("path").rlike(r"(^|/)[^/]*\.xcodeproj/project\.pbxproj$"))
    blocks = F.regexp_extract_all("content", F.lit(r'(?s)XCRemoteSwiftPackageReference "[^"]*"[^\n]*\n.*?\n\s*\};'), F.lit(0))

    def each(b: Column) -> Column:
        url = F.coalesce(found(b, r'repositoryURL[^"\n]*"([^"]*)"'), found(b, r"repositoryURL\s*=\s*((?:http|git@)[^;\s]*)"))
        return F.struct(found(b, r'XCRemoteSwiftPackageReference "([^"]*)"').alias("name"), url.alias("url"))

    each_row = df.select("repository_id", F.col("path").alias("file_path"), "content", F.posexplode(F.transform(blocks, each)).alias("ord", "b"))
    at = F.expr("instr(content, concat('repositoryURL = \"', b.url, '\"'))")
    tail = F.when(at > 0, F.substring(F.col("content"), at, F.length("content"))).otherwise(F.lit(""))
    quoted = lambda key: F.regexp_extract(tail, rf'(?s){key} =[^"]*"([^"]*)"', 1)
    version = first_case([(tail.contains("branch ="), F.when(quoted("branch") != "", F.concat(F.lit("branch:"), quoted("branch"))).otherwise("latest")), (tail.contains("version ="), F.when(quoted("version") != "", F.concat(F.lit("version:"), quoted("version"))).otherwise("latest"))], "latest")
    named = each_row.where(F.col("b.url").isNotNull() & F.col("b.name").isNotNull()).select("repository_id", "file_path", "ord", F.col("b.url").alias("url"), F.col("b.name").alias("name"), version.alias("version"))
    first = named.groupBy("repository_id", "url").agg(F.min_by(F.struct("name", "version", "file_path"), F.struct("file_path", "ord")).alias("f"))
    return first.select("repository_id", "f.name", "f.version", F.lit("swift-package-manager").alias("package_manager"), F.lit(False).alias("is_dev"), F.lit(False).alias("is_optional"), "f.file_path")


def cargo(files: DataFrame) -> DataFrame:
    """The two dependency tables of the root Cargo.toml, by the standard library's TOML parser; only such files reach it."""
    df = files.where(F.col("path") == "Cargo.toml").select("repository_id", "path", "content")

    def parsed(batches):
        import tomllib

        import pandas as pd

        for pdf in batches:
            out = []
            for repo, path, content in pdf.itertuples(index=False):
                try:
                    doc = tomllib.loads(content)
                except tomllib.TOMLDecodeError:
                    continue
                for table, dev in (("dependencies", False), ("dev-dependencies", True)):
                    listed = doc.get(table)
                    for name, value in (listed.items() if isinstance(listed, dict) else ()):
                        version = value if isinstance(value, str) else value.get("version") if isinstance(value, dict) else None
                        out.append((repo, name, version if isinstance(version, str) else "unknown", "cargo", dev, False, path))
            yield pd.DataFrame(out, columns=list(COLUMNS))

    return df.mapInPandas(parsed, "repository_id string, name string, version string, package_manager string, is_dev boolean, is_optional boolean, file_path string")


def plugin_packages(files: DataFrame, suffix: str = ".packages.json") -> DataFrame:
    """Package lists that plugins leave: packages[].requires[], versions unknown."""
    df = files.where(F.col("low_name").endswith(suffix))
    schema = "packages array<struct<name:string,requires:array<string>>>"
    each = F.flatten(F.transform(F.from_json("content", schema)["packages"], lambda p: F.transform(F.coalesce(p["requires"], F.array().cast("array<string>")), lambda r: dep(r, F.lit("unknown")))))
    return rows(df, "webmethods-is", each)


READERS = {"npm": npm, "pip": pip, "cargo": cargo, "maven": maven, "go": go, "swift": swift, "cocoapods": cocoapods, "xcode": xcode, "plugins": plugin_packages}


def dependencies(files: DataFrame) -> DataFrame:
    """All manifests of all repositories: a union, so that no manifest replaces another."""
    out: DataFrame | None = None
    for read in READERS.values():
        out = read(files) if out is None else out.unionByName(read(files))
    return out
