"""Code elements of seven languages, from one projection over the lines of each file.

A line gives every element whose rule it meets: rules are columns, not branches, so the whole language table is one array
of candidates per line that is compacted and exploded. Look-back (documentation comments) and a file's earlier lines are
slices of the file's own array; nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import any_of, first_case, found, split_list, stable_id, starts_with_any, strip, stripped
from tallgrass.sources.corpus import minified, skipped

PLACED = "array<struct<at:int,ord:int,e:struct<name:string,element_type:string,signature:string,visibility:string,parameters:array<string>,return_type:string,documented:boolean>,doc:string>>"

#: Words before a Java name that are no return type, and those that are no method name.
JAVA_MODIFIERS = ("public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "strictfp")
JAVA_WORDS = (*JAVA_MODIFIERS, "void", "int", "String", "boolean", "long", "double", "float", "char", "byte", "short")


def element(condition: Column, kind: str, name: Column, line: Column | None, visibility=None, parameters=None, returns=None) -> Column:
    """A candidate, or null. A line of None is an import: it has no signature and no comment."""
    none = F.array().cast("array<string>")
    made = F.struct(
        name.alias("name"),
        F.lit(kind).alias("element_type") if isinstance(kind, str) else kind.alias("element_type"),
        (F.lit(None).cast("string") if line is None else line).alias("signature"),
        (F.lit(None).cast("string") if visibility is None else visibility).alias("visibility"),
        (none if parameters is None else F.coalesce(parameters, none)).alias("parameters"),
        (F.lit(None).cast("string") if returns is None else returns).alias("return_type"),
        F.lit(line is not None).alias("documented"),
    )
    return F.when(condition & name.isNotNull(), made)


def in_parens(x: Column) -> Column:
    return F.when(x.rlike(r"\([^)]*\)"), F.regexp_extract(x, r"\(([^)]*)\)", 1))


def plain_parameters(x: Column) -> Column:
    return split_list(in_parens(x))


def javascript(x: Column) -> list[Column]:
    arrow = x.contains("const ") & x.contains("=") & (x.contains("=>") | x.contains("function"))
    older = any_of(x, "var ", "let ") & x.contains("=") & x.contains("function")
    variable = F.when(x.contains("var "), stripped(x, r"var ([^=]*)=")).otherwise(stripped(x, r"let ([^=]*)="))
    name = F.coalesce(stripped(x, r"function ([^(]*)\("), stripped(x, r"const ([^=]*)="), F.when(older, variable))
    quoted = found(x, r'"([^"]*)"')
    return [
        element(x.contains("function ") | arrow | older, "function", name, x, parameters=plain_parameters(x)),
        element(x.contains("class "), "class", strip(F.regexp_extract(x, r"class ([^ {]*)", 1)), x),
        element(x.startswith("import ") | x.startswith("require("), "module", quoted, None),
    ]


def python(x: Column) -> list[Column]:
    module = F.when(x.startswith("import "), stripped(x, r"^import ([^ ]*)")).otherwise(stripped(x, r"^from (.*?) import"))
    return [
        element(x.startswith("def "), "function", stripped(x, r"def ([^(]*)\("), x, parameters=plain_parameters(x)),
        element(x.startswith("class "), "class", stripped(x, r"class ([^:(]*)[:(]"), x),
        element(starts_with_any(x, "import ", "from "), "module", module, None),
    ]


def rust(x: Column) -> list[Column]:
    seen = F.when(x.startswith("pub "), F.lit("public")).otherwise(F.lit("private"))
    return [
        element(x.startswith("fn ") | x.contains(" fn "), "function", stripped(x, r"fn ([^<(]*)[<(]"), x, seen, plain_parameters(x), stripped(x, r"-> ([^{;]*)[{;]")),
        element(x.startswith("struct ") | x.contains(" struct "), "struct", stripped(x, r"struct ([^ {<]*)[ {<]"), x, seen),
        element(x.startswith("enum ") | x.contains(" enum "), "enum", stripped(x, r"enum ([^ {]*)[ {]"), x, seen),
        element(x.startswith("use "), "module", stripped(x, r"use ([^;{:]*)[;{:]"), None),
    ]


def go(x: Column) -> list[Column]:
    rest = F.regexp_extract(x, r"^func (.*)$", 1)
    named = F.when(rest.rlike(r"^\([^)]*\)"), F.regexp_replace(rest, r"^\([^)]*\)", "")).otherwise(rest)
    upper = F.regexp_extract(x, r"func ([^(]*)\(", 1).rlike(r"(?U)^\s*\p{Lu}")
    seen = F.when(upper, F.lit("public")).otherwise(F.lit("private"))
    tail = F.regexp_extract(x, r"type [^ ]* (.*)$", 1)
    kind = F.when(~tail.contains("struct") & tail.contains("interface"), F.lit("interface")).otherwise(F.lit("struct"))
    returns = F.when(x.rlike(r"\)[^{]*\{"), strip(F.regexp_extract(x, r"\)([^{]*)\{", 1)))
    return [
        element(x.startswith("func "), "function", F.when(named.contains("("), strip(F.regexp_extract(named, r"^([^(]*)\(", 1))), x, seen, plain_parameters(x), returns),
        element(x.startswith("type "), kind, stripped(x, r"type ([^ ]*) "), x, seen),
        element(x.startswith("import "), "module", found(x, r'"([^"]*)"'), None),
    ]


def _cut(x: Column, keyword: str, *stops: str) -> Column:
    """What follows the keyword, up to the first white space, or else the first of the stops that is there."""
    rest = F.regexp_extract(x, keyword + r"(.*)$", 1)
    cases = [(rest.rlike(r"(?U)\s"), F.regexp_extract(rest, r"(?U)^([^\s]*)\s", 1))]
    cases += [(rest.contains(s), F.substring_index(rest, s, 1)) for s in stops]
    name = strip(first_case(cases, rest))
    return F.when(name != "", name)


def swift(x: Column) -> list[Column]:
    seen = first_case([(any_of(x, "private ", "fileprivate "), "private"), (any_of(x, "public ", "open "), "public")], "internal")
    params = split_list(in_parens(x), lambda p: strip(F.substring_index(p, ":", 1)))
    rest = strip(F.regexp_extract(x, r"->(.*)$", 1))
    returns = F.when(x.contains("->"), first_case([(rest.contains("{"), strip(F.substring_index(rest, "{", 1)))], F.regexp_extract(rest, r"(?U)^[^\s]*", 0)))
    return [
        element(x.startswith("func "), "function", found(x, r"(?U)func \s*([^\s(]+)[^(]*\("), x, seen, params, returns),
        element(starts_with_any(x, "class ", "final class "), "class", _cut(x, "class ", ":", "{"), x, seen),
        element(x.startswith("struct "), "struct", _cut(x, "struct ", ":", "{"), x, seen),
        element(x.startswith("enum "), "enum", _cut(x, "enum ", ":", "{"), x, seen),
        element(x.startswith("import "), "module", stripped(x, r"import (.*)$"), None),
    ]


def objective_c(x: Column, earlier: Column) -> list[Column]:
    rest = F.regexp_extract(x, r"\)(.*)$", 1)
    name = strip(first_case([(rest.contains(":"), F.substring_index(rest, ":", 1)), (rest.contains("{"), F.substring_index(rest, "{", 1))], rest))
    seen = F.when(x.startswith("+"), F.lit("public")).otherwise(F.lit("private"))
    own = _cut(x, "@implementation ", "{")
    methods = F.transform(F.filter(earlier, lambda e: e.rlike(r"^[-+] .*\(")), lambda e: strip(F.regexp_extract(e, r"\)([^:{]*)", 1)))
    classes = F.transform(F.filter(earlier, lambda e: e.rlike("^@(interface|implementation) ")), lambda e: F.regexp_extract(e, r"(?U)^@\w+ ([^\s:{]*)", 1))
    known = F.array_contains(F.concat(methods, classes), own)
    return [
        element(x.rlike(r"^[-+] .*\(") & x.contains(")"), "method", F.when(name != "", name), x, seen, returns=strip(in_parens(x))),
        element(x.startswith("@interface "), "class", _cut(x, "@interface ", ":"), x),
        element(x.startswith("@implementation ") & ~known, "class", own, x),
        element(x.startswith("#import "), "module", F.when(x.contains('"'), found(x, r'"([^"]*)"')).otherwise(found(x, "<([^>]*)>")), None),
    ]


def java(x: Column) -> list[Column]:
    seen = first_case([(x.contains("public "), "public"), (x.contains("private "), "private"), (x.contains("protected "), "protected")], "package-private")

    def named(keyword: str, *stops: str) -> Column:
        rest = F.regexp_extract(x, keyword + r"(.*)$", 1)
        open_ = [(rest.contains("<"), F.substring_index(rest, "<", 1))] if keyword != "enum " else []
        cases = [*open_, (rest.rlike(r"(?U)\s"), F.regexp_extract(rest, r"(?U)^([^\s]*)\s", 1)), *[(rest.contains(s), F.substring_index(rest, s, 1)) for s in stops]]
        name = strip(first_case(cases, rest))
        return F.when(name != "", name)

    before = F.filter(F.split(strip(F.regexp_extract(x, r"^([^(]*)\(", 1)), r"(?U)\s+"), lambda w: w != "")
    last = F.get(before, F.size(before) - 1)
    method = F.when(~last.isin(*JAVA_WORDS) & ~last.contains("."), last)
    kept = F.filter(before, lambda w: ~w.isin(*JAVA_MODIFIERS))
    params = split_list(in_parens(x), lambda p: F.when(p.contains("="), strip(F.substring_index(p, "=", 1))).otherwise(F.regexp_extract(strip(p), r"(?U)[^\s]*$", 0)))
    modified = any_of(x, "public ", "private ", "protected ", "static ", "final ") & x.contains("(") & x.contains(")")
    return [
        element(x.contains("class ") & starts_with_any(x, "public ", "private ", "protected ", "abstract ", "final ", "class "), "class", named("class ", "extends", "implements", "{"), x, seen),
        element(x.contains("interface ") & starts_with_any(x, "public ", "private ", "protected ", "interface "), "interface", named("interface ", "extends", "{"), x, seen),
        element(x.contains("enum ") & starts_with_any(x, "public ", "private ", "protected ", "enum "), "enum", named("enum ", "implements", "{"), x, seen),
        element(modified & ~any_of(x, "class ", "interface ", "enum "), "method", method, x, seen, params, F.get(kept, F.size(kept) - 1)),
        element(x.startswith("import "), "module", stripped(F.regexp_replace(x, "^import (static )?", "import "), r"import (.*?);*$"), None),
    ]


def doc_comment(lines: Column, index: Column) -> Column:
    """The comment lines above a line; empty lines between are passed over, other ones end the comment."""
    above = F.transform(F.slice(lines, 1, index), strip)
    # the last line above that is neither empty nor a comment
    last = F.array_max(F.transform(above, lambda x, i: F.when((x != "") & ~starts_with_any(x, "//", "#"), i + 1).otherwise(F.lit(0))))
    own = F.filter(F.slice(above, F.coalesce(last, F.lit(0)) + 1, F.size(above)), lambda x: x != "")
    return F.when(F.size(own) > 0, F.array_join(own, "\n"))


RULES = {"javascript": javascript, "python": python, "rust": rust, "go": go, "swift": swift, "java": java}


def per_line(lines: Column, rules: Callable[[Column, Column], Column]) -> Column:
    """What rules (of a stripped line and its index) give for each line, in one array."""
    return F.flatten(F.transform(lines, lambda raw, i: F.get(F.transform(F.array(strip(raw)), lambda x: rules(x, i)), F.lit(0))))


def code_elements(files: DataFrame) -> DataFrame:
    """Rows of the code_elements table from prepared files."""
    used = files.where(F.col("language").isNotNull() & ~skipped() & ~minified())
    family = F.when(F.col("language") == "typescript", F.lit("javascript")).otherwise(F.col("language"))
    df = used.select("repository_id", F.col("path").alias("file_path"), "lines", family.alias("language"))
    lines = F.col("lines")

    def placed(candidates: list[Column], i: Column) -> Column:
        return F.transform(F.array_compact(F.array(*candidates)), lambda e, k: F.struct(i.alias("at"), k.alias("ord"), e.alias("e"), F.when(e["documented"], doc_comment(lines, i)).alias("doc")))

    cases = [(F.col("language") == name, per_line(lines, lambda x, i, rules=rules: placed(rules(x), i))) for name, rules in RULES.items()]
    objc = per_line(lines, lambda x, i: F.when(starts_with_any(x, "-", "+", "@", "#"), placed(objective_c(x, F.transform(F.slice(lines, 1, i), strip)), i)).otherwise(F.array().cast(PLACED)))
    found_ = first_case([*cases, (F.col("language") == "objective-c", objc)], F.array().cast(PLACED))
    rows = df.select("repository_id", "file_path", "language", F.explode(found_).alias("f"))
    return rows.select(
        stable_id(F.col("repository_id"), F.lit("code"), F.col("file_path"), F.col("f.at"), F.col("f.ord"), F.col("f.e.name")).alias("id"),
        "repository_id",
        F.col("f.e.name").alias("name"),
        F.col("f.e.element_type").alias("element_type"),
        "file_path",
        (F.col("f.at") + 1).alias("line_number"),
        "language",
        F.col("f.e.signature").alias("signature"),
        F.col("f.doc").alias("doc_comment"),
        F.col("f.e.visibility").alias("visibility"),
        F.col("f.e.parameters").alias("parameters"),
        F.col("f.e.return_type").alias("return_type"),
    )
