"""API endpoints: routes in code by framework pattern, and OpenAPI or API Gateway documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import any_of, first_ahead, first_case, found, stable_id
from tallgrass.sources.corpus import skipped_by_endpoints

#: Route patterns by framework. Two groups are method and path, one is the path.
EXPRESS = r"""(?:app|router|express)\.(get|post|put|delete|patch|all)\s*\(\s*['"]([^'"]+)['"]"""
ROUTER = r"""router\.(get|post|put|delete|patch|all)\s*\(\s*['"]([^'"]+)['"]"""
FASTIFY = r"""fastify\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""
NESTJS = r"""@(Get|Post|Put|Delete|Patch|All)\s*\(\s*['"]([^'"]+)['"]"""
NEXTJS = r"(?U)export\s+(?:default\s+)?(?:async\s+)?function\s+(\w+)"
FLASK = r"""@(?:app|bp|blueprint)\.route\s*\(\s*['"]([^'"]+)['"]"""
FLASK_METHODS = r"methods\s*=\s*\[([^\]]+)\]"
FASTAPI = r"""@(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""
DJANGO_PATH = r"""path\s*\(\s*['"]([^'"]+)['"]"""
DJANGO_URL = r"""url\s*\(\s*r['"]([^'"]+)['"]"""
RUST_ATTRIBUTE = r'#\[(get|post|put|delete|patch)\s*\(\s*"([^"]+)"'
RUST_ROUTE = r'\.route\s*\(\s*"([^"]+)"'
GIN = r'router\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*"([^"]+)"'
ECHO = r'e\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*"([^"]+)"'
CHI = r'r\.(Get|Post|Put|Delete|Patch)\s*\(\s*"([^"]+)"'
SPRING = r'@(Get|Post|Put|Delete|Patch)Mapping\s*\(\s*"([^"]+)"'
SPRING_REQUEST = r'@RequestMapping\s*\([^)]*value\s*=\s*"([^"]+)"'
JAXRS = r'@Path\s*\(\s*"([^"]+)"'
#: Where a handler's name stands.
JS_HANDLER = r"(?U)(?:function|const|let|var)\s+(\w+)\s*[=(]"
PY_HANDLER = r"(?U)def\s+(\w+)\s*\("
NEST_HANDLER = r"(?U)(\w+)\s*\([^)]*\)\s*[:{]"
RUST_HANDLER = r"(?U)(?:async\s+)?fn\s+(\w+)\s*\("
JAVA_HANDLER = r"(?U)(?:public|private|protected)?\s*(?:@\w+\s*){0,40}\s*(\w+)\s*\([^)]*\)"
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD")

ENDPOINT = "array<struct<line:int,path:string,method:string,handler:string,framework:string>>"
NONE = lambda: F.lit(None).cast("string")


def method_of(word: Column) -> Column:
    """GET where a word is no method; ANY for `all`."""
    up = F.upper(word)
    return F.when(up == "ALL", F.lit("ANY")).when(up.isin(*METHODS), up).otherwise(F.lit("GET"))


def route_parameters(path: Column) -> Column:
    """`:name` ones, then `{name}` ones."""
    return F.concat(F.regexp_extract_all(path, F.lit(r"(?U):(\w+)"), F.lit(1)), F.regexp_extract_all(path, F.lit(r"(?U)\{(\w+)\}"), F.lit(1)))


def _route(i: Column, path: Column, method: Column, handler: Column, framework) -> Column:
    framework = framework if isinstance(framework, Column) else F.lit(framework)
    return F.struct((i + 1).alias("line"), path.alias("path"), method.alias("method"), handler.alias("handler"), framework.alias("framework"))


def _all(x: Column, i: Column, pattern: str, handler: Column, framework) -> Column:
    """Every match of a (method, path) pattern in a line."""
    methods, paths = (F.regexp_extract_all(x, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(methods, paths, lambda m, p: _route(i, p, method_of(m), handler, framework))


def _paths(x: Column, i: Column, pattern: str, method: Column, handler: Column, framework: str) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda p: _route(i, p, method, handler, framework))


def _first(x: Column, i: Column, pattern: str, method: Column, handler: Column, framework: str) -> Column:
    return F.when(x.rlike(pattern), F.array(_route(i, F.regexp_extract(x, pattern, 1), method, handler, framework))).otherwise(F.array().cast(ENDPOINT))


def _javascript(lines: Column, path: Column):
    def each(x: Column, i: Column) -> Column:
        handler = F.coalesce(found(x, JS_HANDLER), first_ahead(lines, i, 4, JS_HANDLER))
        nest = first_ahead(lines, i, 9, NEST_HANDLER)
        api = F.concat(F.lit("/api/"), F.substring_index(F.regexp_extract(path, r"/api/(.*)$", 1), ".", 1))
        following = F.when(path.contains("/api/") & x.rlike(NEXTJS), F.array(_route(i, api, F.lit("ANY"), F.regexp_extract(x, NEXTJS, 1), "nextjs"))).otherwise(F.array().cast(ENDPOINT))
        return F.concat(_all(x, i, EXPRESS, handler, "express"), _all(x, i, ROUTER, handler, "express"), _all(x, i, FASTIFY, handler, "fastify"), _all(x, i, NESTJS, nest, "nestjs"), following)

    return each


def _python(lines: Column):
    def each(x: Column, i: Column) -> Column:
        handler, listed = first_ahead(lines, i, 4, PY_HANDLER), F.regexp_extract(x, FLASK_METHODS, 1)
        single = method_of(F.regexp_replace(F.trim(listed), r"^'+|'+$|^\"+|\"+$", ""))
        method = first_case([(~x.rlike(FLASK_METHODS), "GET"), (listed.contains(","), "ANY")], single)
        view = found(x, r"(?U)views\.(\w+)")
        return F.concat(_first(x, i, FLASK, method, handler, "flask"), _all(x, i, FASTAPI, handler, "fastapi"), _paths(x, i, DJANGO_PATH, F.lit("ANY"), view, "django"), _paths(x, i, DJANGO_URL, F.lit("ANY"), view, "django"))

    return each


def _rust(lines: Column):
    def each(x: Column, i: Column) -> Column:
        handler = first_ahead(lines, i, 9, RUST_HANDLER)
        method = first_case([(x.contains(f"web::{m}()"), m.upper()) for m in ("get", "post", "put", "delete")], "ANY")
        return F.concat(_all(x, i, RUST_ATTRIBUTE, handler, "actix"), _first(x, i, RUST_ROUTE, method, found(x, r"(?U)\.to\((\w+)\)"), "actix"), _all(x, i, RUST_ATTRIBUTE, handler, "rocket"))

    return each


def _go(x: Column, i: Column) -> Column:
    handler = found(x, r"(?U),\s*(\w+)\)")
    framework = first_case([(x.rlike(GIN), "gin"), (x.rlike(ECHO), "echo"), (x.rlike(CHI), "chi")]).cast("string")
    return F.concat(*[_all(x, i, p, handler, framework) for p in (GIN, ECHO, CHI)])


def _java(lines: Column):
    def each(x: Column, i: Column) -> Column:
        handler = first_ahead(lines, i, 9, JAVA_HANDLER)
        asked = first_case([(any_of(x, f"RequestMethod.{m}", f"method = {m}"), m) for m in METHODS[:4]], "ANY")
        back = F.slice(lines, F.greatest(i - 4, F.lit(1)), F.least(i + 1, F.lit(6)))
        verb = F.filter(F.transform(back, lambda b: first_case([(b.contains(f"@{m}"), m) for m in METHODS[:4]])), lambda v: v.isNotNull())
        return F.concat(_all(x, i, SPRING, handler, "spring"), _first(x, i, SPRING_REQUEST, asked, handler, "spring"), _first(x, i, JAXRS, F.coalesce(F.get(verb, F.lit(0)), F.lit("ANY")), handler, "jaxrs"))

    return each


def _yaml(lines: Column) -> Column:
    """The path in force at a line is that of the last path line up to there: one pass that carries it along."""
    start = F.struct(F.lit("").alias("path"), F.lit(0).alias("i"), F.array().cast("array<struct<line:int,path:string,method:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        path = F.when(x.rlike(r"^\s+/[^\s:]+:\s*$"), F.concat(F.lit("/"), F.regexp_extract(x, r"^\s+/([^\s:]+):\s*$", 1))).otherwise(a["path"])
        verb = F.regexp_extract(x, r"^\s+(get|post|put|delete|patch):\s*$", 1)
        row = F.struct((a["i"] + 1).alias("line"), path.alias("path"), F.upper(verb).alias("method"))
        return F.struct(path.alias("path"), (a["i"] + 1).alias("i"), F.when((verb != "") & (path != ""), F.concat(a["out"], F.array(row))).otherwise(a["out"]).alias("out"))

    return F.transform(F.aggregate(lines, start, step)["out"], lambda r: F.struct(r["line"].alias("line"), r["path"].alias("path"), r["method"].alias("method"), NONE().alias("handler"), F.lit("openapi").alias("framework")))


def _documents(content: Column, framework: str, condition: Column) -> Column:
    """Paths and methods of a JSON document, by two levels of objects."""
    paths = F.from_json(F.get_json_object(content, "$.paths"), "map<string,string>")
    made = F.flatten(
        F.transform(
            F.map_entries(paths),
            lambda e: F.transform(
                F.map_keys(F.coalesce(F.from_json(e["value"], "map<string,string>"), F.create_map().cast("map<string,string>"))),
                lambda m: F.struct(F.lit(None).cast("int").alias("line"), e["key"].alias("path"), F.when(F.upper(m).isin(*METHODS), F.upper(m)).otherwise(F.lit("ANY")).alias("method"), NONE().alias("handler"), F.lit(framework).alias("framework")),
            ),
        )
    )
    return F.when(condition & paths.isNotNull(), made).otherwise(F.array().cast(ENDPOINT))


def detect_endpoints(files: DataFrame) -> DataFrame:
    """Rows of the endpoints table; a route that two patterns fit is there twice."""
    used = files.where(~skipped_by_endpoints())
    lines, content, none = F.col("lines"), F.col("content"), F.array().cast(ENDPOINT)
    path = F.concat(F.lit("/"), F.col("path"))
    by_code = first_case(
        [
            (F.col("ext").isin("js", "jsx", "ts", "tsx"), F.flatten(F.transform(lines, _javascript(lines, path)))),
            (F.col("ext") == "py", F.flatten(F.transform(lines, _python(lines)))),
            (F.col("ext") == "rs", F.flatten(F.transform(lines, _rust(lines)))),
            (F.col("ext") == "go", F.flatten(F.transform(lines, _go))),
            (F.col("ext") == "java", F.flatten(F.transform(lines, _java(lines)))),
        ],
        none,
    )
    named = any_of(F.col("low_name"), "openapi", "swagger", "api-gateway", "serverless") | F.col("low_name").rlike(r"\.(json|ya?ml)$")
    has = lambda k: F.get_json_object(content, f"$['{k}']").isNotNull()
    opened = _documents(content, "openapi", named & (has("openapi") | has("swagger")))
    gateway = _documents(content, "api-gateway", named & has("x-amazon-apigateway-integration"))
    yaml = F.when(F.col("low_name").rlike(r"\.ya?ml$"), _yaml(lines)).otherwise(none)
    rows = used.select("repository_id", F.col("path").alias("file_path"), F.posexplode(F.concat(by_code, opened, gateway, yaml)).alias("ord", "e"))
    return rows.select(
        stable_id(F.lit("endpoint"), F.col("repository_id"), F.col("file_path"), F.col("ord")).alias("id"),
        "repository_id",
        F.col("e.path").alias("path"),
        F.col("e.method").alias("method"),
        F.col("e.handler").alias("handler"),
        "file_path",
        F.col("e.line").alias("line_number"),
        F.col("e.framework").alias("framework"),
        F.array().cast("array<string>").alias("middleware"),
        route_parameters(F.col("e.path")).alias("parameters"),
    )
