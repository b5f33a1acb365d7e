"""Ports in code and configuration: an ordered table of patterns, tried on each line inside the file's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallgrass.functions.text import any_of, ends_with_any, first_case, stable_id, strip
from tallgrass.sources.corpus import skipped_by_ports

#: By extension, (framework, pattern) in order. A line's framework is that of the first pattern that it fits.
CODE = {
    ("js", "jsx", "ts", "tsx"): [
        ("express", r"(?:app|server|express)\.listen\s*\(\s*(\d{4,5})\s*[,)]"),
        ("fastify", r"\.listen\s*\(\s*\{\s*port\s*:\s*(\d{4,5})\s*"),
        ("nestjs", r"await\s+(?:app|server)\.listen\s*\(\s*(\d{4,5})\s*"),
        ("nextjs", r"port\s*:\s*(\d{4,5})"),
        (None, r"process\.env\.PORT\s*\|\|\s*(\d{4,5})"),
    ],
    ("py",): [
        ("flask", r"app\.run\s*\([^)]*port\s*=\s*(\d{4,5})"),
        ("fastapi", r"uvicorn\.run\s*\([^)]*port\s*=\s*(\d{4,5})"),
        ("django", r"runserver\s+(\d{4,5})"),
        (None, r"\.run\s*\([^)]*port\s*=\s*(\d{4,5})"),
        (None, r"\.bind\s*\([^)]*,\s*(\d{4,5})\s*\)"),
    ],
    ("rs",): [
        ("actix", r'\.bind\s*\(\s*"[^"]*:(\d{4,5})"'),
        ("actix", r'\.bind\s*\(\s*\(\s*"[^"]*"\s*,\s*(\d{4,5})\s*\)'),
        ("axum", r"\.bind\s*\([^)]*:(\d{4,5})"),
    ],
    ("go",): [
        ("gin", r'\.Run\s*\(\s*":(\d{4,5})"'),
        ("echo", r'\.Start\s*\(\s*":(\d{4,5})"'),
        (None, r'http\.ListenAndServe\s*\(\s*":(\d{4,5})"'),
        (None, r'Listen\s*\(\s*"tcp"\s*,\s*":(\d{4,5})"'),
    ],
    ("java",): [
        ("spring", r"server\.port\s*=\s*(\d{4,5})"),
        ("spring", r"server\.port[:\s]*(\d{4,5})"),
        ("jetty", r"new\s+Server\s*\(\s*(\d{4,5})\s*\)"),
        ("tomcat", r"\.setPort\s*\(\s*(\d{4,5})\s*\)"),
    ],
}
#: A framework without a port of its own in code, and the one whose pattern it goes before.
LABELS = {"axum": ("rocket", r"rocket::build\s*\(\)")}
#: Patterns of configuration files.
CONFIG = {
    "env": r"(?i)^\s*(?:PORT|SERVER_PORT|APP_PORT|HTTP_PORT)\s*=\s*(\d{4,5})",
    "url": r"://[^:]+:(\d{4,5})",
    "json": r'(?i)"port"\s*:\s*(\d{4,5})',
    "yaml": r"(?i)^\s*port\s*:\s*(\d{4,5})",
    "docker": r'"(\d{4,5}):\d{4,5}"',
}
PORT = "array<struct<line:int,port:int,port_type:string,context:string,framework:string,environment:string,is_config:boolean>>"
LOW, HIGH = 1024, 49151


def _candidate(line: Column, i: Column, pattern: str, kind: Column, framework: Column, environment: Column, config: bool) -> Column:
    port = F.regexp_extract(line, pattern, 1).try_cast("int")
    made = F.struct((i + 1).alias("line"), port.alias("port"), kind.alias("port_type"), strip(line).alias("context"), framework.alias("framework"), environment.alias("environment"), F.lit(config).alias("is_config"))
    return F.when(line.rlike(pattern) & port.between(LOW, HIGH), made)


def environment_of(low_name: Column) -> Column:
    return first_case([(any_of(low_name, ".prod", "production"), "production"), (any_of(low_name, ".dev", "development"), "development"), (any_of(low_name, ".test", "testing"), "testing"), (any_of(low_name, ".staging", "staging"), "staging")])


def detect_ports(files: DataFrame) -> DataFrame:
    """Rows of the ports table; of rows that share port, file and line the first by pattern stays."""
    used = files.where(~skipped_by_ports())
    lines, none, null = F.col("lines"), F.array().cast(PORT), F.lit(None).cast("string")
    env = environment_of(F.col("low_name"))

    def code(patterns) -> Column:
        def each(x: Column, i: Column) -> Column:
            labels = [y for f, p in patterns if f for y in ([LABELS[f]] if f in LABELS else []) + [(f, p)]]
            framework = first_case([(x.rlike(p), f) for f, p in labels]).cast("string")
            return F.array_compact(F.array(*[_candidate(x, i, p, F.lit("http_server"), framework, null, False) for _, p in patterns]))

        return F.flatten(F.transform(lines, each))

    def config(x: Column, i: Column) -> Column:
        kind = first_case([(any_of(x, "postgres", "mysql", "mongodb"), "database"), (x.contains("redis"), "cache")], "other")
        kinds = {"url": kind}
        return F.array_compact(F.array(*[_candidate(x, i, p, kinds.get(n, F.lit("http_server")), null, null if n == "docker" else env, True) for n, p in CONFIG.items()]))

    from_code = first_case([(F.col("ext").isin(*exts), code(p)) for exts, p in CODE.items()], none)
    is_config = ends_with_any(F.col("low_name"), ".env", ".config", ".json", ".yaml", ".yml", ".toml") | F.col("low_name").contains("config")
    from_config = F.when(is_config, F.flatten(F.transform(lines, config))).otherwise(none)
    rows = used.select("repository_id", F.col("path").alias("file_path"), F.posexplode(F.concat(from_code, from_config)).alias("ord", "p"))
    flat = rows.select("repository_id", "p.port", "p.port_type", "p.context", "file_path", F.col("p.line").alias("line_number"), "p.framework", "p.environment", "p.is_config", "ord")
    key = ("repository_id", "port", "file_path", "line_number")
    first = flat.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("ord"))).where("k = 1")
    return first.select(stable_id(F.lit("port"), *[F.col(c) for c in key]).alias("id"), *[c for c in flat.columns if c != "ord"])
