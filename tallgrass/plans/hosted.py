"""Detectors over files that Spark renders from the tables' rows: what they find is what the SQL reads from the rows themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.operators import code, docs, endpoints, manifests, relate, rule_scan, services
from tallgrass.sources import corpus
from tallgrass.sources.hosts import Hosts
from tallgrass.sources.rules import builtin

#: name: (query of the hosts, SQL)
HOSTED: dict[str, tuple[Callable[[Hosts], DataFrame], str]] = {}


def hosted(name: str, sql: str):
    def add(f: Callable[[Hosts], DataFrame]):
        HOSTED[name] = (f, sql)
        return f

    return add


def files_of(h: Hosts, lines: str) -> DataFrame:
    """The files that a SELECT of (repository_id, path, line, line_text) spells out, a bounded number of lines each."""
    rows = h.sql(lines)
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "line_text"))), lambda x: x["line_text"]), "\n")
    return corpus.prepared(rows.groupBy("repository_id", "path").agg(content.alias("content")))


ELEMENTS = "SELECT repository_id, element_id AS id, path AS file_path, CAST(line AS INT) AS line_number FROM h_code_lines"
SERVICES = "SELECT (2 * s_suppkey + 3) % 5 AS repository_id, s_suppkey AS id, s_name AS name, concat('vendor-', CAST(s_nationkey AS STRING)) AS provider FROM h_suppliers"
DEPENDENCIES = "SELECT (2 * s_suppkey + 3) % 5 AS repository_id, s_suppkey AS id, dep AS name FROM h_suppliers"

_WINDOW = "l.repository_id = e.repository_id AND l.file_path = e.file_path AND l.line BETWEEN greatest(e.line_number - 50, 1) AND e.line_number + 199"


def _bounded(text: str, word: str) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9_])' || {word} || '($|[^a-z0-9_])')"


@hosted(
    "j4_file_services",
    f"""WITH e AS ({ELEMENTS}), s AS ({SERVICES}),
  l AS (SELECT l.repository_id, path AS file_path, line, s.id, name, provider, contains(lower(line_text), lower(name)) AS n, contains(lower(line_text), provider) AS p, {_bounded("lower(line_text)", "lower(name)")} AS w
    FROM h_code_lines l JOIN s ON l.repository_id = s.repository_id WHERE contains(lower(line_text), lower(name)) OR contains(lower(line_text), provider)),
  f AS (SELECT e.id AS code_element_id, l.id AS target_id, name, provider, bool_or(n) AS n, bool_or(p) AS p, bool_or(w) AS w FROM e JOIN l ON {_WINDOW} GROUP BY ALL)
  SELECT code_element_id, target_id, CAST(CASE WHEN n THEN 3 ELSE 0 END + CASE WHEN p THEN 2 ELSE 0 END + CASE WHEN w THEN 4 ELSE 0 END AS DOUBLE) / 10 AS confidence,
    array_to_string(list_filter([CASE WHEN n THEN 'Service name ''' || name || ''' found in code' END, CASE WHEN p THEN 'Provider ''' || provider || ''' found in code' END, CASE WHEN w THEN 'SDK pattern ''' || lower(name) || ''' detected' END], lambda x: x IS NOT NULL), '; ') AS evidence
  FROM f WHERE n OR w""",
)
def j4_file_services(h: Hosts) -> DataFrame:
    found = relate.service_relationships(h.sql(ELEMENTS), files_of(h, "SELECT * FROM h_code_lines"), h.sql(SERVICES))
    return found.select("code_element_id", "target_id", "confidence", "evidence")


_PART = lambda k: f"{_bounded('lower(line_text)', f'split_part(name, {chr(39)}/{chr(39)}, {k})')} AND contains(name, '/')"


@hosted(
    "j5_file_imports",
    f"""WITH e AS ({ELEMENTS}), d AS ({DEPENDENCIES}),
  l AS (SELECT l.repository_id, path AS file_path, line, d.id, name, contains(lower(line_text), 'from ''' || name) AS i, {_bounded("lower(line_text)", "name")} AS w, {_PART(1)} AS a, {_PART(2)} AS b
    FROM h_code_lines l JOIN d ON l.repository_id = d.repository_id),
  near AS (SELECT e.id AS code_element_id, l.id AS target_id, name, false AS i, bool_or(w) AS w, bool_or(a) AS a, bool_or(b) AS b FROM e JOIN l ON {_WINDOW} WHERE w OR a OR b GROUP BY ALL),
  far AS (SELECT DISTINCT e.id AS code_element_id, l.id AS target_id, name, true AS i, false AS w, false AS a, false AS b FROM e JOIN l ON l.repository_id = e.repository_id AND l.file_path = e.file_path WHERE l.i),
  f AS (SELECT code_element_id, target_id, name, bool_or(i) AS i, bool_or(w) AS w, bool_or(a) AS a, bool_or(b) AS b FROM (FROM near UNION ALL FROM far) GROUP BY ALL)
  SELECT code_element_id, target_id, least(1.0, CAST(CASE WHEN i THEN 6 ELSE 0 END + CASE WHEN w THEN 4 ELSE 0 END + CASE WHEN a THEN 3 ELSE 0 END + CASE WHEN b THEN 3 ELSE 0 END AS DOUBLE) / 10) AS confidence,
    array_to_string(list_filter([CASE WHEN i THEN 'Import statement found: from ''' || name END, CASE WHEN w THEN 'Package ''' || name || ''' used in code' END,
      CASE WHEN a THEN 'Scoped package part ''' || split_part(name, '/', 1) || ''' found' END, CASE WHEN b THEN 'Scoped package part ''' || split_part(name, '/', 2) || ''' found' END], lambda x: x IS NOT NULL), '; ') AS evidence
  FROM f""",
)
def j5_file_imports(h: Hosts) -> DataFrame:
    found = relate.dependency_relationships(h.sql(ELEMENTS), files_of(h, "SELECT * FROM h_code_lines"), h.sql(DEPENDENCIES))
    return found.select("code_element_id", "target_id", "confidence", "evidence")


@hosted(
    "j6_rule_hits",
    """SELECT f.repository_id, path AS file_path, 'api' AS family, p_brand AS provider, p_type AS service_type, concat('host-', word, '.example API') AS name, CAST(min(line) AS INT) AS line_number, CAST(p_size AS DOUBLE) / 100 AS confidence
  FROM h_service_lines f JOIN h_service_rules r ON r.key = f.key WHERE r.family = 'api' AND f.kind = 'py' GROUP BY ALL
  UNION ALL SELECT f.repository_id, path, 'env', p_brand, p_type, concat('SKU', word, ' Service'), CAST(line AS INT), CAST(p_size AS DOUBLE) / 100
  FROM h_service_lines f JOIN h_service_rules r ON r.key = f.key WHERE r.family = 'env' AND f.kind = 'env'""",
)
def j6_rule_hits(h: Hosts) -> DataFrame:
    """Two rules for each part, looked for in a program and a settings file of each customer, of a line for each order."""
    rows = h.sql("SELECT family, key AS rank, pattern, p_brand AS provider, p_type AS service_type, CAST(p_size AS DOUBLE) / 100 AS confidence, CAST(NULL AS STRING) AS service_name FROM h_service_rules")
    files = files_of(h, "SELECT repository_id, path, line, line_text FROM h_service_lines")
    return rule_scan.table_hits(files.withColumn("class", services.file_class(F.col("low_name"))), rows)


def rendered(h: Hosts, rows: str, name: str, content: Callable[[Callable[..., Column]], Column]) -> DataFrame:
    """A file for each repository of the rows of a SELECT (repository_id, pos, line_text, part), in order of pos; content gets `lines(sep, part)`, the rows' texts of one part or all."""
    made = h.sql(rows).groupBy("repository_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line_text", "part"))).alias("r"))  # a bounded number in a file

    def lines(sep: str = "\n", part: int | None = None) -> Column:
        some = F.col("r") if part is None else F.filter("r", lambda x: x["part"] == part)
        return F.array_join(F.transform(some, lambda x: x["line_text"]), sep)

    return corpus.prepared(made.select(F.col("repository_id").cast("string").alias("repository_id"), F.lit(name).alias("path"), content(lines).alias("content")))


# A repository for each two hundred parts, with a manifest of them; a third are for development.
PARTS = "SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS repository_id, p_partkey AS pos, {line} AS line_text, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS part FROM part"
NAME, VERSION = "concat('lib-', CAST(p_partkey AS STRING))", "concat(CAST(p_size AS STRING), '.', CAST(p_partkey % 7 AS STRING))"
DEP = ("name", "version", "package_manager", "is_dev", "is_optional", "file_path")


def manifest(query: str, detect, file: str, manager: str, line: str, content, name: str = NAME, version: str = VERSION, dev: str = "p_partkey % 3 = 0", optional: str = "false"):
    found = f"SELECT repository_id, name, version, '{manager}' AS package_manager, is_dev, is_optional, '{file}' AS file_path FROM (SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS repository_id, {name} AS name, {version} AS version, {dev} AS is_dev, {optional} AS is_optional FROM part)"
    hosted(query, found)(lambda h: detect(rendered(h, PARTS.format(line=line), file, content)).select(F.col("repository_id").cast("long").alias("repository_id"), *DEP))


manifest("f1_part_packages", manifests.npm, "package.json", "npm", f"concat('\"', {NAME}, '\": \"', {VERSION}, '\"')", lambda lines: F.concat(F.lit('{"dependencies": {'), lines(", ", 0), F.lit('}, "devDependencies": {'), lines(", ", 1), F.lit("}}")))
PIP = "CASE p_partkey % 4 WHEN 0 THEN '==' WHEN 1 THEN '>=' WHEN 2 THEN '~=' ELSE '' END"
manifest("f2_part_requirements", manifests.pip, "requirements.txt", "pip", f"concat({NAME}, {PIP}, CASE WHEN p_partkey % 4 = 3 THEN '  # any' ELSE {VERSION} END)", lambda lines: lines(), version=f"CASE p_partkey % 4 WHEN 0 THEN {VERSION} WHEN 3 THEN 'latest' ELSE concat({PIP}, {VERSION}) END", dev="false")
manifest("f3_part_crates", manifests.cargo, "Cargo.toml", "cargo", f"concat({NAME}, ' = \"', {VERSION}, '\"')", lambda lines: F.concat(F.lit('[package]\nname = "x"\n[dependencies]\n'), lines("\n", 0), F.lit("\n[dev-dependencies]\n"), lines("\n", 1), F.lit("\n")))
POM = f"concat('<dependency>', chr(10), '<groupId>org.', CAST(p_size AS STRING), '</groupId>', chr(10), '<artifactId>', {NAME}, '</artifactId>', chr(10), '<version>', {VERSION}, '</version>', chr(10), CASE WHEN p_partkey % 3 = 0 THEN concat('<scope>test</scope>', chr(10)) ELSE '' END, '</dependency>')"
manifest("f4_part_poms", manifests.maven, "pom.xml", "maven", POM, lambda lines: F.concat(F.lit("<project>\n<dependencies>\n"), lines(), F.lit("\n</dependencies>\n</project>\n")), name=f"concat('org.', CAST(p_size AS STRING), ':', {NAME})")
manifest("f5_part_modules", manifests.go, "go.mod", "go", f"concat(chr(9), 'github.com/own/', {NAME}, ' v', {VERSION})", lambda lines: F.concat(F.lit("module example.com/m\n\ngo 1.21\n\nrequire (\n"), lines(), F.lit("\n)\n")), name=f"concat('github.com/own/', {NAME})", version=f"concat('v', {VERSION})", dev="false")
manifest("f6_part_swift", manifests.swift, "Package.swift", "swift-package-manager", f"concat('    .package(url: \"https://github.com/own/', {NAME}, '.git\", from: \"', {VERSION}, '\"),')", lambda lines: F.concat(F.lit('let package = Package(\n  name: "x",\n  dependencies: [\n'), lines(), F.lit("\n  ],\n")), dev="false")
manifest("f7_part_pods", manifests.cocoapods, "Podfile", "cocoapods", f"concat('pod ', chr(39), {NAME}, chr(39), ', ', chr(39), '~> ', {VERSION}, chr(39))", lambda lines: F.concat(F.lit("platform :ios\n"), lines(), F.lit("\n")), dev="false")


@hosted(
    "f25_part_elements",
    """SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS repository_id, 'a.py' AS file_path, CAST(p_partkey % 200 + 1 AS INT) AS line_number, 'python' AS language,
  CASE p_partkey % 3 WHEN 0 THEN concat('m', CAST(p_partkey AS STRING)) WHEN 1 THEN concat('C', CAST(p_partkey AS STRING)) ELSE concat('g', CAST(p_partkey AS STRING)) END AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'module' WHEN 1 THEN 'class' ELSE 'function' END AS element_type, CASE p_partkey % 3 WHEN 2 THEN 'a|b' ELSE '' END AS parameters FROM part""",
)
def f25_part_elements(h: Hosts) -> DataFrame:
    line = "CASE p_partkey % 3 WHEN 0 THEN concat('import m', CAST(p_partkey AS STRING)) WHEN 1 THEN concat('class C', CAST(p_partkey AS STRING), '(Base):') ELSE concat('def g', CAST(p_partkey AS STRING), '(a, b):') END"
    found = code.code_elements(rendered(h, PARTS.format(line=line), "a.py", lambda lines: lines()))
    return found.select(F.col("repository_id").cast("long").alias("repository_id"), "file_path", "line_number", "language", "name", "element_type", F.array_join("parameters", "|").alias("parameters"))


@hosted(
    "f37_order_routes",
    """SELECT repository_id, path AS file_path, CAST(line AS INT) AS line_number, concat('/orders/', CAST(o_orderkey AS STRING), '/:item') AS path, upper(method) AS method, 'express' AS framework, 'item' AS parameters FROM h_routes""",
)
def f37_order_routes(h: Hosts) -> DataFrame:
    """A file of routes for each customer, a route for each order."""
    found = endpoints.detect_endpoints(files_of(h, "SELECT repository_id, path, line, concat('app.', method, '(', chr(39), '/orders/', CAST(o_orderkey AS STRING), '/:item', chr(39), ', h);') AS line_text FROM h_routes"))
    return found.select("repository_id", "file_path", "line_number", "path", "method", "framework", F.array_join("parameters", "|").alias("parameters"))


# A settings file, a program and a template for each supplier, by turns of the known rules.
KNOWN = {
    "database": (".env", "concat('DATABASE_URL=', word, 'h', CAST(s_suppkey AS STRING), '/db')", (("postgres://", "Postgres", "Database", "postgres Database"), ("mysql://", "MySQL", "Database", "mysql Database"), ("mongodb://", "MongoDB", "Database", "mongodb Database"), ("redis://", "Redis", "Database", "redis Database")), 0.9),
    "infrastructure": ("main.tf", "concat('resource \"', word, '\" \"r', CAST(s_suppkey AS STRING), '\" ')", (("aws_sns", "Aws", "CloudProvider", "SNS"), ("aws_sqs", "Aws", "CloudProvider", "SQS"), ("aws_cognito", "Aws", "Auth", "Cognito"), ("aws_rds", "RDS", "Database", "RDS")), 0.8),
    "sdk": ("a.js", "concat('import x', CAST(s_suppkey AS STRING), ' from ', chr(39), word, chr(39), ';')", (("stripe", "Stripe", "Payment", "stripe SDK"), ("twilio", "Twilio", "Api", "twilio SDK"), ("discord.js", "Discord", "Api", "discord.js SDK"), ("replicate", "Replicate", "AI", "replicate SDK")), 0.8),
    "aws_v2": ("b.js", "concat('const AWS = require(', chr(39), 'aws-sdk', chr(39), '); const c', CAST(s_suppkey AS STRING), ' = new AWS.', word, '()')", (("SNS", "Aws", "CloudProvider", "AWS SNS"), ("SQS", "Aws", "CloudProvider", "AWS SQS"), ("KMS", "Aws", "CloudProvider", "AWS KMS"), ("S3", "Aws", "CloudProvider", "AWS S3")), 0.85),
}


def _known(family: str):
    file, line, rules, confidence = KNOWN[family]
    pick = lambda k: "CASE s_suppkey % 4 " + " ".join(f"WHEN {n} THEN '{r[k]}'" for n, r in enumerate(rules)) + " END"
    sql = f"SELECT s_nationkey AS repository_id, concat('s', CAST(s_suppkey AS STRING), '/{file}') AS file_path, {pick(1)} AS provider, {pick(2)} AS service_type, {pick(3)} AS name, CAST(s_suppkey % 5 + 1 AS INT) AS line_number, CAST({confidence} AS DOUBLE) AS confidence FROM supplier"

    def query(h: Hosts) -> DataFrame:
        rows = h.sql(f"SELECT s_nationkey AS repository_id, concat('s', CAST(s_suppkey AS STRING), '/{file}') AS path, s_suppkey % 5 AS blank, {line} AS line_text FROM (SELECT *, {pick(0)} AS word FROM supplier)")
        files = corpus.prepared(rows.select("repository_id", "path", F.concat(F.repeat(F.lit("\n"), F.col("blank").cast("int")), "line_text", F.lit("\n")).alias("content")))
        found = rule_scan.rule_hits(files.withColumn("class", services.file_class(F.col("low_name"))), builtin())
        return found.where(F.col("family") == family).select("repository_id", "file_path", "provider", "service_type", "name", "line_number", "confidence")

    return sql, query


for _name, _family in (("f13_supplier_databases", "database"), ("f14_supplier_resources", "infrastructure"), ("f15_supplier_sdks", "sdk"), ("f16_supplier_aws_v2", "aws_v2")):
    HOSTED[_name] = _known(_family)[::-1]


@hosted(
    "f42_document_titles",
    """SELECT concat('docs/d', CAST(doc_id AS STRING), '.md') AS file_path, 'reference' AS doc_type, concat('Document ', CAST(doc_id AS STRING)) AS title,
  concat('Written in ', lang, ' for ', source, ' at length ', CAST(n_chars AS STRING), '.') AS description FROM documents""",
)
def f42_document_titles(h: Hosts) -> DataFrame:
    """A page about each document."""
    about = F.concat(F.lit("# Document "), "doc_id", F.lit("\n\nWritten in "), "lang", F.lit(" for "), "source", F.lit(" at length "), "n_chars", F.lit(".\n"))
    pages = h.table("documents").select((F.col("doc_id") % 25).alias("repository_id"), F.concat(F.lit("docs/d"), "doc_id", F.lit(".md")).alias("path"), about.alias("content"))
    return docs.index_documentation(corpus.prepared(pages)).select("file_path", "doc_type", "title", "description")
