"""Detectors over an inline corpus, with the rows that they have to give spelled out as VALUES."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators import ask as Q
from tallgrass.operators import code, docs, endpoints, manifests, ports, relate, rule_scan, secrets, security, services, tools
from tallgrass.operators import tests as T
from tallgrass.sources import corpus
from tallgrass.sources.rules import builtin

FIXTURES: dict[str, tuple[Callable[[SparkSession], DataFrame], str | None]] = {}


def files_of(spark: SparkSession, files: dict[str, str], repository_id: str = "r") -> DataFrame:
    return corpus.prepared(spark.createDataFrame([(repository_id, p, c) for p, c in files.items()], corpus.SCHEMA))


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple], types: dict[str, str] | None = None) -> str:
    names = columns.split()
    if not rows:
        rows, none = [tuple(None for _ in names)], " WHERE false"
    else:
        none = ""
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    shown = ", ".join(f"CAST({n} AS {types[n]}) AS {n}" if types and n in types else n for n in names)
    return f"SELECT {shown} FROM (VALUES {body}) t({', '.join(names)}){none}"


def fixture(name: str, files: dict[str, str], detect: Callable[[DataFrame], DataFrame], columns: str, rows: list[tuple], **types: str) -> None:
    FIXTURES[name] = (lambda spark: detect(files_of(spark, files)).select(*columns.split()), values(columns, rows, types))


def joined(*names: str) -> dict[str, Column]:
    return {n: F.array_join(n, "|") for n in names}


DEP = "name version package_manager is_dev is_optional file_path"
PACKAGE = '{"dependencies": {"express": "^4.18.0", "lodash": "4.17.21", "odd": 7}, "devDependencies": {"jest": "^29.0.0", "eslint": "8.1.0"}, "optionalDependencies": {"fsevents": "2.3.2"}, "scripts": {"build": "webpack --mode production", "test": "jest", "serve": "webpack serve", "own": "node x.js"}}'
fixture("f1_npm", {"package.json": PACKAGE, "sub/package.json": PACKAGE}, manifests.npm, DEP, [("express", "^4.18.0", "npm", False, False, "package.json"), ("lodash", "4.17.21", "npm", False, False, "package.json"), ("odd", "unknown", "npm", False, False, "package.json"), ("jest", "^29.0.0", "npm", True, False, "package.json"), ("eslint", "8.1.0", "npm", True, False, "package.json"), ("fsevents", "2.3.2", "npm", False, True, "package.json")])
fixture("f2_pip", {"requirements.txt": "flask==2.3.0\n# comment\n\nrequests>=2.31.0  # later\r\nnumpy\npandas~=2.0\nscipy<=1.9\nold<3\nnew>1\nboth>=1,==2\n"}, manifests.pip, DEP, [(n, v, "pip", False, False, "requirements.txt") for n, v in (("flask", "2.3.0"), ("requests", ">=2.31.0"), ("numpy", "latest"), ("pandas", "~=2.0"), ("scipy", "<=1.9"), ("old", "<3"), ("new", ">1"), ("both>=1,", "2"))])
fixture("f3_cargo", {"Cargo.toml": '[package]\nname = "x"\n[dependencies]\nserde = { version = "1.0", features = ["derive"] }\ntokio = "1.35"\nlocal = { path = "../l" }\n[dev-dependencies]\nmockito = "1.2"\n'}, manifests.cargo, DEP, [("serde", "1.0", "cargo", False, False, "Cargo.toml"), ("tokio", "1.35", "cargo", False, False, "Cargo.toml"), ("local", "unknown", "cargo", False, False, "Cargo.toml"), ("mockito", "1.2", "cargo", True, False, "Cargo.toml")])
POM = "<project>\n<dependencies>\n<dependency>\n  <groupId>org.springframework</groupId>\n  <artifactId>spring-core</artifactId>\n  <version>5.3.0</version>\n</dependency>\n<dependency>\n  <groupId>junit</groupId>\n  <artifactId>junit</artifactId>\n  <scope>test</scope>\n  <optional>true</optional>\n</dependency>\n<dependency>\n  <artifactId>alone</artifactId>\n  <version>1</version>\n</dependency>\n</dependencies>\n</project>\n"
fixture("f4_maven", {"pom.xml": POM, "target/pom.xml": POM, "m/pom.xml": "<dependency>\n<artifactId>m</artifactId>\n</dependency>"}, manifests.maven, DEP, [("org.springframework:spring-core", "5.3.0", "maven", False, False, "pom.xml"), ("junit:junit", "unknown", "maven", True, True, "pom.xml"), ("alone", "1", "maven", False, False, "pom.xml"), ("m", "unknown", "maven", False, False, "m/pom.xml")])
fixture("f5_go", {"go.mod": "module example.com/m\n\ngo 1.21\n\nrequire github.com/one/x v1.0.0\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.1\n\tgithub.com/bare/y\n)\n// note\n"}, manifests.go, DEP, [("github.com/one/x", "v1.0.0", "go", False, False, "go.mod"), ("github.com/gin-gonic/gin", "v1.9.1", "go", False, False, "go.mod"), ("github.com/bare/y", "latest", "go", False, False, "go.mod")])
fixture("f6_swift", {"App/Package.swift": 'let package = Package(\n  name: "x",\n  dependencies: [\n    .package(url: "https://github.com/a/Alamofire.git", from: "5.8.0"),\n    .package(url: "https://github.com/b/Kit", exact: "1.2.3"),\n    .package(url: "https://github.com/c/Branch.git", branch: "main"),\n  ],\n  targets: [\n    .package(url: "https://github.com/d/No.git", from: "1.0"),\n'}, manifests.swift, DEP, [("Alamofire", "5.8.0", "swift-package-manager", False, False, "App/Package.swift"), ("Kit", "1.2.3", "swift-package-manager", False, False, "App/Package.swift"), ("Branch", "latest", "swift-package-manager", False, False, "App/Package.swift")])
fixture("f7_cocoapods", {"Podfile": "platform :ios\npod 'AFNetworking', '~> 4.0'\npod \"Alone\"\n# pod 'No'\npod 'Fixed', '1.2.3'\n"}, manifests.cocoapods, DEP, [("AFNetworking", "4.0", "cocoapods", False, False, "Podfile"), ("Alone", "latest", "cocoapods", False, False, "Podfile"), ("Fixed", "1.2.3", "cocoapods", False, False, "Podfile")])
PBX = 'x = {\n  AB /* XCRemoteSwiftPackageReference "kit" */ = {\n    isa = XCRemoteSwiftPackageReference;\n    repositoryURL = "https://github.com/a/kit";\n    requirement = {\n      kind = branch;\n      branch = "main";\n    };\n  };\n'
fixture("f8_xcode", {"A.xcodeproj/project.pbxproj": PBX, "B.xcodeproj/project.pbxproj": PBX}, manifests.xcode, DEP, [("kit", "branch:main", "swift-package-manager", False, False, "A.xcodeproj/project.pbxproj")])
fixture("f9_plugin_packages", {"is.packages.json": '{"packages": [{"name": "A", "requires": ["B", "C"]}, {"name": "D"}]}'}, manifests.plugin_packages, DEP, [("B", "unknown", "webmethods-is", False, False, "is.packages.json"), ("C", "unknown", "webmethods-is", False, False, "is.packages.json")])

ENV = "STRIPE_SECRET_KEY=x\n# OPENAI_API_KEY=no\nCLERK_MACHINE_DISCORD_TOKEN=y\nDISCORDANT_KEY=z\nTOGETHER_AI_KEY=q\nDATABASE_URL=postgres://h/db\nPLAIN=1\n"
SVC = "provider service_type name line_number confidence"
by_rules = lambda family: lambda f: rule_scan.rule_hits(f.withColumn("class", services.file_class(F.col("low_name"))), builtin()).where(F.col("family") == family)
fixture("f12_env_rules", {".env": ENV}, by_rules("env"), SVC, [("Stripe", "Payment", "STRIPE Service", 1, 0.7), ("Clerk", "Auth", "CLERK Service", 3, 0.7), ("TogetherAI", "AI", "TOGETHER Service", 5, 0.7)])
fixture("f13_db_urls", {".env": ENV, "b.yaml": "a: REDIS://x\nb: redis://y\n"}, by_rules("database"), SVC, [("Postgres", "Database", "postgres Database", 6, 0.9), ("Redis", "Database", "redis Database", 2, 0.9)])
fixture("f14_infrastructure", {"main.tf": 'x\nresource "aws_s3_bucket" "b" {}\nresource "aws_lambda_function" "f" {}\n'}, by_rules("infrastructure"), SVC, [("Aws", "CloudProvider", "S3", 2, 0.8), ("Aws", "CloudProvider", "Lambda", 3, 0.8)])
fixture("f15_sdk", {"a.js": "import Stripe from 'stripe';\n// import openai\nconst s = 'cohere inside a string';\nimport { S3Client } from '@aws-sdk/client-s3';\nimport x from '@aws-sdk/client-odd-thing';\n", "b.py": "import openai\n# import anthropic\nx = 'import cohere'\n", "c.js": "const t = turbopack_together_x;\n"}, by_rules("sdk"), "file_path " + SVC, [("a.js", "Aws", "CloudProvider", "AWS S3", 4, 0.9), ("a.js", "Aws", "CloudProvider", "AWS Odd Thing", 5, 0.9), ("a.js", "Stripe", "Payment", "stripe SDK", 1, 0.8), ("b.py", "OpenAI", "AI", "openai SDK", 1, 0.8)])
fixture("f16_aws_v2", {"a.js": "const AWS = require('aws-sdk');\nconst s3 = new AWS.S3();\n", "b.js": "require('aws-sdk')\n"}, by_rules("aws_v2"), SVC, [("Aws", "CloudProvider", "AWS S3", 2, 0.85), ("Aws", "CloudProvider", "AWS SDK (v2)", 1, 0.7)])
fixture("f17_api_hosts", {"a.py": "u = 'https://api.github.com/x'\nv = 'https://API.OPENAI.COM'\n"}, by_rules("api"), SVC, [("GitHub", "Api", "api.github.com API", 1, 0.7)])
fixture("f19_tools", {"package.json": PACKAGE, "run.sh": "#!/bin/bash\necho\n", "old.sh": "#!/bin/sh\n", "Makefile": "all:\n", ".nvmrc": "20\n", "venv/bin/activate": "x"}, lambda f: tools.detect_tools(f, manifests.npm(f)).withColumn("n_scripts", F.size("scripts")), "name tool_type category version_free n_scripts confidence".replace(" version_free", ""), [("npm scripts", "task_runner", "npm_scripts", 4, 0.9), ("webpack", "build_tool", "webpack", 0, 0.9), ("jest", "test_framework", "jest", 0, 0.9), ("eslint", "linter", "eslint", 0, 0.9), ("make", "task_runner", "make", 0, 0.9), ("run.sh (bash script)", "shell_script", "bash", 0, 0.8), ("old.sh (shell script)", "shell_script", "bash", 0, 0.7), ("Python Virtual Environment", "dev_environment", "venv", 0, 0.9), ("Node Version Manager", "dev_environment", "unknown", 0, 0.8)])

ELEMENT = "name element_type line_number language visibility parameters return_type doc_comment"
elements = lambda f: code.code_elements(f).withColumns(joined("parameters"))
fixture("f24_js", {"a.ts": 'import x from "react"\n// adds\nfunction add(a, b) {\nconst mul = (a) => a\nvar f = function(x) {\nclass Foo extends Bar {\nconst n = 3\nexport class Only{\n'}, elements, ELEMENT, [("react", "module", 1, "javascript", None, "", None, None), ("add", "function", 3, "javascript", None, "a|b", None, "// adds"), ("mul", "function", 4, "javascript", None, "a", None, None), ("f", "function", 5, "javascript", None, "x", None, None), ("Foo", "class", 6, "javascript", None, "", None, None), ("Only", "class", 8, "javascript", None, "", None, None)])
fixture("f25_python", {"a.py": "import os\nfrom a.b import c\n\n# note\n\nclass Foo(Bar):\n    def run(self, x):\n        pass\nasync def no(): pass\n"}, elements, ELEMENT, [("os", "module", 1, "python", None, "", None, None), ("a.b", "module", 2, "python", None, "", None, None), ("Foo", "class", 6, "python", None, "", None, "# note"), ("run", "function", 7, "python", None, "self|x", None, None)])
fixture("f26_rust", {"a.rs": "use std::fs;\n/// doc\npub fn go<T>(x: T) -> u8 {\nstruct S {\npub enum E {\nfn plain();\n"}, elements, ELEMENT, [("std", "module", 1, "rust", None, "", None, None), ("go", "function", 3, "rust", "public", "x: T", "u8", "/// doc"), ("S", "struct", 4, "rust", "private", "", None, None), ("E", "enum", 5, "rust", "public", "", None, None), ("plain", "function", 6, "rust", "private", "", None, None)])
fixture("f27_go_code", {"a.go": 'import "fmt"\nfunc (r *R) Get(x int) error {\nfunc Open(a string) (int, error) {\ntype T struct {\ntype I interface {\n'}, elements, ELEMENT, [("fmt", "module", 1, "go", None, "", None, None), ("Get", "function", 2, "go", "private", "r *R", "Get(x int) error", None), ("Open", "function", 3, "go", "public", "a string", "(int, error)", None), ("T", "struct", 4, "go", "private", "", None, None), ("I", "interface", 5, "go", "private", "", None, None)])
fixture("f28_swift_code", {"a.swift": "import UIKit\nfinal class Foo: Bar {\nfunc load(from url: URL, n: Int) -> String {\nstruct S{\nenum E: Int {\n"}, elements, ELEMENT, [("UIKit", "module", 1, "swift", None, "", None, None), ("Foo:", "class", 2, "swift", "internal", "", None, None), ("load", "function", 3, "swift", "internal", "from url|n", "String", None), ("S", "struct", 4, "swift", "internal", "", None, None), ("E:", "enum", 5, "swift", "internal", "", None, None)])
fixture("f29_objc", {"a.m": '#import "Foo.h"\n#import <UIKit/UIKit.h>\n@interface Foo : NSObject\n@implementation Foo\n- (void)run:(int)x {\n+ (id)make {\n@implementation Bar\n'}, elements, ELEMENT, [("Foo.h", "module", 1, "objective-c", None, "", None, None), ("UIKit/UIKit.h", "module", 2, "objective-c", None, "", None, None), ("Foo", "class", 3, "objective-c", None, "", None, '#import "Foo.h"\n#import <UIKit/UIKit.h>'), ("run", "method", 5, "objective-c", "private", "", "void", None), ("make", "method", 6, "objective-c", "public", "", "id", None), ("Bar", "class", 7, "objective-c", None, "", None, None)])
fixture("f30_java", {"A.java": "import static org.junit.Assert.assertTrue;\npublic class Foo<T> extends Bar {\n// runs\npublic String run(int a, String b) {\nprivate interface I {\npublic enum E {\n  static void main(String[] args) {\n"}, elements, ELEMENT, [("org.junit.Assert.assertTrue", "module", 1, "java", None, "", None, None), ("Foo", "class", 2, "java", "public", "", None, None), ("run", "method", 4, "java", "public", "a|b", "run", "// runs"), ("I", "interface", 5, "java", "private", "", None, None), ("E", "enum", 6, "java", "public", "", None, None), ("main", "method", 7, "java", "package-private", "args", "main", None)])
TEST = "name test_framework line_number suite_name assertions setup_methods"
tested = lambda f: T.detect_tests(f).withColumns(joined("assertions", "setup_methods"))
fixture("f32_js_tests", {"a.test.js": "describe('suite', () => {\n  beforeEach(() => {})\n  it('works', () => {\n    expect(1).toBe(1)\n  })\n  test.skip(\"later\", () => {})\n})\n"}, tested, TEST, [("works", "jest", 3, "suite", "expect(1).toBe(1)", ""), ("later", "jest", 6, "suite", "", "")])
fixture("f33_py_tests", {"tests/test_a.py": "import pytest\nclass TestX(Base):\n    def test_one(self):\n        assert 1\n"}, tested, TEST, [("test_one", "pytest", 3, "TestX", "assert 1", "setUp")])
fixture("f34_rust_go_tests", {"tests/a.rs": "#[test]\nfn works() {\n  assert_eq!(1, 1);\n}\n", "a_test.go": "func TestAdd(t *testing.T) {\n  t.Errorf(1)\n}\n"}, tested, TEST, [("works", "cargo_test", 1, None, "assert_eq!(1, 1);", ""), ("TestAdd", "go_test", 1, None, "t.Errorf(1)", "")])
fixture("f35_java_swift_tests", {"FooTest.java": "import org.junit.Test;\npublic class FooTest {\n  @Test\n  public void adds() {\n    assertTrue(true);\n", "FooTests.swift": "import XCTest\nclass FooTests: XCTestCase {\n  func testA() {\n    XCTAssertTrue(true)\n"}, tested, TEST, [("adds", "junit", 3, "FooTest", "assertTrue(true);", "@BeforeEach|@BeforeAll"), ("testA", "xctest", 3, "FooTests", "XCTAssertTrue(true)", "setUp()")])
PORT = "port port_type file_path line_number framework environment is_config"
fixture("f36_ports", {"server.js": "const port = process.env.PORT || 3000;\napp.listen(4000, cb)\napp.listen(80)\n", ".env": "PORT=8080\nDATABASE_URL=postgres://localhost:5432/x\nREDIS_URL=redis://localhost:6379\n", "app.py": "app.run(host='0', port=5000)\n", "main.rs": '.bind("127.0.0.1:8081")\n', "compose.prod.yml": 'ports:\n  - "9090:80"\n  - "9091:9092"\nport: 7000\n', "node_modules/x.js": "app.listen(5555)\n"}, ports.detect_ports, PORT, [(3000, "http_server", "server.js", 1, None, None, False), (4000, "http_server", "server.js", 2, "express", None, False), (8080, "http_server", ".env", 1, None, None, True), (5432, "database", ".env", 2, None, None, True), (6379, "cache", ".env", 3, None, None, True), (5000, "http_server", "app.py", 1, "flask", None, False), (8081, "http_server", "main.rs", 1, "actix", None, False), (9091, "http_server", "compose.prod.yml", 3, None, None, True), (7000, "http_server", "compose.prod.yml", 4, None, "production", True)])
ROUTE = "path method handler file_path line_number framework parameters"
routes = lambda f: endpoints.detect_endpoints(f).withColumns(joined("parameters"))
fixture("f37_endpoints", {"s.js": "app.get('/api/users', function list(req) {})\nrouter.post('/u/:id/:x', h)\nconst next = (a) => a\nfastify.put('/f', z)\n", "app.py": "@app.route('/posts', methods=['GET', 'POST'])\ndef posts():\n@app.route(\"/one\", methods=['DELETE'])\ndef one():\n@router.get('/i/{item}')\nasync def item():\npath('x/', views.xs)\n", "m.go": 'router.GET("/g", handle)\n', "A.java": '@GetMapping("/s")\npublic String show(int a) {\n@GET\n@Path("/j")\npublic String j() {\n', "m.rs": '#[get("/r")]\nasync fn r() {\n', "pages/api/users/[id].js": "export default async function handler(req) {}\n"}, routes, ROUTE, [("/api/users", "GET", "list", "s.js", 1, "express", ""), ("/u/:id/:x", "POST", "next", "s.js", 2, "express", "id|x"), ("/u/:id/:x", "POST", "next", "s.js", 2, "express", "id|x"), ("/f", "PUT", None, "s.js", 4, "fastify", ""), ("/posts", "ANY", "posts", "app.py", 1, "flask", ""), ("/one", "DELETE", "one", "app.py", 3, "flask", ""), ("/i/{item}", "GET", "item", "app.py", 5, "fastapi", "item"), ("x/", "ANY", "xs", "app.py", 7, "django", ""), ("/g", "GET", "handle", "m.go", 1, "gin", ""), ("/s", "GET", "show", "A.java", 1, "spring", ""), ("/j", "GET", "j", "A.java", 4, "jaxrs", ""), ("/r", "GET", "r", "m.rs", 1, "actix", ""), ("/r", "GET", "r", "m.rs", 1, "rocket", ""), ("/api/users/[id]", "ANY", "handler", "pages/api/users/[id].js", 1, "nextjs", "")])
fixture("f37_openapi", {"openapi.json": '{"openapi": "3.0.0", "paths": {"/users": {"get": {}, "post": {}}, "/users/{id}": {"get": {}, "put": {}, "delete": {}}}}', "api.yaml": "openapi: 3.0.0\npaths:\n  /a/{x}:\n    get:\n    post:\n"}, routes, ROUTE, [("/users", "GET", None, "openapi.json", None, "openapi", ""), ("/users", "POST", None, "openapi.json", None, "openapi", ""), ("/users/{id}", "GET", None, "openapi.json", None, "openapi", "id"), ("/users/{id}", "PUT", None, "openapi.json", None, "openapi", "id"), ("/users/{id}", "DELETE", None, "openapi.json", None, "openapi", "id"), ("/a/{x}", "GET", None, "api.yaml", 4, "openapi", "x"), ("/a/{x}", "POST", None, "api.yaml", 5, "openapi", "x")])
fixture("f42_documents", {"README.md": "# Title here\n\n```\nignored line that is long enough\n```\nA description that is long enough.\nwith npm\n", "docs/guide.md": "plain first line\n\nshort\n", "docs/x.md": "## Second\n", "CHANGELOG.md": "x\n", "api.md": "y ![arch](z)\n", "src/a.js": "x"}, docs.index_documentation, "file_path doc_type title description word_count line_count has_code_examples has_diagrams", [("README.md", "readme", "Title here", "A description that is long enough.", 19, 7, True, False), ("docs/guide.md", "tutorial", "plain first line", None, 4, 3, False, False), ("docs/x.md", "reference", "Second", None, 2, 1, False, False), ("CHANGELOG.md", "changelog", "x", None, 1, 1, False, False), ("api.md", "api_docs", "y ![arch](z)", None, 2, 1, False, True)], word_count="BIGINT", line_count="BIGINT")

TF = 'resource "aws_iam_role" "app" {\n  assume = "Effect Allow *"\n  arn = "arn:aws:iam::1:role/app"\n}\nresource "aws_s3_bucket" "logs" {\n  region = "eu-west-1"\n}\nresource "aws_lambda_function" "fn" {\n  role = aws_iam_role.app.arn\n  runtime = "python3.12"\n}\nresource "aws_security_group" "sg" {\n  ingress {\n    cidr_blocks = ["0.0.0.0/0"]\n  }\n}\n'
fixture("x2_terraform", {"main.tf": TF}, lambda f: security.detect_security(f)[0], "id entity_type name line_number arn", [("main.tf:0:app", "iam_role", "app", 1, "arn:aws:iam::1:role/app"), ("main.tf:4:logs", "s3_bucket", "logs", 5, "arn:aws:s3:::logs"), ("main.tf:7:fn", "lambda_function", "fn", 8, None), ("main.tf:11:sg", "security_group", "sg", 12, None)])
fixture("x8_findings", {"main.tf": TF}, lambda f: security.detect_security(f)[2], "entity_id vulnerability_type severity line_number", [("main.tf:0:app", "OverlyPermissiveAssumeRolePolicy", "High", 1), ("main.tf:4:logs", "UnencryptedS3Bucket", "Medium", 5), ("main.tf:11:sg", "OpenSecurityGroup", "High", 12)])
fixture("j21_lambda_role", {"main.tf": TF}, lambda f: security.detect_security(f)[1], "source_entity_id target_entity_id relationship_type", [("main.tf:7:fn", "main.tf:0:app", "uses")])
fixture("x3_templates", {"t.yaml": "AWSTemplateFormatVersion: '2010-09-09'\nTransform: AWS::Serverless-2016-10-31\nResources:\n  Fn:\n    Type: AWS::Serverless::Function\n    Properties:\n      Handler: a.b\n  Bucket:\n    Type: 'AWS::S3::Bucket'\n  Q:\n    Type: AWS::SQS::Queue\n", "serverless.yml": "service: s\nfunctions:\n  hello:\n    handler: h.main\n    runtime: python3.12\n"}, security.templates, "id entity_type name", [("t.yaml:Fn", "lambda_function", "Fn"), ("t.yaml:Bucket", "s3_bucket", "Bucket"), ("serverless.yml:hello", "lambda_function", "hello")])
fixture("x5_firebase", {"firestore.rules": "service x {\n allow read: if request.auth != null;\n allow write: if true;\n allow read, write: if true;\n}\n"}, lambda f: security.detect_security(f)[2], "vulnerability_type severity line_number", [("OverlyPermissiveFirebaseRules", "Critical", None), ("MissingAuthenticationCheck", "High", 3)])
fixture("x6_env_template", {".env.example": "# c\nA=1\nAPI_KEY=\nB = 2\nnot a pair\n"}, lambda f: security.environment_templates(f).select("name", F.element_at("configuration", "variable_count").cast("int").alias("variable_count"), F.element_at("configuration", "has_secrets").alias("has_secrets"), F.element_at("configuration", "variables").alias("variables")), "name variable_count has_secrets variables", [(".env.example", 3, "true", "A,API_KEY,B")])
KEYS = 'const apiKey = "sk1234567890abcdefghij1234"\n// apiKey = "sk1234567890abcdefghij1234"\nconst apiKey = "${process.env.X_API_KEY}aaaaaaaaaaaa"\nsecret_key: "aaaaaaaaaaaaaaaaaaaa"\nlet a = process.env.STRIPE_SECRET_KEY\nlet b = process.env.HOME\nsession_access_token = "aaaaaaaaaaaaaaaaaaaa"\n'
fixture("x9_secrets", {"a.js": KEYS, "vendor/a.js": KEYS}, secrets.detect_keys, "key_name key_type provider value_preview line_number", [("apiKey", "hardcoded", "generic", "sk1234567890abcdefgh...", 1), ("X_API_KEY", "env_var", "generic", None, 3), ("secret_key", "hardcoded", "generic", "aaaaaaaaaaaaaaaaaaaa", 4), ("STRIPE_SECRET_KEY", "env_var", "stripe", None, 5)])
VALUES = [("abcdefghij1234567890", True), ("short", False), ("${apiKey}aaaaaaaaaaaaaaaaa", False), ("https://example.org/aaaaaaaaaa", False), ("a b c d e f g h i j k l m n", False), ("sk_live a1234567890123456789", True), ("config.apiKeyaaaaaaaaaaaaaaa", False), ("!!!!!!!!!!aaaaaaaaaaaaaaaaaa", False), ('"abcdefghij1234567890"', True), ("a.b", False)]
FIXTURES["x10_filter"] = (lambda spark: spark.createDataFrame([(v,) for v, _ in VALUES], "value string").select("value", secrets.looks_like_key(F.col("value")).alias("ok")), values("value ok", VALUES))

PY = "import stripe\ndef pay():\n    key = STRIPE_KEY\n    return stripe.charge()\n"


def _related(f: DataFrame, kind: str) -> DataFrame:
    spark = f.sparkSession
    e = code.code_elements(f).where("element_type = 'function'")
    if kind == "service":
        s = spark.createDataFrame([("s1", "r", "Stripe", "stripe", {"env_var": "STRIPE_KEY"}), ("s2", "r", "Twilio", "twilio", {})], "id string, repository_id string, name string, provider string, configuration map<string,string>")
        return relate.service_relationships(e, f, s)
    d = spark.createDataFrame([("d1", "r", "stripe"), ("d2", "r", "@scope/stripe"), ("d3", "r", "lodash")], "id string, repository_id string, name string")
    return relate.dependency_relationships(e, f, d)


fixture("j4_service_score", {"a.py": PY}, lambda f: _related(f, "service"), "target_id relationship_type confidence evidence", [("s1", "uses", 1.0, "Service name 'Stripe' found in code; Provider 'stripe' found in code; SDK pattern 'stripe' detected; Environment variable 'STRIPE_KEY' used")])
fixture("j5_dependency_score", {"a.py": PY}, lambda f: _related(f, "dependency"), "target_id relationship_type confidence evidence", [("d1", "imports", 1.0, "Import statement found: import stripe; Package 'stripe' used in code"), ("d2", "imports", 0.3, "Scoped package part 'stripe' found")])
ASKED = [("What functions are available?", "find_functions", ""), ("rename the test files", "refactoring_impact", "file"), ("which tests cover auth", "find_tests", "auth"), ("show me the docs for the api", "find_documentation", "api"), ("hello there", "unknown", ""), ("list all services for payment", "list_services", "payment")]
FIXTURES["g13_intents"] = (lambda spark: spark.createDataFrame([(t,) for t, _, _ in ASKED], "text string").select("text", Q.parse_column(F.col("text"))[0].alias("intent"), F.array_join(Q.parse_column(F.col("text"))[1], ",").alias("topics")), values("text intent topics", ASKED))
FIXTURES["s2_repository_names"] = (
    lambda spark: spark.createDataFrame([("https://github.com/a/b.git",), ("git@github.com:a/c.git",), ("/data/repos/d/",), ("https://x.org/e",)], "url string").select("url", _name(F.col("url")).alias("name"), _local(F.col("url")).alias("is_local")),
    values("url name is_local", [("https://github.com/a/b.git", "b", False), ("git@github.com:a/c.git", "c", False), ("/data/repos/d/", "d", True), ("https://x.org/e", "e", False)]),
)


def _name(c: Column) -> Column:
    from tallgrass.functions.text import repository_name

    return repository_name(c)


def _local(c: Column) -> Column:
    from tallgrass.functions.text import is_local_path

    return is_local_path(c)


fixture("s4_file_index", {"a/b.PY": "x", "Dockerfile": "x", "m.tf": "x", "r.md": "x", "q.bin": "x", "s.css": "x"}, corpus.indexed, "path file_type language size", [("a/b.PY", "code", "python", 1), ("Dockerfile", "config", "unknown", 1), ("m.tf", "infrastructure", "unknown", 1), ("r.md", "documentation", "markdown", 1), ("q.bin", "other", "unknown", 1), ("s.css", "web", "css", 1)], size="BIGINT")
fixture("k_skip_rules", {"a.js": "x", "node_modules/a.js": "x", "target/a.rs": "x", ".hidden": "x", ".env": "x", "venv/x.py": "x", "a.min.js": "x", "api/.config": "x", "vendor/y.py": "x"}, lambda f: f.select("path", corpus.skipped().alias("general"), corpus.skipped_by_services().alias("services"), corpus.skipped_by_ports().alias("ports"), corpus.skipped_by_secrets().alias("secrets")), "path general services ports secrets", [("a.js", False, False, False, False), ("node_modules/a.js", True, True, True, True), ("target/a.rs", True, True, True, True), (".hidden", True, True, True, True), (".env", True, True, False, True), ("venv/x.py", False, True, True, True), ("a.min.js", True, True, False, True), ("api/.config", True, True, False, True), ("vendor/y.py", False, False, False, True)])


def _parsed(f: DataFrame) -> DataFrame:
    from tallgrass.sources.parsers import parsed_files

    return parsed_files(f).withColumns(joined("resources"))


fixture("s8_parsers", {"main.tf": 'resource "aws_s3_bucket" "b" {}\n', "cloudformation.yml": "AWSTemplateFormatVersion: x\nResources:\n  Fn:\n    Type: T\n  Bucket:\n    Type: U\nOutputs:\n  O:\n", ".github/workflows/ci.yml": "on: push\n", "a.toml": "x=1\n", "README": "x", "a.kt": "x", "b.bin": "x"}, _parsed, "path kind format platform provider resources", [("main.tf", "infrastructure", None, None, "aws", "aws_s3_bucket"), ("cloudformation.yml", "infrastructure", None, None, "aws", "Fn|Bucket"), (".github/workflows/ci.yml", "ci_cd", None, "github", None, ""), ("a.toml", "config", "toml", None, None, ""), ("README", "documentation", None, None, None, ""), ("a.kt", "code", None, None, None, ""), ("b.bin", "other", None, None, None, "")])
