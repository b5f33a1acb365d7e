"""Analysis from files to graph, details, writing, run and job states, against rows spelled out or worked out plainly."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import analysis, details, graph, joins, relate, security, sinks, versions
from tallgrass.plans.fixtures import PACKAGE
from tallgrass.sources import corpus
from tallgrass.streaming import live, stateful

FILES = {
    "package.json": PACKAGE,
    "src/server.js": "import express from \"express\"\nimport Stripe from 'stripe';\nfunction start() {\n  app.listen(3000)\n}\napp.get('/users/:id', start)\nconst apiKey = \"sk_live_abcdefghijklmnop1234567890\"\n",
    "tests/server.test.js": "describe('server', () => {\n  it('starts', () => {})\n})\n",
    "README.md": "# Demo\n\nAn API.\n",
    "main.tf": 'resource "aws_s3_bucket" "logs" {\n  acl = "public-read"\n}\n',
}


def corpus_of(spark, repositories):
    rows = [(r, p, c) for r, files in repositories.items() for p, c in files.items()]
    return corpus.prepared(spark.createDataFrame(rows, corpus.SCHEMA))


def test_from_files_to_graph(spark, tmp_path):
    repos = spark.createDataFrame([("one", "One", "u1"), ("two", "Two", "u2")], "id string, name string, url string")
    root = str(tmp_path)
    t = analysis.analyse(corpus_of(spark, {"one": FILES, "two": {"go.mod": "module m\nrequire github.com/one/x v1.0.0\n"}}), repos, root=root)
    n = {(r.measure, r.value): r.n for r in t["summary"].collect()}
    assert n["dependencies", "total"] == 7 and n["dependencies.package_manager", "go"] == 1 and n["ports", "total"] == 1 and n["tests", "total"] >= 1
    assert {r.name for r in t["code_elements"].collect()} >= {"start"}
    assert {(r.path, r.method) for r in t["endpoints"].collect()} == {("/users/:id", "GET")}
    assert {r.provider for r in t["services"].collect()} >= {"Stripe"} and {r.entity_type for r in t["security_entities"].collect()} >= {"s3_bucket", "api_key"}
    assert t["vulnerabilities"].where("vulnerability_type = 'HardcodedApiKey'").count() == 1
    ids = {(r.id, r.repository_id) for r in t["nodes"].collect()}
    edges = t["edges"].collect()
    assert edges and all((e.source_node_id, e.repository_id) in ids and (e.target_node_id, e.repository_id) in ids for e in edges)
    assert {"uses_package_manager", "uses_service", "has_port", "has_endpoint", "endpoint_uses_port"} <= {e.edge_type for e in edges}
    first = versions.snapshot(spark, root)
    assert first.table("dependencies", "one").count() == 6 and first.table("edges").count() == len(edges)
    # a later run without dependencies empties its own rows and leaves the others'
    analysis.analyse(corpus_of(spark, {"one": {"a.py": "def f():\n    pass\n"}}), repos.where("id = 'one'"), root=root)
    second = versions.snapshot(spark, root)
    assert {r.repository_id for r in second.table("dependencies").collect()} == {"two"}
    assert {r.name for r in second.table("code_elements", "one").collect()} == {"f"}
    assert first.table("dependencies", "one").count() == 6  # a snapshot stays as it is


def test_an_empty_set_replaces_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "repository_id string, x int")
    sinks.replace_rows(df, path)
    sinks.replace_rows(df.limit(0), path, ["a"])
    assert [(r.repository_id, r.x) for r in spark.read.parquet(path).collect()] == [("b", 2)]


def test_repositories_are_created_once_and_touched(spark, tmp_path):
    root, schema = str(tmp_path), "repository_id string, name string, last_analyzed_at string, auth_value string"
    sinks.create_repositories(spark.createDataFrame([("a", "A", None, "s"), ("b", "B", None, "s")], schema), root)
    sinks.create_repositories(spark.createDataFrame([("a", "other", None, "s"), ("c", "C", None, "s")], schema), root)
    assert sinks.touch_repository(spark, root, "b", last_analyzed_at="now") and not sinks.touch_repository(spark, root, "none", name="x")
    got = sinks.load_table(spark, root, "repositories")
    assert {(r.repository_id, r.name, r.last_analyzed_at) for r in got.collect()} == {("a", "A", None), ("b", "B", "now"), ("c", "C", None)} and "auth_value" not in got.columns


def test_names_held_by_brute_force(spark):
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("aBé.") for _ in range(rng.randint(0, 6)))
    tools = [(rng.choice("xy"), k, name()) for k in range(60)]
    deps = [(rng.choice("xy"), name()) for _ in range(60)]
    got = joins.tool_dependencies(spark.createDataFrame(tools, "repository_id string, id int, name string"), spark.createDataFrame(deps, "repository_id string, name string")).collect()
    want = {(r, k, d) for r, k, n in tools for q, d in deps if r == q and n and d and (n.lower() in d.lower() or d.lower() in n.lower())}
    assert sorted(map(tuple, got)) == sorted(want)


def test_relations_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["stripe", "mystripe", "left-pad", "@scope/pkg", "pkg", "ab", "x", "import left-pad", "from 'pkg'", "require('ab')", "use x", "client", "é"]
    files = {f"f{k}.js": "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 400))) for k in range(6)}
    prepared = corpus_of(spark, {"r": files})
    elements = [("r", f"e{k}", f"f{k % 6}.js", rng.randint(1, 420)) for k in range(40)]
    deps = [("r", f"d{k}", n) for k, n in enumerate(["left-pad", "@scope/pkg", "pkg", "ab", "x", "none", "LEFT-PAD"])]
    e = spark.createDataFrame(elements, "repository_id string, id string, file_path string, line_number int")
    got = {(r.code_element_id, r.target_id): r.confidence for r in relate.dependency_relationships(e, prepared, spark.createDataFrame(deps, "repository_id string, id string, name string")).collect()}
    import re

    def bounded(text, w):
        return bool(w) and re.search(rf"(?<![\w]){re.escape(w)}(?![\w])", text) is not None

    want = {}
    for _, i, f, line in elements:
        text = files[f].lower()
        lines = files[f].lower().split("\n")
        begin = max(line - relate.BEFORE, 1)
        body = "\n".join(lines[begin - 1 : line + relate.AFTER - 1])
        for _, d, name in deps:
            low = name.lower()
            score = 0.6 * any(s in text for s in (f"import {low}", f"from '{low}", f'from "{low}"', f"require('{low}", f'require("{low}"', f"use {low}", f"extern crate {low}"))
            score += 0.4 * bounded(body, low) + sum(0.3 for p in low.split("/") if "/" in low and bounded(body, p))
            if score > 0.29:
                want[i, d] = min(1.0, round(score, 2))
    assert got == pytest.approx(want)


def test_relations_of_a_thousand_elements_in_a_file(spark):
    import re

    rng = random.Random(9)
    vocabulary = ["Stripe", "mystripe", "stripe.js", "api.x.io/v1", "AWS S3", "aws-sdk", "@aws-sdk/", "S3_KEY", "clerk", "é", "plain", "words"]
    lines = [" ".join(rng.choices(vocabulary, range(1, 13), k=rng.randint(0, 3))) if rng.random() < 0.02 else "plain words" for _ in range(1300)]
    prepared = corpus_of(spark, {"r": {"f.js": "\n".join(lines) + "\n", "g.js": "stripe"}, "q": {"f.js": "Stripe\n" * 400}})
    elements = [("r", f"e{k}", "f.js", k + 1) for k in range(1000)] + [("r", "odd", "f.js", None), ("r", "far", "f.js", 5000), ("r", "g", "g.js", 1), ("r", "h", "none.js", 1), ("q", "z", "f.js", 7)]
    services = [("r", "s1", "Stripe", "stripe", {"url": "API.x.io/v1"}), ("r", "s2", "AWS S3", "aws", {"env_var": "S3_KEY"}), ("r", "s3", "x", "Clerk", {}), ("r", "s4", "", "", {"url": ""}), ("r", "s5", "Stripe", "stripe", None), ("q", "s6", "Stripe", "stripe", None)]
    e = spark.createDataFrame(elements, "repository_id string, id string, file_path string, line_number int")
    s = spark.createDataFrame(services, "repository_id string, id string, name string, provider string, configuration map<string,string>")
    out = relate.service_relationships(e, prepared, s).collect()
    got = {(r.code_element_id, r.target_id): r.confidence for r in out}
    texts = {("r", "f.js"): lines, ("r", "g.js"): ["stripe"], ("q", "f.js"): ["Stripe"] * 400}
    want = {}
    for repo, i, f, line in elements:
        if line is None or (repo, f) not in texts:
            continue
        begin = max(line - relate.BEFORE, 1)
        body = "\n".join(texts[repo, f][begin - 1 : line + relate.AFTER - 1]).lower()
        for other, d, name, provider, config in services:
            held = lambda p: bool(p) and p.lower() in body  # noqa: B023, E731
            sdk = relate.SDK_WORDS.get(provider.lower(), (name.lower(),))
            score = 0.3 * held(name) + 0.2 * held(provider) + 0.5 * held((config or {}).get("url")) + 0.3 * held((config or {}).get("env_var"))
            score += 0.4 * sum(bool(w) and re.search(rf"(?<![\w]){re.escape(w)}(?![\w])", body) is not None for w in sdk)
            if other == repo and score > 0.29:
                want[i, d] = min(1.0, round(score, 2))
    assert len(out) == len(got) and len(got) > 1000 and got == pytest.approx(want)


def test_details_of_unknown_kinds_and_entities(spark):
    deps = spark.createDataFrame([("a", "r", "npm"), ("b", "r", "npm"), ("c", "q", "npm")], "id string, repository_id string, package_manager string")
    with pytest.raises(ValueError):
        details.details("planet", {"dependencies": deps})
    assert [tuple(r) for r in details.entity_details("dependency", {"dependencies": deps}, "a").collect()] == [("a", "related_dependencies", "b", None)]
    assert details.entity_details("dependency", {"dependencies": deps}, "none").count() == 0


def test_service_keys_stay_in_their_repository(spark):
    s = spark.createDataFrame([(1, "r", "s3", "aws"), (2, "q", "pay", "stripe")], "id int, repository_id string, name string, provider string")
    k = spark.createDataFrame([(10 + i, "r", "aws", []) for i in range(30)] + [(50, "q", "aws", ["pay", "pay"]), (51, "q", None, [])], "id int, repository_id string, provider string, related_services array<string>")
    got = {(r.service_id, r.key_id) for r in joins.service_keys(s, k).collect()}
    assert got == {(1, 10 + i) for i in range(20)} | {(2, 50)}


def test_edges_end_at_services_that_are_there(spark):
    t = {
        "repositories": spark.createDataFrame([("r", "R")], "id string, name string"),
        "services": spark.createDataFrame([("s1", "r", "S", "p", "api", 0.5)], "id string, repository_id string, name string, provider string, service_type string, confidence double"),
        "code_elements": spark.createDataFrame([("e", "r", "f", "function", "a.py", 1, "python")], "id string, repository_id string, name string, element_type string, file_path string, line_number int, language string"),
        "code_relationships": spark.createDataFrame([("r", "e", "service", "s1", 0.5, "x"), ("r", "e", "service", "gone", 0.5, "x"), ("r", "nobody", "service", "s1", 0.5, "x")], "repository_id string, code_element_id string, target_type string, target_id string, confidence double, evidence string"),
    }
    nodes, edges = graph.build_graph(t)
    ids = {r.id for r in nodes.collect()}
    rows = edges.collect()
    assert all(e.source_node_id in ids and e.target_node_id in ids for e in rows) and sum(e.edge_type == "code_uses_service" for e in rows) == 1


def test_block_scalars_of_yaml():
    text = "Resources:\n  A:\n    Type: X\n    Code: |\n      if a:\n          b: 1\n        c\n\n      - d\n  B:\n    Type: !Sub Y\n    List:\n      - >-\n        folded\n        text\n      - Name: n\n        Body: !Sub |\n          k: v\n        After: z\n"
    doc = security.parse_yaml(text)
    assert doc["Resources"]["A"] == {"Type": "X", "Code": "if a:\n    b: 1\n  c\n\n- d\n"}
    b = doc["Resources"]["B"]
    assert b["Type"] == "Y" and b["List"][0].split() == ["folded", "text"] and b["List"][1] == {"Name": "n", "Body": "k: v\n", "After": "z"}


def test_run_states(spark):
    t = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    events = [
        ("a", 1, "start", 0, 10, "begin", "s", t(0)), ("a", 2, "update", 4, None, "four", "m4", t(1)), ("a", 3, "message", None, None, None, "note", t(2)),
        ("b", 1, "start", 0, 10, "begin", "s", t(0)), ("b", 2, "complete", None, None, None, "done", t(1)),
        ("c", 1, "start", 0, 10, "begin", "s", t(0)), ("c", 2, "update", 5, None, "five", "m", t(1)), ("c", 3, "fail", None, None, None, "broke", t(2)),
        ("d", 1, "start", 0, 10, "begin", "s", t(0)), ("d", 2, "clear", None, None, None, None, t(1)), ("d", 3, "update", 3, None, "late", "m", t(2)),
        ("e", 1, "update", 3, None, "never began", "m", t(0)),
        ("f", 1, "start", 0, 10, "begin", "s", t(0)), ("f", 2, "complete", None, None, None, "done", t(1)), ("f", 3, "start", 0, 20, "again", "s2", t(2)),
    ]
    got = {r.repository_id: (r.current_step, r.total_steps, r.progress_percent, r.status, r.status_message, r.step_name) for r in live.progress_state(spark.createDataFrame(events, live.EVENTS)).collect()}
    assert got == {"a": (4, 10, 40.0, "running", "note", "four"), "b": (10, 10, 100.0, "complete", "done", "Complete"), "c": (5, 10, 50.0, "failed", "broke", "Failed"), "f": (0, 20, 0.0, "running", "s2", "again")}


def test_job_states(spark):
    rows = [("a", 1, "pending"), ("a", 2, "running"), ("a", 3, "completed"), ("a", 4, "running"), ("b", 1, "pending"), ("b", 2, "completed"), ("c", 2, "running"), ("d", 1, "pending"), ("d", 2, "cancelled"), ("d", 3, "running")]
    assert {r.job_id: r.status for r in live.job_states(spark.createDataFrame(rows, "job_id string, seq int, status string")).collect()} == {"a": "completed", "b": "pending", "d": "cancelled"}


def test_rocket_label(spark):
    from tallgrass.operators import ports

    files = corpus_of(spark, {"r": {"main.rs": 'rocket::build().bind(x, "0.0.0.0:8000")\nServer::bind(y, z).bind(&"0.0.0.0:3000")\nHttpServer.bind("127.0.0.1:8080")\n'}})
    assert {r.port: r.framework for r in ports.detect_ports(files).collect()} == {8000: "rocket", 3000: "axum", 8080: "actix"}


def test_catalog_orders(spark):
    from tallgrass.operators import catalog

    repos = spark.createDataFrame([(i, f"n{i}", "u", "main", (i * 7) % 5, "s") for i in range(12)], "id int, name string, url string, branch string, created_at int, auth_value string")
    newest = [r.id for r in catalog.repositories(repos).collect()]
    assert [(-(i * 7 % 5)) for i in newest] == sorted(-(i * 7 % 5) for i in newest)
    assert [r.id for r in catalog.dashboard(repos).collect()] == sorted(range(12), key=lambda i: (-(i * 7 % 5), i))[:10]
    p = spark.createDataFrame([(i, "r", (i * 37) % 11 + 2000, "web", "f", i, None) for i in range(20)], "id int, repository_id string, port int, port_type string, file_path string, line_number int, framework string")
    assert [(r.port, r.id) for r in catalog.ports(p).collect()] == sorted(((i * 37) % 11 + 2000, i) for i in range(20))
    v = spark.createDataFrame([(i, "r", s) for i, s in enumerate(["Low", "Critical", "Info", "High", "Medium", "Critical"])], "id int, repository_id string, severity string")
    assert [r.id for r in catalog.vulnerabilities(v).collect()] == [1, 5, 3, 4, 0, 2]
    tests = spark.createDataFrame([(i, "r", "pytest", f"f{i % 3}", (i * 5) % 7) for i in range(15)], "id int, repository_id string, test_framework string, file_path string, line_number int")
    assert [(r.file_path, r.line_number, r.id) for r in catalog.tests(tests).collect()] == sorted((f"f{i % 3}", (i * 5) % 7, i) for i in range(15))


def test_skip_rules_one_by_one(spark):
    long = "x" * 300
    rows = {
        "src/a.py": "a\n", ".hidden.py": "a\n", ".env.local": "A=1\n", "node_modules/a.js": "a\n", "venv/lib/a.py": "a\n", "vendor/a.py": "a\n", "build/a.js": "a\n", "docs/big.txt": "y" * ((1 << 20) + 1),
        "README.md": "# x\n", "README": "x\n", "docs/.x.md": "x\n", "long.js": f"{long}\n{long}\n", "few.js": "ab cd " * 200, "dense.js": "abcdefghij\n" * 120 + "k" * 4, "packed.js": ("!function(" + "a" * 60 + "(function\n") * 3,
        "mapped.js": "a = 1;\n" * 30 + "//# sourceMappingURL=a.map\n", "app.bundle.x": "a = 1;\n" * 30 + "__webpack_require__\n", "short.js": "x" * 99,
    }
    files = corpus_of(spark, {"r": rows})
    named = lambda c: {r.path for r in files.where(c).collect()}
    assert named(corpus.skipped_by_security()) >= {".hidden.py", "node_modules/a.js", "venv/lib/a.py"} and ".env.local" not in named(corpus.skipped_by_security())
    assert {"vendor/a.py", "docs/big.txt"} <= named(corpus.skipped_by_secrets()) and "src/a.py" not in named(corpus.skipped_by_secrets())
    assert named(corpus.documented()) == {"README.md", "README", "docs/big.txt"}
    assert named(corpus.minified()) == {"long.js", "few.js", "mapped.js", "app.bundle.x", "docs/big.txt"} | ({"packed.js"} & named(corpus.minified())) | ({"dense.js"} & named(corpus.minified()))
    assert "short.js" not in named(corpus.minified()) and {"long.js", "mapped.js", "docs/big.txt"} <= named(corpus.minified_document())
    assert {r.path for r in files.where(corpus.build_artifact(F.col("path"))).collect()} == {"node_modules/a.js", "build/a.js"}


def test_unknown_types_and_tests_in_the_graph(spark):
    df = spark.createDataFrame([("service",), ("odd",)], "t string").select(graph.known_type(F.col("t"), graph.NODE_TYPES, "code_element").alias("k"))
    assert {r.k for r in df.collect()} == {"service", "code_element"}
    t = {"repositories": spark.createDataFrame([("r", "R")], "id string, name string"), "tests": spark.createDataFrame([("t1", "r", "a", "jest", "f", 1), ("t2", "r", "b", "jest", "f", 2)], "id string, repository_id string, name string, test_framework string, file_path string, line_number int")}
    nodes, edges = graph.build_graph(t)
    assert {r.node_type: r["count"] for r in nodes.groupBy("node_type").count().collect()} == {"repository": 1, "test": 2, "test_framework": 1}
    assert {r.edge_type: r["count"] for r in edges.groupBy("edge_type").count().collect()} == {"has_test": 2, "test_uses_framework": 2}


def test_configs_and_page_routes(spark):
    from tallgrass.operators import endpoints, services

    files = corpus_of(spark, {"r": {"iam-policy.json": '{"a": 1}', "security.yaml": "a: 1\n", "auth-config.conf": "x" * 500, "pages/api/users/[id].js": "export default function handler(req, res) {}\n", "app.env": "A=1\n"}})
    got = {r.file_path: r.configuration for r in security.security_configs(files).collect()}
    assert set(got) == {"iam-policy.json", "security.yaml", "auth-config.conf"} and got["iam-policy.json"]["config_type"] == "json" and got["security.yaml"]["config_type"] == "yaml" and "content" not in got["auth-config.conf"]
    assert {(r.path, r.method, r.framework) for r in endpoints.detect_endpoints(files).collect()} == {("/api/users/[id]", "ANY", "nextjs")}
    names = [("main.tf", "infrastructure"), ("cloudformation.json", "infrastructure"), ("app.yml", "config"), ("config.py", "config"), ("a.py", "code"), ("a.bin", None)]
    df = spark.createDataFrame([(n,) for n, _ in names], "n string").withColumn("c", services.file_class(F.col("n")))
    assert {r.n: r.c for r in df.collect()} == dict(names)


def plain_job(events):
    now = None
    for _, status in sorted(events):
        if now is None and status == "pending" or status in live.TRANSITIONS.get(now, ()):
            now = status
    return now


def shuffled_files(spark, df, rows, n, path, seed):
    """rows in n files, in no order and some twice; each file comes as a batch."""
    rng = random.Random(seed)
    dealt = [[] for _ in range(n)]
    for r in rows:
        for k in rng.sample(range(n), min(n, 1 + (rng.random() < 0.2))):
            dealt[k].append(r)
    for k, part in enumerate(dealt):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_job_states_by_stream_and_batch(spark, tmp_path):
    rng, begun = random.Random(3), datetime.datetime(2026, 1, 1)
    rows = [(f"j{rng.randint(0, 30)}", k, rng.choice(["pending", "running", "running", "completed", "failed", "cancelled", "odd"]), begun + datetime.timedelta(seconds=20 * k)) for k in range(300)]
    df = spark.createDataFrame(rows, "job_id string, seq int, status string, at timestamp")
    want = {j: s for j in {r[0] for r in rows} if (s := plain_job({(r[1], r[2]) for r in rows if r[0] == j}))}
    assert {r.job_id: r.status for r in live.job_states(df.union(df)).collect()} == want
    stream = stateful.job_stream(shuffled_files(spark, df, rows, 4, str(tmp_path / "in"), 5), "2 hours")
    assert {r.job_id: r.status for r in stateful.last_said(stream, str(tmp_path / "out"), str(tmp_path / "ck")).collect()} == want


def test_jobs_in_order_of_time_give_up_their_events(spark, tmp_path):
    begun = datetime.datetime(2026, 1, 1)
    steps = ["pending", "running", "pending", "completed", "running"]
    rows = [("j", k, s, begun + datetime.timedelta(hours=k)) for k, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "job_id string, seq int, status string, at timestamp")
    for k, r in enumerate(rows):
        spark.createDataFrame([r], df.schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = stateful.last_said(stateful.job_stream(stream, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [(r.job_id, r.status, r.seq) for r in out.collect()] == [("j", "completed", 3)]


def test_expiry_by_stream_and_batch(spark, tmp_path):
    rng, begun = random.Random(4), datetime.datetime(2026, 1, 1)
    rows = [(f"r{rng.randint(0, 40)}", k, rng.choice(["running", "complete", "failed"]), begun + datetime.timedelta(milliseconds=rng.randint(0, 3 * 3_600_000))) for k in range(250)]
    rows += [("edge", 900, "complete", max(r[3] for r in rows) - datetime.timedelta(seconds=3600)), ("over", 901, "complete", max(r[3] for r in rows) - datetime.timedelta(seconds=3601))]
    df = spark.createDataFrame(rows, "repository_id string, event_id long, status string, last_updated timestamp")
    now = max(r[3] for r in rows)
    want = {(r.repository_id, r.event_id) for r in live.expired(df, F.lit(now), 3600).collect()}
    assert ("over", 901) in want and ("edge", 900) not in want and len(want) > 5
    for late, files in ((3600, 1), (3600, 4)):
        # all may come late by an hour: the first file holds the last event, the others what is at most an hour older, then the rest on time
        part = rows if files == 1 else [r for r in rows if r[3] >= now - datetime.timedelta(seconds=3600)]
        early = [r for r in rows if r not in part]
        path = tmp_path / f"in{files}"
        if early:
            spark.createDataFrame(early, df.schema).coalesce(1).write.parquet(str(path / "a"))
            import time

            time.sleep(1.1)  # files come by their time
        stream = shuffled_files(spark, df, part, files, str(path), 6)
        got = stateful.last_said(stateful.expiry_stream(stream, 3600, late), str(tmp_path / f"out{files}"), str(tmp_path / f"ck{files}"))
        assert {(r.repository_id, r.event_id) for r in got.where("expired").collect()} == want
    with pytest.raises(ValueError):
        stateful.expiry_stream(df, 10, 20)


def test_partitions_of_odd_ids(spark, tmp_path):
    ids = ["a:b", "x=y", "p/q", "..", "z/../../precious", " ", "é", "100%", "07", "ok"]
    root, path = str(tmp_path / "catalog"), str(tmp_path / "catalog" / "t")
    (tmp_path / "precious").mkdir()
    df = spark.createDataFrame([(x, 1) for x in [*ids, None]], "repository_id string, n int")
    sinks.replace_rows(df, path)
    sinks.replace_rows(df.limit(0), path, ids[:3])
    names = lambda: sorted(str(r.repository_id) for r in spark.read.option("basePath", path).schema(df.schema).parquet(path).collect())
    assert names() == sorted(map(str, [*ids[3:], None]))
    assert [sinks.delete_repository(spark, root, ["t"], x) for x in ("z/../../precious", "..", "a:b", None)] == [1, 1, 0, 1]
    assert names() == sorted(ids[5:]) and (tmp_path / "precious").is_dir()


def _graph(spark, rows, edges):
    nodes = spark.createDataFrame(rows, "id string, repository_id string, auth_value string")
    return {"nodes": nodes, "edges": spark.createDataFrame(edges, "repository_id string, source_node_id string, target_node_id string")}


def test_versions_of_the_catalog(spark, tmp_path):
    root = str(tmp_path)
    seen = lambda v=None: {n: sorted(tuple(r) for r in versions.snapshot(spark, root, v).table(n).select(*c).collect()) for n, c in (("nodes", ["id", "repository_id"]), ("edges", ["source_node_id", "target_node_id"]))}
    odd = "../a:b=c/%2F"
    assert versions.snapshot(spark, root).version == 0 and versions.snapshot(spark, root).tables() == []
    assert versions.commit(spark, root, _graph(spark, [("a1", "a", "s"), ("a2", "a", "s"), ("b1", odd, "s")], [("a", "a1", "a2"), (odd, "b1", "a1"), ("a", "a2", "b1"), ("a", "a1", "gone")]), ["a", odd]) == 1
    first = {"nodes": [("a1", "a"), ("a2", "a"), ("b1", odd)], "edges": [("a1", "a2"), ("a2", "b1"), ("b1", "a1")]}
    assert seen() == first and "auth_value" not in versions.snapshot(spark, root).table("nodes").columns
    # replaced: the edges of other repositories that end there go by either end; rows of repositories that aren't named don't count
    assert versions.commit(spark, root, _graph(spark, [("a1", "a", ""), ("n", "other", "")], [("a", "a1", "a1"), ("a", "a1", "b1")]), ["a"]) == 2
    second = {"nodes": [("a1", "a"), ("b1", odd)], "edges": [("a1", "a1"), ("a1", "b1")]}
    assert seen() == second and seen(1) == first
    # a run that dies on its way leaves what was there
    fails = F.udf(lambda x: 1 / 0, "string")
    tables = _graph(spark, [("x", "a", "")], [("a", "x", "x")])
    with pytest.raises(Exception, match="division"):
        versions.commit(spark, root, {"nodes": tables["nodes"], "edges": tables["edges"], "tests": tables["nodes"].withColumn("bad", fails("id"))}, ["a"])
    assert seen() == second and versions.snapshot(spark, root).version == 2
    # of two runs from one version the second may not overwrite the first
    base = versions.snapshot(spark, root)
    assert versions.commit(spark, root, _graph(spark, [("c1", "c", "")], [("c", "c1", "b1")]), ["c"], base) == 3
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, _graph(spark, [("d1", "d", "")], [("d", "d1", "c1")]), ["d"], base)
    third = {"nodes": [("a1", "a"), ("b1", odd), ("c1", "c")], "edges": [("a1", "a1"), ("a1", "b1"), ("c1", "b1")]}
    assert seen() == third
    assert versions.compact(spark, root) == 4 and seen() == third and seen(2) == second
    assert versions.vacuum(spark, root, keep=1, idle_seconds=3600) == 0 and versions.vacuum(spark, root, keep=1, idle_seconds=0) > 3
    assert seen() == third and [int(n) for n in versions.Files(spark, root).names("versions")] == [4] and len(versions.Files(spark, root).names("runs")) == 1
    assert versions.delete(spark, root, [odd, "never"]) == 5
    assert seen() == {"nodes": [("a1", "a"), ("c1", "c")], "edges": [("a1", "a1")]}
    with pytest.raises(KeyError):
        versions.snapshot(spark, root).table("ports")
    with pytest.raises(KeyError):
        versions.snapshot(spark, root, 1)


def test_long_files_do_not_overflow_the_matcher(spark):
    from tallgrass.operators.endpoints import JAVA_HANDLER
    from tallgrass.sources.parsers import parsed_files

    keys = "".join(f"  Part{i}:\n    Type: T\n\n" for i in range(20_000))
    df = corpus_of(spark, {"r": {"cloudformation.yml": f"AWSTemplateFormatVersion: x\nResources:\n{keys}Outputs:\n  O:\n    Value: v\n", "template.yaml": "AWSTemplateFormatVersion: x\nResources:\nOutputs:\n  O:\n"}})
    got = {r.path: r.resources for r in parsed_files(df).collect()}
    assert got == {"cloudformation.yml": [f"Part{i}" for i in range(20_000)], "template.yaml": []}
    lines = spark.createDataFrame([("@A " * 100_000 + "public void get(int a) {",), ("@Override @Deprecated public String name() {",)], "t string")
    assert [r.h for r in lines.selectExpr(f"regexp_extract(t, r'{JAVA_HANDLER}', 1) as h").collect()] == ["get", "name"]
