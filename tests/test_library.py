"""Operators that no query covers: sinks, rules, plugins, streams, reports, and properties of graphs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallgrass.functions.text import lines, word_bounded
from tallgrass.operators import aggregates, ask, catalog, code, endpoints, graph, joins, manifests, packages, ports, report, rule_scan, security, services, sinks
from tallgrass.plans.fixtures import PACKAGE, files_of
from tallgrass.sources import corpus, plugins, rules
from tallgrass.streaming import live


def test_lines(spark):
    texts = [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n", ["a", "b"]), ("\n", [""]), ("a\n\n", ["a", ""]), ("a\rb", ["a\rb"])]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string").select("t", lines(F.col("t")).alias("l"))
    assert {r.t: r.l for r in df.collect()} == dict(texts)


def test_word_bounds_in_characters(spark):
    df = spark.createDataFrame([("turbopack together", "together"), ("é_together", "together"), ("étogether", "together"), ("a.b", "a.b"), ("axb", "a.b"), ("together", "together")], "t string, w string")
    assert [r.x for r in df.select(word_bounded(F.col("t"), F.col("w")).alias("x")).collect()] == [True, False, False, True, False, True]


def test_a_repository_is_read_from_a_folder(spark, tmp_path):
    (tmp_path / "target").mkdir()
    root = tmp_path / "target" / "repo"  # a parent's name doesn't count
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.py").write_text("def f(x):\n    pass\n")
    (root / "bad.py").write_bytes(b"\xff\xfe\xff")
    (root / "package.json").write_text(PACKAGE)
    files = corpus.read_repository(spark, str(root), "r")
    assert sorted(r.path for r in files.collect()) == ["package.json", "src/a.py"]
    assert [r.name for r in code.code_elements(files).collect()] == ["f"]
    assert manifests.dependencies(files).count() == 6


def test_replace_keeps_other_repositories(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "repository_id string, x int")
    sinks.replace_rows(df, path)
    sinks.replace_rows(spark.createDataFrame([("a", 7)], df.schema), path)
    assert sorted((r.repository_id, r.x) for r in spark.read.parquet(path).collect()) == [("a", 7), ("b", 2)]
    sinks.save_catalog({"u": df.withColumn("auth_value", F.lit("s"))}, str(tmp_path))
    assert "auth_value" not in sinks.load_table(spark, str(tmp_path), "u").columns
    assert sinks.load_table(spark, str(tmp_path), "u", "b").count() == 1
    assert sinks.delete_repository(spark, str(tmp_path), ["t", "u", "none"], "a") == 2
    assert sinks.as_json(df).orderBy("json").first().json == '{"repository_id":"a","x":1}'


def test_rule_files_are_merged(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"patterns": {"environment_variables": [{"pattern": "MINE", "provider": "Own", "service_type": "Other", "confidence": 0.6}], "aws_sdk_v3_service_map": {"s3": "Buckets"}}}')
    (tmp_path / "bad.json").write_text("no json")
    merged, bad = rules.read_rules(spark, str(tmp_path / "p.json"), str(tmp_path / "bad.json"))
    assert bad == [str(tmp_path / "bad.json")] and merged.env[-1] == rules.Rule("MINE", "Own", "Other", 0.6) and merged.aws_names["s3"] == "Buckets"
    found = services.detect_services(files_of(spark, {"app.config": "MINE_KEY=1\n"}), None, merged)
    assert [(r.name, r.provider) for r in found.collect()] == [("MINE Service", "Own")]


def plain_hits(rules_, kind, low_name, content, language):
    """What each rule says of a file, one rule after the other."""
    import re

    low, lines, out = content.lower(), (content.removesuffix("\n").split("\n") if content else []), set()
    first = lambda text, p: next((n for n, x in enumerate(text, 1) if p in x), None)
    if kind == "config":
        for n, line in enumerate(lines, 1):
            up = line.upper()
            name = up.split("=")[0].strip()
            if up.strip() and not up.strip().startswith("#") and any(x in up for x in ("API_KEY", "SECRET", "TOKEN", "ID", "KEY")):
                r = next((r for r in rules_.env if name == r.pattern.upper() or name.startswith(r.pattern.upper() + "_")), None)
                out |= {("env", r.provider, r.service_name or f"{r.pattern} Service", n)} if r else set()
        out |= {("database", r.provider, r.service_name or f"{r.pattern.replace('://', '')} Database", first(lines, r.pattern)) for r in rules_.database if r.pattern.lower() in low}
    if kind == "infrastructure":
        out |= {("infrastructure", r.provider, r.service_name or r.pattern, first(lines, r.pattern)) for r in rules_.infrastructure if r.pattern.lower() in low}
    if kind == "code":
        out |= {("api", r.provider, r.service_name or f"{r.pattern} API", first(lines, r.pattern)) for r in rules_.api if r.pattern in content}
        some = {("aws_v2", r.provider, f"AWS {r.service_name}", first(low.split("\n"), f"aws.{r.pattern}")) for r in rules_.aws_v2 if any(x in low for x in (f"aws.{r.pattern}", f"aws['{r.pattern}']", f'aws["{r.pattern}"]'))}
        out |= (some or {("aws_v2", "Aws", "AWS SDK (v2)", first(lines, "aws-sdk"))}) if "aws-sdk" in low else set()
        code = [True] * len(low)
        for a, b in rule_scan.not_code(low, language):
            code[a:b] = [False] * (min(b, len(low)) - a)
        for r in rules_.sdk:
            p = r.pattern.lower()
            shapes = [f"from '{p}", f'from "{p}', f"require('{p}", f'require("{p}', f"import {p}"] + [f"from {p} ", f'"{p}"', f"'{p}'", f" {p}", f"{p} "] * (not p.startswith("@"))
            places = [low.find(s) for s in shapes if s in low] + [m.start() for m in re.finditer(rf"(?<!\w){re.escape(p)}(?!\w)", low) if not p.startswith("@")]
            if any(code[k] for k in places):
                out.add(("sdk", r.provider, r.service_name or f"{r.pattern.replace('@', '').replace('/', '')} SDK", low.count("\n", 0, low.find(p)) + 1))
    return out


def test_rules_in_one_pass_by_brute_force():
    import random

    rng = random.Random(11)
    plugin = rules.Rules(
        tuple(rules.Rule(f"own{k}", f"P{k}") for k in range(40)) + (rules.Rule("STRIPE", "Late"), rules.Rule("HF", "Early")),
        (rules.Rule("together-x", "T"), rules.Rule("Stripe", "Again", service_name="S"), rules.Rule("a-a", "A")),
        (rules.Rule("API.x.io", "X"), rules.Rule("x.io", "Y")),
        (rules.Rule("Redis://h", "R"), rules.Rule("redis://", "Twice")),
        (rules.Rule("aws_s3", "S"),),
        (rules.Rule("s3x", "Aws", service_name="Own"),),
    )
    merged = rules.builtin().merged(plugin)
    scanner = rule_scan.Scanner(merged)
    words = ["stripe", "Stripe", "together", "together-x", "@clerk/", "openai", "a-a", "a-a-a", "api.x.io", "API.x.io", "api.github.com", "redis://h", "REDIS://", "aws_s3_bucket", "aws-sdk", "AWS.S3", "aws['sns']", "aws.s3x", "import ", "from '", 'from "', "require('", "'", '"', "#", "//", "/*", "*/", "\n", "\n", " ", " ", "=", "é", "x"]
    env = ["STRIPE", "HF_", "HF", "own7", "TOGETHER", "AI", "_", "_", "KEY", "TOKEN", "=", " ", "\n", "\n", "#", "x", "redis://"]
    seen = 0
    for k in range(3000):
        kind = rng.choice(["code", "config", "infrastructure"])
        text = "".join(rng.choice(env if kind == "config" else words) for _ in range(rng.randint(0, 25)))
        language = rng.choice(["python", "javascript", None])
        got = {(f, p, n, line) for f, p, _, n, line, _ in scanner.scan(kind, "x", text, language)}
        want = plain_hits(merged, kind, "x", text, language)
        assert got == want, (kind, text, got ^ want)
        seen += len(want)
    assert seen > 1500


def test_ten_thousand_rules(spark):
    table = spark.createDataFrame([(f, k, f"{f}-word-{k:05}", f"P{k}", "Api", 0.5, None) for f in ("api", "sdk", "database", "env") for k in range(10_000)], "family string, rank int, pattern string, provider string, service_type string, confidence double, service_name string")
    many = rule_scan.rules_of(table)
    assert len(many.api) == 10_000 and many.sdk[7].pattern == "sdk-word-00007"
    files = {f"f{k}.py": "".join(f"x = 1  # filler {i}\nu = 'https://api-word-{(k * 37 + i) % 20_000:05}/'\n" for i in range(2000)) for k in range(4)}
    prepared = files_of(spark, files).withColumn("class", services.file_class(F.col("low_name")))
    got = {(r.file_path, r.provider, r.line_number) for r in rule_scan.rule_hits(prepared, many).where("family = 'api'").collect()}
    assert got == {(f"f{k}.py", f"P{(k * 37 + i) % 20_000}", 2 * i + 2) for k in range(4) for i in range(2000) if (k * 37 + i) % 20_000 < 10_000}
    with pytest.raises(ValueError):
        rule_scan.rules_of(table, most=5)


def test_detected_services_are_merged(spark):
    files = files_of(spark, {"a.js": "import Stripe from 'stripe';\n", "b.js": "import Stripe from 'stripe';\n", "venv/lib/site-packages/c.py": "import openai\n"})
    rows = services.detect_services(files).collect()
    assert [(r.name, r.file_paths) for r in rows] == [("stripe SDK", "a.js,b.js")]
    deps = manifests.npm(files_of(spark, {"package.json": '{"dependencies": {"@clerk/next": "1", "acme-sdk": "2"}}'}))
    got = {(r.name, r.provider, r.confidence) for r in services.package_services(deps).collect()}
    assert got == {("@clerk/next", "Clerk", 0.6), ("acme-sdk", "Acme", 0.4)}


def test_plugins(spark):
    plugins.register(spark, "demo_plugin", lambda path, content: [(content.split()[0], "function", 1, "own")] if content else 1 / 0)
    files = files_of(spark, {"a.x": "hello there", "b.x": ""})
    rows = plugins.plugin_elements(files, "demo_plugin").collect()
    assert [(r.file_path, r.name, r.language) for r in rows] == [("a.x", "hello", "own")]
    e, r = plugins.decoded(spark.createDataFrame([('{"decoder_format": {"code_elements": [{"name": "n"}], "code_relationships": []}}',), ("broken",)], "value string"))
    assert [x.name for x in e.collect()] == ["n"] and r.count() == 0


def code_places(text, language):
    """For each character whether it stands in code, character by character."""
    python = language == "python"
    out, i, n, closing = [], 0, len(text), None
    while i < n:
        c = text[i]
        if closing is None:
            three = text[i : i + 3]
            if python and c == "#" or not python and text[i : i + 2] == "//":
                closing, step, code = "\n", 1, False
            elif not python and text[i : i + 2] == "/*":
                closing, step, code = "*/", 2, False
            elif python and three in ('"""', "'''"):
                closing, step, code = three, 3, True
            elif c in "\"'" or c == "`" and not python:
                closing, step, code = c, 1, True
            else:
                step, code = 1, True
            out += [code] * step
            i += step
        elif closing in ('"', "'", "`") and c == "\\":
            out += [False] * min(2, n - i)
            i += 2
        elif closing in ('"', "'") and c == "\n" or text.startswith(closing, i):
            step = 1 if c == "\n" else len(closing)
            out += [False] * step
            i += step
            closing = None
        else:
            out.append(False)
            i += 1
    return out[:n]


def test_comments_and_strings():
    import random

    rng = random.Random(1)
    for language in ("python", "javascript"):
        for _ in range(3000):
            text = "".join(rng.choice(["a", " ", "\n", "'", '"', "`", "#", "//", "/*", "*/", "\\", '"""', "'''"]) for _ in range(rng.randint(0, 25)))
            code = [True] * len(text)
            for a, b in rule_scan.not_code(text, language):
                code[a:b] = [False] * (min(b, len(text)) - a)
            assert code == code_places(text, language), (language, text)


def test_yaml():
    doc = security.parse_yaml("a: 1\nb:\n  - x: 1\n    y: 'q'\n  - z\nc:\n  d: !Ref e\n# no\nf: [1, 2]\n")
    assert doc == {"a": "1", "b": [{"x": "1", "y": "q"}, "z"], "c": {"d": "e"}, "f": [1, 2]}


def test_graph_properties(spark):
    files = files_of(spark, {"package.json": PACKAGE, "s.js": "app.listen(3000)\napp.get('/x', h)\nimport a from \"express\"\n"})
    kept = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  detectors run once
    deps = kept(manifests.npm(files).withColumn("id", F.col("name")))
    p, e, c = kept(ports.detect_ports(files)), kept(endpoints.detect_endpoints(files)), kept(code.code_elements(files))
    repos = spark.createDataFrame([("r", "repo", "u")], "id string, name string, url string")
    nodes, edges = graph.build_graph({"repositories": repos, "dependencies": deps, "ports": p, "endpoints": e, "code_elements": c})
    nodes, edges = kept(nodes), kept(edges)
    ids = {r.id for r in nodes.collect()}
    rows = edges.collect()
    assert len(ids) == nodes.count() and all(r.source_node_id in ids and r.target_node_id in ids for r in rows)
    assert sum(r.degree for r in aggregates.degrees(nodes, edges).collect()) == 2 * len(rows)
    assert {r.edge_type for r in rows} == {"uses_package_manager", "has_port", "has_endpoint", "endpoint_uses_port"}
    assert graph.neighbors(nodes, edges, "unknown").count() == 0
    rolled, left = graph.rolled_up(nodes, edges, ("module",))
    assert left.where("edge_type = 'has_child'").count() == 1 and rolled.where("node_type = 'code_group'").count() == 1
    page = report.render("T<>", {"dependencies": deps, "endpoints": e}, nodes, edges)
    assert "T&lt;&gt;" in page and "express" in page


def test_loops_lone_nodes_and_missing_ends(spark):
    nodes = spark.createDataFrame([("a",), ("lone",)], "id string")
    edges = spark.createDataFrame([("a", "a"), ("a", "gone")], "source_node_id string, target_node_id string")
    assert {r.id: r.degree for r in aggregates.degrees(nodes, edges).collect()} == {"a": 3, "lone": 0, "gone": 1}


def test_closure_with_a_cycle(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "a")], "name string, dependency string")
    got = packages.closure(pairs, spark.createDataFrame([("a",), ("b",), ("none",)], "name string")).collect()
    assert {(r.start, r.reached) for r in got} == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "b")}


def test_closures_of_all_names(spark):
    rng = random.Random(5)
    plain = [("a", "b"), ("b", "c"), ("c", "b"), ("x", "a"), ("c", "end"), ("end", "leaf"), ("own", "own"), ("x", None), (None, "a"), ("end", "leaf")]
    layered = [(f"n{a}", f"n{b}") for a in range(60) for b in rng.sample(range(60), 2) if b > a]
    mixed = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(45)]
    for pairs in (plain, layered, mixed, []):
        want = {(a, b) for a, b in pairs if a is not None}
        while more := {(a, d) for a, b in want for c, d in pairs if b is not None and b == c} - want:
            want |= more
        got = packages.closures(spark.createDataFrame(pairs, "name string, dependency string"), piece=16).collect()
        assert len(got) == len(want) and {(r.start, r.reached) for r in got} == want


def test_tools_merge_scripts_and_settings(spark):
    rows = [("r", "t", "c", "x", "1", 0.5, [("s", "one")], {"k": "a"}, "1"), ("r", "t", "c", "x", "2", 0.9, [("s", "two"), ("u", "three")], {"k": "b", "l": "c"}, "2")]
    df = spark.createDataFrame(rows, "repository_id string, name string, category string, tool_type string, id string, confidence double, scripts array<struct<name:string,command:string>>, configuration map<string,string>, ord string")
    r = aggregates.merged_tools(df).first()
    assert (r.id, r.confidence, [tuple(s) for s in r.scripts], r.configuration) == ("1", 0.9, [("s", "one"), ("u", "three")], {"k": "b", "l": "c"})


def test_lookups_need_what_they_need(spark):
    df = spark.createDataFrame([(1, "service", 2)], "code_element_id int, target_type string, target_id int")
    with pytest.raises(ValueError):
        catalog.code_relationships(df)
    with pytest.raises(ValueError):
        catalog.search_documentation(df, "")


def test_band_by_brute_force(spark):
    keys = [(k, f"f{k % 2}", k * 17 % 400) for k in range(60)]
    els = [(e, f"f{e % 2}", e * 31 % 400) for e in range(60)]
    got = joins.key_band(spark.createDataFrame(keys, "id int, file_path string, line_number int"), spark.createDataFrame(els, "id int, file_path string, line_number int")).collect()
    assert sorted((r.key_id, r.element_id) for r in got) == sorted((k, e) for k, f, a in keys for e, g, b in els if f == g and abs(a - b) <= 50)


def test_ask(spark):
    deps = spark.createDataFrame([("aws-sdk", "1"), ("left-pad", "2")], "name string, version string")
    assert [r.name for r in ask.ask("which dependencies are used for aws", {"dependencies": deps}).collect()] == ["aws-sdk"]
    assert ask.parse('Rename "my fn" safely')["intent"] == "refactoring_impact" and "my fn" in ask.parse('Rename "my fn" safely')["entities"]


def test_progress_stream_gives_what_the_batch_gives(spark, tmp_path):
    now = datetime.datetime(2026, 1, 1)
    rows = [(i % 3, i, f"s{i}", now + datetime.timedelta(minutes=i * 7 % 50)) for i in range(40)]
    schema = "repository_id int, event_id int, step_name string, last_updated timestamp"
    df = spark.createDataFrame(rows, schema)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    q = live.progress_stream(spark, str(tmp_path / "in"), df.schema).writeStream.format("memory").queryName("live_progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("live_progress").collect()) == sorted(live.latest(df).collect())
    w = live.windowed_activity(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("live_windows").outputMode("update").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("live_windows").count() > 0


def test_file_stream_is_analysed(spark, tmp_path):
    spark.createDataFrame([("r", "a.py", "def f(x):\n")], corpus.SCHEMA).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = live.analyse_stream(spark, str(tmp_path / "in"), lambda df, _: sinks.replace_rows(code.code_elements(corpus.prepared(df)), out), str(tmp_path / "ck"))
    q.awaitTermination()
    assert [r.name for r in spark.read.parquet(out).collect()] == ["f"]


def test_schedules(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    s = spark.createDataFrame([(1, True, None), (2, True, "2026-01-01 00:00:00"), (3, True, "2026-02-01 00:00:00"), (4, False, None)], "id int, enabled boolean, at string").select("id", "enabled", F.col("at").cast("timestamp").alias("next_run"))
    assert sorted(r.id for r in live.due_jobs(s, now).collect()) == [1, 2]
    j = spark.createDataFrame([("a", "pending", 1, 1, 1), ("a", "running", 1, 2, 2), ("b", "pending", 2, 1, 3)], "job_id string, status string, created_at int, updated_at int, seq int")
    assert [r.job_id for r in live.next_pending(j).collect()] == ["b"]
    assert live.job_counts(j).first().asDict() == {"pending": 1, "running": 1, "total": 2}
