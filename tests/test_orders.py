"""Orders of the list pages, caps and intents of the assistant, and the endpoint scan's skip rule."""

import random

import pytest

from tallgrass.operators import ask, catalog
from tallgrass.sources import corpus


def shuffled(spark, rows, schema):
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(3)


def test_orders_of_the_list_pages(spark):
    ranks = [(a, b, f"{a}{b}{c}") for a in "cab" for b in "yxz" for c in "21"]
    for page, first, second, last in (
        (catalog.dependencies, "package_manager", "name", "version"),
        (catalog.services, "provider", "name", "id"),
        (catalog.security_entities, "entity_type", "name", "id"),
        (catalog.security_relationships, "relationship_type", "source_entity_id", "target_entity_id"),
    ):
        df = shuffled(spark, [(*r, "r") for r in ranks] + [("a", "x", "gone", "q")], f"{first} string, {second} string, {last} string, repository_id string")
        assert [tuple(r)[:3] for r in page(df, "r").collect()] == sorted(ranks)


def tables(spark):
    many = lambda n, *more: [(f"n{k:02}", f"f{k % 3}.py", *more) for k in range(n)]
    return {
        "code_elements": spark.createDataFrame([*many(30, "function", "python"), ("Cls", "c.py", "class", "python")], "name string, file_path string, element_type string, language string"),
        "services": spark.createDataFrame(many(30, "stripe", "Payment"), "name string, file_path string, provider string, service_type string"),
        "dependencies": spark.createDataFrame([("left-pad", "1.0")] + [(f"d{k:02}", "2") for k in range(30)], "name string, version string"),
        "tools": spark.createDataFrame([("webpack", "build")], "name string, category string"),
        "tests": spark.createDataFrame([("test_a", "t.py", "pytest")], "name string, file_path string, test_framework string"),
        "documentation": spark.createDataFrame([("README.md", "Title", "readme")], "file_name string, title string, doc_type string"),
    }


def test_every_intent_answers_from_its_table(spark):
    t, kinds = tables(spark), {"find_functions": "function", "list_services": "service", "find_dependencies": "dependency", "tool_discovery": "tool", "find_tests": "test", "find_documentation": "documentation", "refactoring_impact": "code_element"}
    said = {"find_functions": "which functions are there", "list_services": "what services are used", "find_dependencies": "which dependencies are there", "tool_discovery": "what tools are used", "find_tests": "show me the tests", "find_documentation": "where is the documentation", "refactoring_impact": "what is the impact of refactoring `Cls`"}
    seen = set()
    for text in said.values():
        intent = ask.parse(text)["intent"]
        rows = ask.ask(text, t).collect()
        seen.add(intent)
        assert len(rows) <= ask.LIMIT and {r.kind for r in rows} <= {kinds.get(intent, r.kind) for r in rows}
    assert len(seen & set(kinds)) >= 5


@pytest.mark.parametrize("limit", [1, 9, 15])
def test_caps_of_the_mixed_answer(spark, limit):
    text = next(x for x in ("hello", "anything at all", "xyzzy") if ask.parse(x)["intent"] not in ("find_functions", "list_services", "find_dependencies", "tool_discovery", "find_tests", "find_documentation", "refactoring_impact") and not ask.parse(x)["topics"])
    rows = ask.ask(text, tables(spark), limit).collect()
    count = lambda kind: sum(r.kind == kind for r in rows)
    assert (count("code_element"), count("service"), count("dependency")) == (max(1, limit // 3), max(1, limit // 5), max(1, limit // 5))


def test_skip_rule_of_the_endpoint_scan(spark):
    expected = {
        "src/a.js": False, ".hidden.js": True, ".env": False, ".openapi.yaml": False, ".swagger": False, ".api-gateway": False, ".config": False, ".babelrc": True,
        "node_modules/a.js": True, "target/a.rs": True, ".git/config": True, "venv/a.py": True, "x/site-packages/a.py": True, "dist/a.js": False, "a.min.js": False, "openapi.json": False,
    }
    df = corpus.prepared(spark.createDataFrame([("r", p, "x") for p in expected], corpus.SCHEMA))
    assert {r.path: r.s for r in df.select("path", corpus.skipped_by_endpoints().alias("s")).collect()} == expected
