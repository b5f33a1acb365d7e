"""What a query moves or asks for grows no faster than its input and output."""

import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from tallgrass.operators import joins, relate, rule_scan, services
from tallgrass.sources import corpus
from tallgrass.streaming import stateful


def moved(spark, df):
    """The rows of df, and the bytes shuffled for them."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(store.executorList(True).apply(i).totalShuffleWrite() for i in range(store.executorList(True).size()))
    before = total()
    rows = df().collect()
    return rows, total() - before


def files_of(spark, texts):
    return corpus.prepared(spark.createDataFrame([(1, p, t) for p, t in texts.items()], "repository_id int, path string, content string"))


def test_a_shared_provider_is_not_multiplied(spark):
    """Each element stands near the provider of 400 services, of which one is named."""
    files = files_of(spark, {"a.js": "\n".join(["run('name-00007') // vendor-x"] * 240)})
    elements = spark.createDataFrame([(1, k, "a.js", k) for k in range(1, 201)], "repository_id int, id int, file_path string, line_number int")
    found = spark.createDataFrame([(1, k, f"name-{k:05}", "Vendor-X") for k in range(400)], "repository_id int, id int, name string, provider string")
    rows, size = moved(spark, lambda: relate.service_relationships(elements, files, found))
    assert sorted((r.code_element_id, r.target_id, r.confidence) for r in rows) == [(k, 7, 0.9) for k in range(1, 201)]
    assert rows[0].evidence == "Service name 'name-00007' found in code; Provider 'Vendor-X' found in code; SDK pattern 'name-00007' detected"
    assert size < 200_000


def test_a_shared_scope_is_not_moved(spark):
    """Each of 200 elements is tied to 400 dependencies by their scope; one of them is imported and named too."""
    files = files_of(spark, {"a.js": "\n".join(["import x from '@s/dep-00007';"] * 240)})
    elements = spark.createDataFrame([(1, k, "a.js", k) for k in range(1, 201)], "repository_id int, id int, file_path string, line_number int")
    deps = spark.createDataFrame([(1, k, f"@s/dep-{k:05}") for k in range(400)], "repository_id int, id int, name string")
    rows, size = moved(spark, lambda: relate.dependency_relationships(elements, files, deps))
    assert sorted((r.code_element_id, r.target_id, r.confidence) for r in rows) == sorted((e, k, 1.0 if k == 7 else 0.3) for e in range(1, 201) for k in range(400))
    assert {r.evidence for r in rows if r.target_id == 8} == {"Scoped package part '@s' found"}
    assert size < 200_000


def test_a_shared_scope_is_scored_once(spark):
    """What is said of a dependency by its scope is made before it meets the elements."""
    files = files_of(spark, {"a.js": "import x from '@s/dep-1';"})
    elements = spark.createDataFrame([(1, 1, "a.js", 1)], "repository_id int, id int, file_path string, line_number int")
    deps = spark.createDataFrame([(1, k, f"@s/dep-{k}") for k in range(4)], "repository_id int, id int, name string")
    plan = relate.dependency_relationships(elements, files, deps)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Union":
        plan = plan.children().apply(0)
    above, below = plan.children().apply(1).toString().split("Join", 1)
    assert "array_join" in below and "array_join" not in above


def test_a_band_of_one_line_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "PACK", 64, raising=False)
    keys = spark.range(600).select(F.col("id"), F.lit("f").alias("file_path"), F.lit(7).alias("line_number"))
    per = joins.key_band(keys, keys).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in per) == 360_000 and max(r["count"] for r in per) < 200_000
    none = spark.createDataFrame([(None, "f", 7), (1, None, 7), (2, "f", None)], "id long, file_path string, line_number int")
    assert [tuple(r) for r in joins.key_band(none, none).collect()] == [(None, None)]


def test_pairs_of_two_lists_are_not_held(spark):
    """Within one compiled loop Spark holds all that a row gives: the loops over keys and over elements are two."""
    keys = spark.range(600).select(F.col("id"), F.lit("f").alias("file_path"), F.lit(7).alias("line_number"))
    plan = joins.key_band(keys, keys)._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate inline(element_ids") < plan.find("Coalesce") < plan.index("Generate inline(key_ids")


def test_rules_of_a_table_as_a_few_rules(spark):
    rng = random.Random(3)
    patterns = {
        "api": ["api.x.io", "API.x.io", "x.io", "h-7.example", "h-70.example", "é.x.io"],
        "sdk": ["stripe", "@clerk/", "@clerk/next", "a-b-c"],
        "database": ["redis://", "Redis://h", "db:own:"],
        "infrastructure": ["aws_s3", "res.own.kind"],
        "env": ["SKU7", "SKU7_API", "HF_", "straße", "SKU"],
        "aws_v2": ["s3", "sns"],
    }
    rows = [(f, k, p, f"P{k}", None, 0.1 * k, "Own" if k % 2 else None) for f, ps in patterns.items() for k, p in enumerate(ps)]
    table = spark.createDataFrame([*rows, rows[0]], "family string, rank int, pattern string, provider string, service_type string, confidence double, service_name string")
    words = [p for ps in patterns.values() for p in ps] + ["aws-sdk", "aws.s3", "AWS['sns']", "import ", "from '", "'", '"', "#", "\n", "\n", " ", "_KEY", "=", "x", "SKU7_API_KEY=x\n", "STRASSE_TOKEN=1\n"]
    files = {f"{'d' * (k % 3)}{k}{rng.choice(['.js', '.py', '.env', '.tf'])}": "".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for k in range(200)}
    prepared = files_of(spark, files).withColumn("class", services.file_class(F.col("low_name")))
    plain = lambda df: sorted(map(str, df.collect()))
    want = plain(rule_scan.rule_hits(prepared, rule_scan.rules_of(table)))
    assert len(want) > 300 and plain(rule_scan.table_hits(prepared, table, block=3)) == want


def test_a_jobs_events_are_one_call(spark):
    calls, kept = [], []

    def state(store):
        def call(name, *args):
            calls.append(name)
            if name == "get":
                return iter(list(store))
            if name in ("put", "clear"):
                store.clear()
            if name in ("put", "appendList"):
                store.extend(args[0])
            return bool(store)

        return SimpleNamespace(**{n: (lambda *a, n=n: call(n, *a)) for n in ("get", "put", "clear", "appendList", "exists", "update", "updateValue", "keys", "iterator", "removeKey")})

    handle = SimpleNamespace(getValueState=lambda *a: state([]), getListState=lambda *a: state(kept), getMapState=lambda *a: state([]), registerTimer=lambda t: None)
    jobs, timer = stateful.Jobs(), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    jobs.init(handle)
    events = pd.DataFrame({"seq": range(1000), "status": ["pending"] + ["running"] * 999, "at_ms": range(1000)})
    assert list(jobs.handleInputRows(("j",), iter([events]), timer))[0]["seq"].tolist() == [1]
    assert len(calls) < 10 and len(kept) == 1000
    assert list(jobs.handleInputRows(("j",), iter([events[:1]]), timer))[0]["seq"].tolist() == [1]
    assert len(kept) == 1000
    timer.getCurrentWatermarkInMs = lambda: 499
    list(jobs.handleExpiredTimer(("j",), timer, None))
    assert len(kept) == 500
