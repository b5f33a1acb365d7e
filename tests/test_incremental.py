"""A catalog kept up to date by changes against one analysis of the last state."""

import datetime

from tallgrass.operators import analysis, incremental, versions
from tallgrass.sources import corpus

T = [datetime.datetime(2026, 1, 1, h) for h in range(6)]


def test_changes_by_stream_give_one_analysis_of_the_last_state(spark, tmp_path):
    root, feed = str(tmp_path / "catalog"), str(tmp_path / "feed")
    repos = spark.createDataFrame([("one", "One", "u1"), ("two", "Two", "u2"), ("none", "None", "u3")], "id string, name string, url string")
    js = "import Stripe from 'stripe';\nfunction start() {\n  app.listen(3000)\n}\n"
    batches = [
        [("one", "package.json", '{"dependencies": {"stripe": "1.0"}}', False, T[0]), ("one", "a.js", js, False, T[0]), ("one", "old.js", js, False, T[0]), ("two", "b.py", "def f():\n    pass\n", False, T[0])],
        # changed, removed, added; what is older or the same counts for nothing; of two changes in a batch the later one counts
        [("one", "a.js", js + "function more() {}\n", False, T[3]), ("one", "a.js", "function lost() {}\n", False, T[2]), ("one", "old.js", None, True, T[2]), ("one", "package.json", '{"dependencies": {"stripe": "1.0"}}', False, T[2]), ("two", "b.py", "def older(): pass\n", False, T[0] - datetime.timedelta(hours=1)), ("two", "never.py", None, True, T[2]), (None, "x", "y", False, T[2])],
        [("one", "a.js", "late", False, T[1]), ("one", "old.js", js, False, T[1]), ("two", "b.py", "def f():\n    pass\n", False, T[4])],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, incremental.CHANGES).coalesce(1).write.mode("overwrite").parquet(f"{feed}/{k}")
        stream = spark.readStream.schema(incremental.CHANGES).parquet(f"{feed}/{k}")
        incremental.analyse_changes(stream, repos, root, str(tmp_path / f"ck{k}")).awaitTermination()
    s = versions.snapshot(spark, root)
    assert s.version == 2  # the last batch changed nothing
    assert {r.repository_id: r.n for r in s.live.groupBy("repository_id").count().withColumnRenamed("count", "n").collect()} == {"one": 1, "two": 1}
    assert len({r.run for r in s.live.collect()}) == 2  # the second batch left repository two alone
    last = [("one", "package.json", batches[0][0][2]), ("one", "a.js", batches[1][0][2]), ("two", "b.py", batches[0][3][2])]
    full = analysis.analyse(corpus.prepared(spark.createDataFrame(last, corpus.SCHEMA)), repos.where("id <> 'none'"))
    for name in ("dependencies", "services", "code_elements", "ports", "nodes", "edges", "code_relationships"):
        columns = [c for c in full[name].columns if c not in ("auth_value",)]
        rows = lambda df: sorted(str(tuple(r)) for r in df.select(*columns).collect())  # noqa: B023, E731
        assert rows(s.table(name)) == rows(full[name]), name
    listing = spark.createDataFrame([("one", "a.js", batches[1][0][2], T[5])], "repository_id string, path string, content string, at timestamp")
    changed = incremental.listing_changes(listing, root)
    assert sorted((r.path, r.deleted) for r in changed.collect()) == [("a.js", False), ("package.json", True)]
