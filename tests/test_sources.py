"""Many repositories in one scan, and plugins that are programs."""

import random
import sys

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallgrass.sources import corpus, processes, repositories


def test_path_rules_are_the_columns_rules(spark):
    rng = random.Random(2)
    names = ["a.js", "A.min.js", ".env", ".env.example", ".hidden", "x.pyc", "config", ".config", "openapi.yaml", ".swagger.json", "lib.so", "target", "README.md"]
    folders = ["src", "node_modules", "Target", ".git", "dist", "build", "venv", "site-packages", "out", "my.git", "coverage", "x"]
    paths = sorted({"/".join([*rng.choices(folders, k=rng.randint(0, 3)), rng.choice(names)]) for _ in range(600)})
    df = corpus.prepared(spark.createDataFrame([("r", p, "x") for p in paths], corpus.SCHEMA))
    every = corpus.skipped() & corpus.skipped_by_services() & corpus.skipped_by_security() & corpus.skipped_by_ports() & corpus.skipped_by_endpoints() & corpus.skipped_by_secrets()
    rows = df.select("path", corpus.skipped().alias("general"), corpus.skipped_by_security().alias("security"), every.alias("unread")).collect()
    for r in rows:
        assert (repositories.skipped(r.path), repositories.skipped_by_security(r.path), repositories.unread(r.path)) == (r.general, r.security, r.unread), r.path


def test_partitions_by_bytes():
    rows = [("a", "fa", 10), ("b", "fb", 50), ("c", "fc", 45), ("big", "fd", 250), ("e", "fe", 0), ("f", "ff", 100)]
    plan = repositories.planned(rows, 100)
    assert plan[:1] == [[("a", "fa", 0, 1), ("b", "fb", 0, 1)]] and [("big", "fd", k, 3) for k in range(3)] == [p[0] for p in plan if p[0][0] == "big"]
    assert sorted({x[0] for p in plan for x in p}) == ["a", "b", "big", "c", "e", "f"] and repositories.planned([], 9) == []


def test_many_repositories_in_one_scan(spark, tmp_path, monkeypatch):
    want, rows = set(), []
    for k in range(25):
        folder = tmp_path / "repos" / f"node_modules_{k}"  # a parent's name doesn't count
        for path, text in [("src/a.py", f"def f{k}(): pass\n"), ("b/c.js", "x" * (k * 40)), ("node_modules/x.js", "no"), ("dist/y.js", "no"), (".git/config", "no"), ("é ü.md", "# T\n")]:
            (folder / path).parent.mkdir(parents=True, exist_ok=True)
            (folder / path).write_text(text)
            want |= {(str(k), path, text)} if "no" != text else set()
        (folder / "bad.py").write_bytes(b"\xff\xfe\xff")
        rows.append((k, str(folder) if k % 2 else f"file://{folder}"))
    manifest = str(tmp_path / "manifest.parquet")
    pq.write_table(pa.table({"repository_id": [r for r, _ in rows] + [99], "folder": [f for _, f in rows] + [str(tmp_path / "gone")]}), manifest)
    df = repositories.read_repositories(spark, manifest, partition_bytes=700)
    assert sorted(map(tuple, df.select("repository_id", "path", "content").collect())) == sorted(want)
    assert df.rdd.getNumPartitions() > 5
    assert df.groupBy("repository_id").count().count() == 25
    # what is skipped isn't opened
    seen, real = [], repositories.opened
    monkeypatch.setattr(repositories, "opened", lambda folder, path: seen.append(path) or real(folder, path))
    reader = repositories.RepositoriesReader({"manifest": manifest, "partition_bytes": "700"})
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 75 and len(seen) == 100  # and the one that isn't UTF-8
    assert not [p for p in seen if "node_modules/" in p or "dist/" in p or ".git" in p]


PLUGIN = """
import json, sys, time
for line in sys.stdin:
    q = json.loads(line)
    if q["path"] == "crash": sys.exit(3)
    if q["path"] == "hang": time.sleep(60)
    if q["path"] == "odd": print("no json"); sys.stdout.flush(); continue
    if q["path"] == "list": print("[]"); sys.stdout.flush(); continue
    rows = [{"name": w, "element_type": "flow", "line_number": n + 1, "language": "own"} for n, w in enumerate(q["content"].split("\\n")) if w]
    print(json.dumps({"decoder_format": {"code_elements": rows + [{"name": None}, 7]}})); sys.stdout.flush()
"""


def test_a_plugin_that_dies_loses_one_file(spark, tmp_path):
    script = tmp_path / "plugin.py"
    script.write_text(PLUGIN)
    names = ["a", "crash", "b", "odd", "c", "hang", "d", "list", "big", "e"]
    files = spark.createDataFrame([("r", n, "x\n" * 200_000 + "end" if n == "big" else f"{n}1\n\n{n}3") for n in names], corpus.SCHEMA).coalesce(1)
    found = processes.program_elements(files, [sys.executable, str(script)], seconds=5.0).collect()
    assert sorted((r.file_path, r.name, r.line_number) for r in found if r.file_path != "big") == sorted((n, f"{n}{k}", k) for n in "abcde" for k in (1, 3))
    assert sum(r.file_path == "big" for r in found) == 200_001 and {r.language for r in found} == {"own"}
    missing = processes.program_elements(files.where(F.col("path").isin("a", "b")), [str(tmp_path / "none")])
    assert missing.count() == 0 and processes.program_elements(files.limit(0), [sys.executable, str(script)]).count() == 0
