"""Readers, writers and incremental runs on files."""
import json

from pyspark.sql import functions as F

from trailrank import schemas
from trailrank.sources import ingest, sinks
from trailrank.streaming.incremental import run_incremental


def test_read_instances_and_pool(spark, tmp_path):
    rows = [{"instance_id": f"i{n}", "repo": "r", "FAIL_TO_PASS": '["a","b"]' if n % 2 else "plain", "PASS_TO_PASS": None} for n in range(5)]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = {r.instance_id: r.failing for r in ingest.read_instances(spark, str(tmp_path / "p.json"), 3).collect()}
    assert got == {"i0": ["plain"], "i1": ["a", "b"], "i2": ["plain"]}


def test_read_source_lines(spark, tmp_path):
    (tmp_path / "src" / "pkg").mkdir(parents=True)
    (tmp_path / "src" / "pkg" / "a.py").write_text("x = 1\ny = 2")
    got = [(r.path.rsplit("/", 1)[1], r.line_no, r.text) for r in ingest.read_source_lines(spark, str(tmp_path / "src")).orderBy("line_no").collect()]
    assert got == [("a.py", 1, "x = 1"), ("a.py", 2, "y = 2")]
    files = ingest.read_source_files(spark, str(tmp_path / "src"))
    assert ingest.list_paths(files, []).count() == 1


def test_read_coverage_json(spark, tmp_path):
    rec = {"instance_id": "i", "files": {"/testbed/a/b.py": {"executed_lines": [1, 3]}, "tests/test_b.py": {"executed_lines": [1]}, "c.py": {"executed_lines": []}}}
    (tmp_path / "c.json").write_text(json.dumps(rec, indent=1))
    raw = ingest.read_json(spark, str(tmp_path / "c.json"), schemas.COVERAGE_RAW, True)
    assert sorted((r.file, r.line) for r in ingest.coverage_long(raw, ["instance_id"]).collect()) == [("a/b.py", 1), ("a/b.py", 3)]


def test_arm_metrics(spark, tmp_path):
    rec = {"instance_id": "i", "arms": {"x": {"R1": 0, "R3": 1, "R5": 1, "R10": 1}}}
    (tmp_path / "m.json").write_text(json.dumps(rec))
    raw = ingest.read_json(spark, str(tmp_path / "m.json"), schemas.ARM_METRICS)
    assert sorted((r.k, r.hit) for r in ingest.arm_metrics_long(raw).collect()) == [(1, 0), (3, 1), (5, 1), (10, 1)]


def test_write_results_appends_runs(spark, tmp_path):
    out = str(tmp_path / "res")
    sinks.write_results(spark.range(3), out, "a")
    sinks.write_results(spark.range(2), out, "b")
    assert {r.run: r["count"] for r in spark.read.parquet(out).groupBy("run").count().collect()} == {"a": 3, "b": 2}
    sinks.write_jsonl(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_incremental_run_skips_stored(spark, tmp_path):
    src, sink, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()

    def put(name, ids):
        (src / name).write_text("\n".join(json.dumps({"instance_id": i}) for i in ids))

    def go():
        q = run_incremental(spark, str(src), "instance_id string", sink, ck, "instance_id", lambda d: d.withColumn("n", F.length("instance_id")))
        q.awaitTermination(120)
    put("1.json", ["a", "bb", "a"])
    go()
    put("2.json", ["bb", "ccc"])
    go()
    rows = spark.read.parquet(sink)
    assert sorted((r.instance_id, r.n, r.batch) for r in rows.collect()) == [("a", 1, 0), ("bb", 2, 0), ("ccc", 3, 1)]
