"""Rules at their edges: large ids, short passages, restarts, patches without lines, line breaks, small samples."""
import json

import pytest
from pyspark.sql import functions as F

from trailrank.functions import columns as C
from trailrank.operators import classify as K
from trailrank.operators import parse as P
from trailrank.operators import stats as T
from trailrank.plans import bindings as B
from trailrank.streaming.incremental import run_incremental


def _draw(item, seed):
    h = (item * 2654435761 + seed * 2246822519) % 2 ** 32
    h = ((h ^ h >> 15) * 1103515245 + 12345) % 2 ** 32
    h = ((h ^ h >> 13) * 1664525 + 1013904223) % 2 ** 32
    return h ^ h >> 16


def test_hashes_of_large_ids(spark):
    ids = [0, 1, 17, 2 ** 31, 20_000_000_000, 2 ** 62 + 12345]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", C.hash_order(F.col("id")).alias("o"), C.hash_seeded(F.col("id"), F.col("id") + 3).alias("s")).collect()
    assert {r.id: (r.o, r.s) for r in rows} == {i: (i * 2654435761 % 2 ** 32, _draw(i, i + 3)) for i in ids}


def test_passages_of_any_length(spark):
    texts = {1: "alpha beta gamma delta epsilons zeta", 2: "x alphabet y\nz beta", 3: "one two three four five six seven eight", 4: "", 5: "beta\none two three four five six sevens"}
    items = {10: "alpha", 11: "alpha beta gamma delta", 12: "alpha beta gamma delta epsilon", 13: "one two three four five six seven", 14: "a", 15: "", 16: "nowhere to be found in any of these texts",
             17: "beta\none two"}
    docs, asked = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, item string")
    got = {(r.item_id, r.doc_id): (r.start, r.end) for r in B.contained(docs, asked).collect()}
    want = {(i, d): (1 + (n := t[:t.index(p)].count("\n")), 1 + n + p.count("\n")) for i, p in items.items() for d, t in texts.items() if p and p in t}
    assert got == want


def test_restart_with_a_new_checkpoint_keeps_the_sink(spark, tmp_path):
    sink = str(tmp_path / "out")

    def go(name, ids):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text("\n".join(json.dumps({"id": i, "n": n}) for i, n in ids))
        run_incremental(spark, str(tmp_path / name), "id string, n int", sink, str(tmp_path / f"{name}-progress"), "id", lambda d: d, order=["n"]).awaitTermination(120)

    go("one", [("a", 2), ("a", 1), ("b", 1)])
    go("two", [("b", 9), ("c", 1)])
    assert sorted((r.id, r.n) for r in spark.read.parquet(sink).collect()) == [("a", 1), ("b", 1), ("c", 1)]


def test_mechanism_looks_at_the_first_python_file(spark):
    edits = spark.createDataFrame([(1, "n.txt", 0, 3, "deleted"), (1, "a.py", 1, 3, "anchor"), (1, "b.py", 2, 3, "deleted"), (2, "n.txt", 0, 1, "deleted"),
                                   (3, "a.py", 0, 3, "deleted"), (4, "a.py", 0, 3, "deleted")], "i int, file string, file_ord int, line int, kind string")
    funcs = spark.createDataFrame([(i, f, "f", 1, 9) for i in range(1, 6) for f in ("a.py", "b.py")], "i int, file string, name string, start int, end int")
    ran = spark.createDataFrame([(4, "a.py", 8), (3, "b.py", 8)], "i int, file string, line int")
    got = K.offpath_mechanism(spark.range(1, 6).selectExpr("cast(id as int) as i"), edits, funcs, ran, ["i"]).collect()
    assert {r.i: r.mechanism for r in got} == {1: "insertion", 2: "other", 3: "func-never-reached", 4: "missed-branch", 5: "other"}


def test_pool_counts_files_without_lines(spark):
    edit, new = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,1 @@\n-a\n b\n", "--- /dev/null\n+++ b/new.py \r\n@@ -0,0 +1,1 @@\n+c\n"
    patches = spark.createDataFrame([(1, edit), (2, edit + new), (3, edit + "--- a/r.txt\n+++ b/r.txt\n@@ -1,1 +1,1 @@\n-q\n+z")], "i int, patch string")
    shape = K.patch_shape(P.patch_files(patches, ["i"]), P.diff_to_edit_lines(patches, ["i"]), ["i"])
    assert {r.i: (r.n_files, r.n_py) for r in shape.collect()} == {1: (1, 1), 2: (2, 2), 3: (2, 1)}
    pool = lambda rule: {r.i for r in K.select_pool(spark.range(1, 4).selectExpr("cast(id as int) as i", "true as has_failing"), shape, ["i"], rule).collect()}
    assert pool("single_py") == {1, 3} and pool("one_file") == {1} and pool("multi_py") == {2} and 3 in pool("all_py")


def test_lines_as_a_reader_splits_them(spark):
    for text in ("a\nb\n", "a\r\nb\rc", "", "\n", "a\n\nb", "x\x0by\x85z w"):
        got = spark.createDataFrame([(1, text)], "i int, text string")
        assert [r.text for r in P.numbered_lines(got, ["i"]).orderBy("line_no").collect()] == text.splitlines()


@pytest.mark.parametrize("text,error,message", [("SystemExit: 2", "SystemExit", "2"), ("x\nAssertionError", "AssertionError", ""), ("ValueError: " + "m" * 300, "ValueError", "m" * 200),
                                                ("a.b.MyError bad\nKeyError: 'k'", "KeyError", "'k'")])
def test_error_lines(spark, text, error, message):
    r = P.exception_facts(spark.createDataFrame([(1, text)], "i int, text string"), ["i"]).first()
    assert (r.error, r.message) == (error, message)


def test_locations_stay_inside_the_file(spark):
    loc = spark.createDataFrame([(1, "line: 1-2000000000"), (2, "line: 400"), (3, "line: 19")], "i int, loc string")
    spans = spark.createDataFrame([], "i int, name string, start int, end int")
    sizes = spark.createDataFrame([(i, 20) for i in (1, 2, 3)], "i int, n_lines int")
    got = [(r.i, r.line) for r in P.parse_locations(loc, spans, sizes, ["i"], window=3).collect()]
    assert sorted(got) == [(1, i) for i in range(1, 21)] + [(3, i) for i in range(16, 21)]


def test_poisson_interval_of_two_values(spark):
    rows = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0)], "arm string, u long, v double")
    r = T.bootstrap_ci(rows, ["arm"], "u", "v", 500, "poisson").first()
    assert (r.lo, r.hi) == (0.0, 1.0)
