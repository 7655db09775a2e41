"""Small cases with known answers."""
import math

import pytest
from pyspark.sql import functions as F

from trailrank.functions import columns as C
from trailrank.operators import classify as K
from trailrank.operators import facts as A
from trailrank.operators import graph as G
from trailrank.operators import joins as J
from trailrank.operators import metrics as M
from trailrank.operators import parse as P
from trailrank.operators import rank as R
from trailrank.operators import stats as T


def col(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def one(spark, expr, **lits):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in lits.items()]).select(expr.alias("x")).first().x


def test_sbfl_small(spark):
    def lines(xs):
        return spark.createDataFrame([(1, x) for x in xs], "i int, line int")
    susp = R.ochiai_binary(lines([10, 11, 12, 20]), lines([11, 12, 30]), ["i", "line"])
    cand = spark.createDataFrame([(1, 10, .1), (1, 11, .9), (1, 12, .2), (1, 20, .05), (1, 30, .5)], "i int, line int, score double")
    got = R.sbfl_rank(cand, susp, ["i"], failing_only=True).orderBy("pos")
    assert col(got, "line") == [10, 20, 11, 12]
    assert col(R.sbfl_rank(cand, susp, ["i"]).orderBy("pos"), "line") == [10, 20, 11, 12, 30]


@pytest.mark.parametrize("answer,want", [([3, 1], [3, 1, 2, 4, 5, 6, 7, 8, 9, 10]), ([], list(range(1, 11))), ([99], list(range(1, 11)))])
def test_head_rerank(spark, answer, want):
    ranking = spark.createDataFrame([(1, i, i) for i in range(1, 11)], "i int, line int, pos int")
    new = spark.createDataFrame([(1, a, n) for n, a in enumerate(answer)], "i int, line int, new_pos int")
    assert col(R.head_rerank(ranking, new, ["i"], ["line"], 5).orderBy("pos"), "line") == want


def test_shuffled_head_keeps_set_and_tail(spark):
    ranking = spark.createDataFrame([(1, i, i) for i in range(1, 21)], "i int, line int, pos int")
    got = col(R.shuffle_head(ranking, ["i"], "line", 8, 5).orderBy("pos"), "line")
    assert sorted(got[:8]) == list(range(1, 9)) and got[8:] == list(range(9, 21)) and got[:8] != list(range(1, 9))


def test_vote_mass_counts_any_number_of_samples(spark):
    votes = spark.createDataFrame([(1, s, 0, 5) for s in range(100)] + [(1, 70, 4, 5), (1, 10 ** 6, 1, 6)], "i int, sample int, rank int, line int")
    rows = {r.line: r for r in R.vote_mass(votes, ["i"], ["line"]).collect()}
    assert (rows[5].counts, rows[5].mass, rows[5].first_seen) == (100, 100.2, 0) and rows[6].counts == 1


def test_mcnemar_and_wilson(spark):
    p = one(spark, C.mcnemar_p(F.col("w"), F.col("l")), w=2, l=8)
    assert p == pytest.approx(0.109375) and one(spark, C.mcnemar_p(F.col("w"), F.col("l")), w=0, l=0) == 1.0
    big = one(spark, C.mcnemar_p(F.col("w"), F.col("l")), w=900, l=1100)
    assert big == pytest.approx(min(1, 2 * sum(math.comb(2000, i) for i in range(901)) / 2 ** 2000), rel=1e-9)
    far = one(spark, C.mcnemar_p(F.col("w"), F.col("l")), w=500_010_000, l=499_990_000)
    assert far == pytest.approx(math.erfc(2e4 / math.sqrt(1e9) / math.sqrt(2)), abs=1e-4)
    lo = one(spark, C.wilson_bound(F.col("k"), F.col("n"), -1), k=199, n=300)
    hi = one(spark, C.wilson_bound(F.col("k"), F.col("n"), 1), k=199, n=300)
    assert (round(lo, 1), round(hi, 1)) == (60.8, 71.4)


def diff(spark, text, mode="strict"):
    df = spark.createDataFrame([(1, text)], "i int, patch string")
    return sorted(col(P.diff_to_edit_lines(df, ["i"], mode=mode), "file", "line", "kind"))


HEAD = "--- a/x.py\n+++ b/x.py\n"


def test_diff_rules(spark):
    assert diff(spark, HEAD + "@@ -5,3 +5,2 @@\n a\n-b\n c") == [("x.py", 6, "deleted")]
    assert diff(spark, HEAD + "@@ -5,2 +5,3 @@\n a\n+b\n c") == [("x.py", 5, "anchor"), ("x.py", 6, "anchor")]
    assert diff(spark, "--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+a\n+b") == []
    dev = HEAD + "@@ -5,1 +5,0 @@\n-b\n--- a/gone.py\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-z"
    assert diff(spark, dev) == [("x.py", 1, "deleted"), ("x.py", 5, "deleted")]
    assert diff(spark, dev, "corrected") == [("gone.py", 1, "deleted"), ("x.py", 5, "deleted")]
    blank = HEAD + "@@ -1,3 +1,2 @@\n a\n\n-b"
    assert diff(spark, blank) == [("x.py", 2, "deleted")] and diff(spark, blank, "corrected") == [("x.py", 3, "deleted")]
    dashes = HEAD + "@@ -1,3 +1,1 @@\n---- old\n-b"
    assert diff(spark, dashes) == [("x.py", 1, "deleted")]
    assert diff(spark, dashes, "corrected") == [("x.py", 1, "deleted"), ("x.py", 2, "deleted")]


def test_clean_gold(spark):
    lines = spark.createDataFrame([(1, n, t) for n, t in enumerate(["x = 1", "   ", "# c", ")", "):  # x"], 1)], "i int, line int, text string")
    gold = spark.createDataFrame([(1, n) for n in range(1, 9)], "i int, line int")
    assert col(P.clean_gold(gold, lines, ["i", "line"]), "line") == [1]


@pytest.mark.parametrize("text,want", [("fooBar_baz", {"foo", "bar", "baz", "foobar_baz"}), ("HTTPServer2", {"httpserver2"}), ("ab", set()), ("", set())])
def test_tokens(spark, text, want):
    assert set(one(spark, C.tokens(F.col("t")), t=text)) == want


@pytest.mark.parametrize("text,want", [("[88, 89, 42, 88]", [88, 89, 42]), ("root cause: 3, 1", [3, 1]), ("none", []), ("[1, 2,] then 9", [1, 2, 9])])
def test_ranked_answers(spark, text, want):
    df = spark.createDataFrame([(1, text)], "i int, answer string")
    assert col(P.parse_ranked_answer(df, ["i"]).orderBy("rank"), "line") == want


def test_ranges(spark):
    df = spark.createDataFrame([(1, "[[9,7],[1,4000]]"), (2, "no digits")], "i int, answer string")
    got = P.parse_ranges(df, ["i"])
    assert sorted(col(got.filter("i = 1"), "line")) == [7, 8, 9] and col(got.filter("i = 2"), "parsed", "line") == [(False, None)]


def test_suffix_modes(spark):
    gold = spark.createDataFrame([(1, "a/sym_expr.py")], "i int, path string")
    cov = spark.createDataFrame([(1, "b/expr.py", 0), (1, "x/a/sym_expr.py", 1)], "i int, known string, file_ord int")
    assert col(J.path_suffix_join(gold, cov, ["i"]), "known") == ["x/a/sym_expr.py"]
    assert col(J.path_suffix_join(gold, cov, ["i"], "basename"), "known") == ["b/expr.py"]


SOURCE = '''class K(Base):
    def outer(self, a):
        def inner(b):
            return (b +
                    a)
        v = inner(a)
        return v
'''


def test_facts_nested_and_broken(spark):
    files = spark.createDataFrame([("k.py", SOURCE), ("bad.py", "def (:"), ("empty.py", "")], "path string, text string")
    f = A.code_facts(files, ["path"]).cache()
    assert dict(col(f.filter("kind = 'status'"), "path", "name")) == {"k.py": "ok", "bad.py": "error", "empty.py": "ok"}
    lines = spark.createDataFrame([("k.py", n) for n in range(1, 8)], "path string, line int")
    got = dict(col(J.line_in_function(lines, A.functions(f, ["path"]), ["path"]), "line", "name"))
    assert got == {1: None, 2: "outer", 3: "inner", 4: "inner", 5: "inner", 6: "outer", 7: "outer"}
    assert (4, 5) in col(A.statements(f, ["path"]), "stmt", "end") and (3, 5) in col(A.statements(f, ["path"]), "stmt", "end")
    links = J.last_definition(A.variable_events(f, ["path"]), ["path", "func"], ["stmt"])
    assert set(col(links.filter("var = 'v'"), "stmt", "def_stmt")) == {(7, 6)}
    assert set(col(A.functions(f, ["path"]), "name", "class_name")) == {("outer", "K"), ("inner", "K")}


def test_bfs_keeps_whole_level(spark):
    edges = spark.createDataFrame([(1, 0, n) for n in range(1, 9)] + [(1, 8, 20)], "g int, src int, dst int")
    seeds = spark.createDataFrame([(1, 0)], "g int, node int")
    assert G.dataflow_slice(seeds, edges, ["g"], "forward", 3, 4).count() == 9
    assert G.dataflow_slice(seeds, edges, ["g"], "forward", 3, 50).count() == 10
    assert dict(col(G.slice_distance(seeds, edges, ["g"]), "node", "hops"))[20] == 2


def test_backward_slice(spark):
    rows = [(1, 1, ["a"], []), (1, 2, ["b"], ["a"]), (1, 3, ["c"], []), (1, 4, ["d"], ["b"])]
    lines = spark.createDataFrame(rows, "f int, line int, defs array<string>, uses array<string>")
    seeds = spark.createDataFrame([(1, 4)], "f int, line int")
    assert sorted(col(G.backward_slice(lines, seeds, ["f"]), "line")) == [1, 2, 4]


def test_interleave_ragged(spark):
    rows = [(1, 0, "a1", 1), (1, 0, "a2", 2), (1, 0, "a3", 3), (1, 1, "b1", 1)]
    df = spark.createDataFrame(rows, "i int, file int, item string, pos int")
    assert col(R.interleave(df, ["i"], "file").orderBy("pos"), "item") == ["a1", "b1", "a2", "a3"]


def test_empty_cases(spark):
    gold = spark.createDataFrame([(1, 5), (2, 6)], "instance_id int, line int")
    ranking = spark.createDataFrame([(1, "x", 5, 2), (3, "x", 5, 1)], "instance_id int, arm string, line int, pos int")
    expected, keys = M.instance_arms(gold, ["x"]), ["instance_id", "arm"]
    first = M.first_gold(ranking, gold, keys, ["line"])
    assert sorted(col(M.hit_at_k(first, expected, keys, (1, 5)), "instance_id", "k", "hit")) == [(1, 1, 0), (1, 5, 1), (2, 1, 0), (2, 5, 0)]
    assert sorted(col(M.reciprocal_rank(first, expected, keys), "rr")) == [0.0, 0.5]
    assert sorted(col(M.exam(ranking, first, expected, keys), "exam")) == [1.0, 2.0]
    single = spark.createDataFrame([("a", 1, 0.25)], "arm string, u int, v double")
    r = T.bootstrap_ci(single, ["arm"], "u", "v", 40).first()
    assert (r.mean, r.lo, r.hi) == (0.25, 0.25, 0.25)


@pytest.mark.parametrize("method", ["multinomial", "poisson"])
def test_bootstrap_width(spark, method):
    n = 400
    df = spark.createDataFrame([("a", i, float(i % 4 == 0)) for i in range(n)], "arm string, u int, v double")
    r = T.bootstrap_ci(df, ["arm"], "u", "v", 1000, method).first()
    half = 1.96 * math.sqrt(0.25 * 0.75 / n)
    assert r.lo == pytest.approx(0.25 - half, abs=0.012) and r.hi == pytest.approx(0.25 + half, abs=0.012)


def test_patch_kind(spark):
    rows = [(1, 1, 0, "if a:"), (1, 2, 4, "return"), (2, 1, 0, "if a:"), (2, 2, 4, "return"), (2, 3, 4, "x = 1"), (3, 1, 0, "y = 2"),
            (4, 1, 4, "if a:"), (4, 2, 8, "return"), (4, 3, 0, "x = 1")]
    df = spark.createDataFrame(rows, "i int, ord int, indent int, text string")
    assert dict(col(K.patch_kind(spark.range(1, 6).selectExpr("cast(id as int) as i"), df, ["i"]), "i", "kind")) == {1: "DL", 2: "CF", 3: "DL", 4: "DL", 5: "DL"}


def test_holm_and_verdict(spark):
    t = spark.createDataFrame([("f", "a", .01), ("f", "b", .04), ("f", "c", .03)], "fam string, name string, p double")
    assert dict(col(T.holm_adjust(t, ["fam"], "name"), "name", "p_adj")) == {"a": .03, "b": .06, "c": .06}
    r = spark.createDataFrame([(80, True, .1, 12, .01), (80, False, -.1, 12, .4), (20, True, .1, 3, .01)], "n int, sig boolean, lo double, discordant int, p double")
    assert sorted(col(T.verdict(r), "verdict")) == ["AMBER", "GREEN", "RED"]


def test_edit_blocks_and_locations(spark):
    f = spark.createDataFrame([(1, "a\nb\nc\nb\n")], "i int, text string")
    a = spark.createDataFrame([(1, "<<<<<<< SEARCH\n2: b\n3: c\n=======\nz\n>>>>>>> REPLACE")], "i int, answer string")
    assert col(P.edit_blocks(a, f, ["i"]), "start", "end") == [(2, 3)]
    spans = spark.createDataFrame([(1, "f", 30, 32)], "i int, name string, start int, end int")
    loc = spark.createDataFrame([(1, "line: 12\nfunction: K.f"), (1, "line: 15-16")], "i int, loc string")
    got = sorted(col(P.parse_locations(loc, spans, spark.createDataFrame([(1, 400)], "i int, n_lines int"), ["i"], window=1), "line"))
    assert got == [11, 12, 13, 14, 15, 16, 17, 30, 31, 32]


def test_crash_context_tail(spark):
    assert one(spark, P.crash_context(F.col("t")), t="x" * 3000) == "x" * 1200
    assert one(spark, P.crash_context(F.col("t")), t="a\nTraceback (most recent call last):\nz").startswith("Traceback")
