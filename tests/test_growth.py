"""Operators at sizes where a plain plan fails: long files, hubs, common names, many values; and the same results as plain code."""
import ast
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailrank.functions import columns as C
from trailrank.functions import ordered as O
from trailrank.operators import facts as A
from trailrank.operators import graph as G
from trailrank.operators import joins as J
from trailrank.operators import metrics as M
from trailrank.operators import parse as P
from trailrank.operators import rank as R
from trailrank.operators import stats as T
from trailrank.plans import bindings as B
from trailrank.sources import ingest


def test_a_text_is_split_once(spark):
    plan = spark.range(1).select(C.split_lines(F.lit("a\nb").cast("string")).alias("x"), F.col("id"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1


# ---- slices and traversals ------------------------------------------------------------------

def _slice(seeds, defs, uses, ran):
    needed, out = set(), {s for s in seeds if s in ran}
    for s in seeds:
        needed |= uses.get(s, set())
    for line in sorted(ran, reverse=True):
        if defs[line] & needed:
            out.add(line)
            needed = (needed - defs[line]) | uses[line]
    return out


def test_backward_slices(spark):
    draw, rows, seeds, want = random.Random(4), [], [], set()
    for f in range(12):
        n = draw.randrange(1, 60)
        names = "abcdefg"[:draw.randrange(2, 7)]
        defs = {i: set(draw.sample(names, draw.randrange(0, 2))) for i in range(1, n + 1)}
        uses = {i: set(draw.sample(names, draw.randrange(0, 3))) for i in range(1, n + 1)}
        ran = {i for i in defs if draw.random() < 0.7}
        asked = draw.sample(sorted(defs), min(n, draw.randrange(0, 3)))  # some were not executed
        rows += [(f, i, sorted(defs[i]), sorted(uses[i]), i in ran) for i in defs]
        seeds += [(f, s) for s in asked]
        want |= {(f, i) for i in _slice(asked, defs, uses, ran)} if asked else set()
    every = spark.createDataFrame(rows, "f int, line int, defs array<string>, uses array<string>, ran boolean").repartition(3)
    got = G.backward_slice(every.filter("ran").drop("ran"), spark.createDataFrame(seeds, "f int, line int"), ["f"], every.drop("ran"))
    assert {(r.f, r.line) for r in got.collect()} == want


def test_backward_slice_of_a_long_file(spark):
    """43,000 lines, each using what the line before defines."""
    n = 43_000
    lines = spark.range(1, n + 1).select(F.lit(1).alias("f"), F.col("id").alias("line"), F.array(F.concat(F.lit("v"), (F.col("id") % 977).cast("string"))).alias("defs"),
                                         F.array(F.concat(F.lit("v"), ((F.col("id") - 1) % 977).cast("string"))).alias("uses"))
    got = G.backward_slice(lines, spark.createDataFrame([(1, n)], "f int, line long"), ["f"])
    assert got.count() == n


def _levels(seeds, edges, depth, cap=None, extra=None):
    out, near = {}, defaultdict(set)
    for g, s, d in edges:
        near[g, s].add(d)
        near[g, d].add(s)
    for g in {g for g, _ in seeds}:
        dist = {n: 0 for h, n in seeds if h == g}
        front, first = set(dist), len(dist)
        for level in range(1, depth + 1):
            front = {d for n in front for d in near[g, n]} - set(dist)
            dist.update({n: level for n in front})
            if not front or len(dist) >= (cap if cap is not None else math.inf if extra is None else first + extra):
                break
        out.update({(g, n): h for n, h in dist.items()})
    return out


@pytest.mark.parametrize("hub", [G.HUB, 3])
@pytest.mark.parametrize("limit", [{}, {"cap": 9}, {"extra": 4}])
def test_traversals(spark, hub, limit):
    draw = random.Random(7)
    edges = {(g, draw.randrange(30), draw.randrange(30)) for g in range(4) for _ in range(40)} | {(0, 5, n) for n in range(100, 130)}
    seeds = {(g, draw.randrange(30)) for g in range(4) for _ in range(2)} | {(0, 5)}
    got = G.slice_distance(spark.createDataFrame(list(seeds), "g int, node int"), spark.createDataFrame(list(edges), "g int, src int, dst int"), ["g"], hub=hub, depth=4, **limit)
    assert {(r.g, r.node): r.hops for r in got.collect()} == _levels(seeds, edges, 4, **limit)


def test_a_star_spreads_over_tasks(spark):
    """The links of one node of a million, dealt over parts of about ``hub``."""
    n, hub = 1_000_000, 50_000
    edges = spark.range(n).select(F.lit(0).alias("g"), F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    graph, hubs = G.adjacency(edges, ["g"], "both", hub)
    sizes = [r["count"] for r in graph.filter("node = -1").groupBy("part").count().collect()]
    assert len(sizes) == n // hub and max(sizes) < 1.1 * hub and hubs.count() == 1
    reach = G.slice_distance(spark.createDataFrame([(0, 7)], "g int, node long"), edges, ["g"], depth=2, hub=hub)
    assert {r.hops: r["count"] for r in reach.groupBy("hops").count().collect()} == {0: 1, 1: 1, 2: n - 1}


def test_grown_groups_leave_the_frontier(spark):
    """Seeds + extra bounds the growth, not the size: a group with many seeds still grows."""
    chain = [(g, i, i + 1) for g in (1, 2) for i in range(60)]
    spans = spark.createDataFrame([(g, i, i) for g in (1, 2) for i in range(61)], "g int, stmt int, end int")
    voted = spark.createDataFrame([(1, 0, 2.0)] + [(2, i, 3.0) for i in range(0, 40)], "g int, line int, mass double")
    region = spans.select("g", F.col("stmt").alias("line"))
    out = G.expand_candidates(voted, spark.createDataFrame(chain, "g int, src int, dst int"), spans, region, ["g"], depth=50, extra=25)
    added = defaultdict(set)
    for r in out.filter("added").collect():
        added[r.g].add(r.line)
    assert added == {1: set(range(1, 26)), 2: set(range(40, 61))}


def test_a_common_name_costs_its_callers_and_functions(spark):
    n = 10_000
    calls = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("caller"), F.lit("__init__").alias("callee"))
    funcs = spark.range(n, 2 * n).select(F.lit(1).alias("g"), F.col("id").alias("func_id"), F.lit("__init__").alias("name"))
    links = J.call_links(calls, funcs, ["g"])
    assert links.count() == 2 * n
    reach = G.call_reach(spark.createDataFrame([(1, 3)], "g int, node long"), links, ["g"], 1)
    assert {r.hops: r["count"] for r in reach.groupBy("hops").count().collect()} == {0: 1, 1: n} and reach.schema["node"].dataType.simpleString() == "bigint"


# ---- resampling ------------------------------------------------------------------------------

def _binomial(n, p, u):
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p ** k * (1 - p) ** (n - k)
        if total > u:
            return k
    return n


def test_quantiles(spark):
    cases = [(n, p, u) for n in (0, 1, 2, 7, 60, 900) for p in (0.0, 0.01, 0.3, 0.5, 0.97, 1.0) for u in (1e-9, 0.02, 0.41, 0.5000001, 0.977, 1 - 1e-9)]
    rows = spark.createDataFrame(cases, "n long, p double, u double").select("n", "p", "u", C.binomial_quantile(F.col("n"), F.col("p"), F.col("u")).alias("k")).collect()
    assert {(r.n, r.p, r.u): r.k for r in rows} == {c: _binomial(*c) for c in cases}
    far = spark.createDataFrame([(4_000_000_000, 0.25)], "n long, u double").select(C.binomial_quantile(F.col("n"), F.lit(0.5), F.col("u")).alias("k")).first().k
    assert abs(far - (2e9 - 0.6744897501960817 * math.sqrt(1e9))) < 3


@pytest.mark.parametrize("method", ["multinomial", "poisson"])
@pytest.mark.parametrize("fan", [T.FAN, 3])
def test_resampled_intervals(spark, monkeypatch, method, fan):
    """The spread of the means is that of drawing rows, whether values are dealt to in one step or through blocks of blocks."""
    monkeypatch.setattr(T, "FAN", fan)
    draw = np.random.default_rng(3)
    values = np.round(draw.exponential(size=400), 1)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)] + [("one", 1, 2.5)], "arm string, u long, v double")
    means = {r.b: r.m for r in T.bootstrap_means(rows, ["arm"], "u", "v", 1500, method).filter("arm = 'a'").collect()}
    drawn = np.array([draw.choice(values, len(values)).mean() for _ in range(4000)])
    got = np.array(list(means.values()))
    assert len(means) == 1500 and abs(got.mean() - values.mean()) < 0.01 and abs(got.std() / drawn.std() - 1) < 0.08
    r = {x.arm: x for x in T.bootstrap_ci(rows, ["arm"], "u", "v", 1500, method).collect()}
    assert abs(r["a"].lo - np.quantile(drawn, 0.025)) < 0.025 and abs(r["a"].hi - np.quantile(drawn, 0.975)) < 0.025 and (r["one"].lo, r["one"].hi) == (2.5, 2.5)


def test_resampling_does_not_grow_with_rows(spark):
    """Twenty million rows of two values, three hundred replicates."""
    rows = spark.range(20_000_000).select(F.lit("a").alias("arm"), F.col("id").alias("u"), (F.col("id") % 4 == 0).cast("double").alias("v"))
    m = [r.m for r in T.bootstrap_means(rows, ["arm"], "u", "v", 300).collect()]
    assert len(m) == 300 and abs(np.std(m) / math.sqrt(0.25 * 0.75 / 20_000_000) - 1) < 0.15 and abs(np.mean(m) - 0.25) < 1e-4


def test_random_ties(spark):
    """Exact probabilities against drawn orders."""
    draw, items, gold = random.Random(5), [], []
    for g in range(6):
        items += [(g, i, draw.randrange(3)) for i in range(12)]
        gold += [(g, i) for i in draw.sample(range(12), 1 + g % 3)]
    gold += [(5, 99)]  # not among the items
    got = {}
    for primary in ("v", None):
        rows = T.random_tie_control(spark.createDataFrame(items, "g int, i int, v int"), spark.createDataFrame(gold, "g int, i int"), ["g"], "i", primary, [3, 6, 12])
        got |= {(primary, r.g, r.n_top): r.prob for r in rows.collect()}
    n = 4000
    for g in range(6):
        mine, want = [x for x in items if x[0] == g], {i for h, i in gold if h == g}
        for primary in ("v", None):
            inside = defaultdict(int)
            for _ in range(n):
                order = sorted(mine, key=lambda x: (-x[2] if primary else 0, draw.random()))
                for top in (3, 6, 12):
                    inside[top] += want <= {x[1] for x in order[:top]}
            for top in (3, 6, 12):
                assert abs(got[primary, g, top] - inside[top] / n) < 0.035


def _mix(item, seed):
    h = (item * C.HASH_FACTOR + seed * C.SEED_FACTOR) % C.HASH_RANGE
    h = ((h ^ (h >> 15)) * 1103515245 + 12345) % C.HASH_RANGE
    h = ((h ^ (h >> 13)) * 1664525 + 1013904223) % C.HASH_RANGE
    return h ^ (h >> 16)


def test_seeded_ties(spark):
    """Places of the gold items in the order of every seed, sorted one by one; null items and null groups hold nothing."""
    draw, rows = random.Random(6), []
    for g in [*range(7), None]:
        rows += [(g, i, draw.randrange(3), int(draw.random() < 0.2 or i == g)) for i in range(14)]
    rows += [(5, None, 2, 1), (6, None, 2, 0)]
    items = spark.createDataFrame(rows, "g int, i int, v int, gold int").repartition(3)
    for primary in ("v", None):
        want = {}
        for g in {r[0] for r in rows if r[3]}:
            mine = [r for r in rows if r[0] == g]
            for top in (3, 6, 12):
                held = 0
                for seed in range(9):
                    order = sorted(mine, key=lambda r: (-r[2] if primary else 0, C.HASH_RANGE if r[1] is None else _mix(r[1], seed)))
                    held += g is not None and all(r[1] is not None and order.index(r) < top for r in mine if r[3])
                want[g, top] = held / 9
        got = {(r.g, r.n_top): r.prob for r in T.seeded_tie_control(items, ["g"], "i", "gold", primary, [3, 6, 12], 9).collect()}
        assert got == want and any(0 < p < 1 for p in got.values())


@pytest.mark.parametrize("size", [(1 << 21, 1 << 14), (7, 4)])
def test_rows_are_drawn_one_by_one(spark, monkeypatch, size):
    """Every draw of every replicate, whether a replicate is drawn at once or in parts that meet many blocks; null values are not averaged."""
    monkeypatch.setattr(T, "DRAWS", size[0])
    monkeypatch.setattr(T, "BLOCK", size[1])
    draw = random.Random(7)
    table = {g: [None if draw.random() < 0.1 else round(draw.random(), 2) for _ in range(n)] for g, n in (("a", 45), ("b", 1), ("c", 600))}
    rows = spark.createDataFrame([(g, 3 * u, v) for g, vs in table.items() for u, v in enumerate(vs)], "arm string, u long, v double").repartition(4)
    got = {(r.arm, r.b): r.m for r in T.bootstrap_means(rows, ["arm"], "u", "v", 30, "rows").collect()}
    light = {(r.arm, r.b): r.m for r in T.bootstrap_means(rows, ["arm"], "u", "v", 30, "poisson_rows").collect()}
    for g, vs in table.items():
        for b in range(30):
            picked = [x for x in (vs[_mix(slot, b) % len(vs)] for slot in range(len(vs))) if x is not None]
            assert got[g, b] == (pytest.approx(np.mean(picked)) if picked else None)
            weights = [sum(_mix(3 * u, b) / C.HASH_RANGE >= s for s in T.POISSON_STEPS) for u in range(len(vs))]
            total = sum(weights)
            if all(v is not None for v in vs):
                assert light[g, b] == (pytest.approx(sum(w * v for w, v in zip(weights, vs)) / total) if total else None)


def test_votes_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """More votes are more tasks with the same ranks: what one task sorts does not grow with the table."""
    votes = spark.range(2000).selectExpr("id % 300 AS l_partkey", "CAST(id % 7 AS int) AS l_linenumber", "id % 11 AS l_suppkey", "CAST(id * 37 % 101 AS double) AS l_extendedprice",
                                         "CAST(id % 50 AS double) AS l_quantity", "CASE WHEN id % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag", "CASE WHEN id % 2 = 0 THEN 'O' ELSE 'F' END AS l_linestatus")
    votes.write.parquet(f"{tmp_path}/lineitem.parquet")
    few = sorted(map(tuple, B.arm_positions(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(B, "TASK_VOTES", 25)
    wide = B.arm_positions(spark, str(tmp_path))
    assert wide.rdd.getNumPartitions() == 80 and sorted(map(tuple, wide.collect())) == few


def test_windowed_sweep_over_given_tasks(spark):
    """Dilated cuts against plain sets; a null gold line is in none of them."""
    draw = random.Random(9)
    ranking = [(g, line, pos) for g in range(6) for pos, line in enumerate(draw.sample(range(1, 40), 12), 1)]
    gold = [(g, i) for g in range(6) for i in draw.sample(range(1, 40), 1 + g % 3)] + [(2, None)]
    got = M.sweep_curve(spark.createDataFrame(ranking, "instance_id int, line int, pos int"), spark.createDataFrame(gold, "instance_id int, line int"), ["line"], [1, 4, 10],
                        window=2, parts=5)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        near = {g: {x for h, line, pos in ranking if h == g and pos <= r.n_top for x in range(max(1, line - 2), line + 3)} for g in range(6)}
        held = [[i in near[g] for h, i in gold if h == g] for g in range(6)]
        assert (r.n, r.superset, r.any_hit) == (6, pytest.approx(100 * sum(map(all, held)) / 6, abs=1e-6), pytest.approx(100 * sum(map(any, held)) / 6, abs=1e-6))
        assert r["loc"] == pytest.approx(sum(map(len, near.values())) / 6, abs=1e-6)


@pytest.mark.parametrize("limit", ["2000000", "3"])
def test_medians(spark, limit):
    draw = random.Random(8)
    rows = [(g, draw.choice([None, *range(9), 2.5])) for g in range(5) for _ in range(g * 9 + 1)] + [(9, None)]
    spark.conf.set(O.MAX_GROUP_ROWS_CONF, limit)
    try:
        table = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "arm int, x double")
        got = {r.arm: (r.n, r.mean, r["median"]) for r in M.fixed_summary(table, ["arm"], "x").collect()}
    finally:
        spark.conf.unset(O.MAX_GROUP_ROWS_CONF)
    for g in {g for g, _ in rows}:
        v = [x for h, x in rows if h == g and x is not None]
        assert got[g] == ((len(v), pytest.approx(np.mean(v), abs=1e-6), np.median(v)) if v else (0, None, None))


# ---- paths, answers, labels --------------------------------------------------------------------

@pytest.mark.parametrize("mode", ["boundary", "suffix", "basename"])
def test_path_suffixes(spark, mode):
    draw = random.Random(9)
    some = ["/".join(draw.choice(["a", "b", "expr.py", "sym_expr.py", "ab"]) for _ in range(draw.randrange(1, 4))) for _ in range(60)]
    wanted, known = [(i % 3, p) for i, p in enumerate(some[:30])], [(i % 3, p, n) for n, (i, p) in enumerate(enumerate(some[30:]))]

    def meets(w, k):
        if mode == "boundary":
            return w == k or w.endswith("/" + k) or k.endswith("/" + w)
        return k.endswith(w) or w.endswith(k.split("/")[-1] if mode == "basename" else k)
    want = {}
    for g, w in wanted:
        fit = sorted((w != k, n, k) for h, k, n in known if h == g and meets(w, k))
        if fit:
            want[g, w] = fit[0][2]
    got = J.path_suffix_join(spark.createDataFrame(wanted, "g int, path string"), spark.createDataFrame(known, "g int, known string, file_ord int"), ["g"], mode)
    assert {(r.g, r.path): r.known for r in got.collect()} == want


def test_cosine_rank_by_either_join(spark, monkeypatch):
    draw = np.random.default_rng(2)
    files = spark.createDataFrame([(i % 2, i, draw.normal(size=4).tolist()) for i in range(50)], "g int, f int, embedding array<double>")
    queries = spark.createDataFrame([(g, draw.normal(size=4).tolist()) for g in range(2)], "g int, embedding array<double>")
    sent = R.cosine_rank(files, queries, ["g"], "f", top=5)
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(R, "QUERY_BYTES", 0)
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, R.cosine_rank(files, queries, ["g"], "f", top=5).collect()))


def test_facts_leave_in_chunks(spark, monkeypatch):
    text = "\n".join(f"def f{i}(a):\n    b = a\n    return b" for i in range(400))
    files = spark.createDataFrame([(i, text) for i in range(5)], "f int, text string").coalesce(1)
    whole = sorted(map(str, A.code_facts(files, ["f"]).collect()))
    monkeypatch.setattr(A, "FACTS", 97)
    assert sorted(map(str, A.code_facts(files, ["f"]).collect())) == whole and len(whole) > 4000


def test_facts_of_some_kinds():
    """Kinds that are not asked for are not made, and those that are come as among all."""
    text = ("import os\nfrom p import q\nclass A(B, c.D):\n    def m(self, *a, k=f(1)):\n        def inner():\n            return g.h(lambda: z())\n        return inner()\n"
            "try:\n    def t(x): pass\nexcept E:\n    async def u(): await v()\nmatch w:\n    case 1:\n        def y(): return [b() for i in j()]\n")
    whole = A.file_facts(text)
    assert [(f[1], f[6], f[8]) for f in whole if f[0] == "function"] == [("m", 0, ["f", "h", "inner", "z"]), ("t", 1, []), ("inner", 2, ["h", "z"]), ("u", 3, ["v"]), ("y", 4, ["b", "j"])]
    assert [f[1] for f in whole if f[0] == "function"] == [n.name for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    for kind in ("status", "class", "function", "header", "statement", "import"):
        assert A.file_facts(text, frozenset([kind])) == [f for f in whole if f[0] == kind] != []
    assert A.file_facts("def (", frozenset(["class"])) == [] and A.file_facts("def (")[0][:2] == ("status", "error")


def test_a_skeleton_parses_a_file_once(spark, tmp_path):
    """The outline reads facts that are written down; none of its plans holds the parser."""
    from trailrank.plans import source_queries
    spark.createDataFrame([(1, "a\nb", "en"), (2, "c", "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = source_queries.b12s(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan and "Scan parquet" in plan
    assert [tuple(r) for r in got.collect()] == [(1, "class C  [L4-7]\ndef f0(x, y)  [L9-12]  -> calls: f1\ndef f1(x, y)  [L14-17]\ndef C.m(self, a)  [L5-7]")]


def test_blocks_go_to_the_file_they_name(spark):
    files = spark.createDataFrame([(1, "a.py", "x\ny = 1\nz"), (1, "b.py", "y = 1\nq"), (2, "a.py", "y = 1")], "i int, file string, text string")
    block = "<<<<<<< SEARCH{}\n{}\n=======\nnew\n>>>>>>> REPLACE\n"
    answer = block.format(" file=a.py", "y = 1") + block.format(" file=gone.py", "y = 1") + block.format("", "y = 1") + block.format(" file= b.py ", "1: q")
    got = P.edit_blocks(spark.createDataFrame([(1, answer)], "i int, answer string"), files, ["i"], file="file").collect()
    assert sorted((r.i, r.file, r.block, r.start, r.end) for r in got) == [(1, "a.py", 0, 2, 2), (1, "a.py", 2, 2, 2), (1, "b.py", 2, 1, 1), (1, "b.py", 3, 2, 2)]


def test_path_lists(spark):
    said = {1: 'x ["a.py", 3, null, "b/c.txt"] ["z.py"]', 2: 'no list "a.py" "b" "c d.py"', 3: "[]", 4: None, 5: '["broken, "x.py"]', 6: '[1, {"a": "b.py"}, "k.py"] "no.py"'}
    got = defaultdict(list)
    for r in P.parse_path_list(spark.createDataFrame(list(said.items()), "i int, answer string"), ["i"]).orderBy("i", "rank").collect():
        got[r.i].append(r.path)
    assert got == {1: ["a.py", "b/c.txt"], 2: ["a.py", "c d.py"], 5: ["x.py"], 6: ["k.py"]}


def test_cut_listings_are_told(spark):
    trees = {1: '{"truncated": true, "tree": [{"path": "a.py", "type": "blob"}, {"path": "d.py", "type": "tree"}, {"path": "a.py", "type": "blob"}]}', 2: '{"truncated": true, "tree": []}', 3: "broken", 4: None}
    got = ingest.list_remote_tree(spark.createDataFrame(list(trees.items()), "i int, tree string"), ["i"]).collect()
    assert sorted((r.i, r.truncated, r.path or "") for r in got) == [(1, True, "a.py"), (2, True, ""), (3, False, ""), (4, False, "")]


def test_membership_changes(spark):
    old, new = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "i int, l string"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (5, "w")], "i int, l string")
    got = {r.i: (r.old_label, r.new_label, r.change) for r in M.label_flips(old, new, "i", "l").collect()}
    assert got == {2: ("x", "y", "flip"), 3: (None, "z", "added"), 4: ("y", None, "dropped"), 5: (None, "w", "added")}


def test_recall_given_found(spark):
    cols = "instance_id int, file string, line int"
    gold = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "c", 1)], cols)
    out = M.recall_given_found(spark.createDataFrame([(1, "a", 1), (1, "a", 9)], cols), gold, spark.createDataFrame([(1, "a"), (1, "z")], "instance_id int, file string"), ["line"])
    assert {r.instance_id: (r.recall, r.recall_given_found) for r in out.collect()} == {1: (0.333333, 0.5), 2: (0.0, 0.0)}
