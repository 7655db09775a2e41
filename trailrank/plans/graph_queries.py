"""Queries over edges, statements and spectra."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailrank.functions.columns import tokens
from trailrank.functions.ordered import frozen
from trailrank.operators import graph as G
from trailrank.operators import joins as J
from trailrank.operators import metrics as M
from trailrank.operators import rank as R
from trailrank.operators import sets as S
from trailrank.plans import bindings as B
from trailrank.plans.bindings import bfs_sql
from trailrank.plans.metric_queries import I, IL, L, fused_cut, vote_cut
from trailrank.plans.parse_queries import R_, run_cov, run_gold, runs
from trailrank.plans.registry import cte, query

GR = ["grp"]
cte("bfs3", bfs_sql("both_ways", "seeds_p", 3), "both_ways", "seeds_p")
cte("bfs2f", bfs_sql("edges", "seeds_p", 2), "edges", "seeds_p")


@query("f2_slice_distance", "SELECT grp, node, hops FROM bfs3", "bfs3")
def f2(spark, sf):
    return G.slice_distance(B.part_seeds(spark, sf), B.part_edges(spark, sf), GR)


CAPPED = """SELECT grp, node FROM bfs3 JOIN (SELECT grp, coalesce(min(hops) FILTER (hops>=1 AND t>=15), 3) AS stop FROM (SELECT grp, hops, sum(count(*)) OVER (PARTITION BY grp ORDER BY hops) AS t FROM bfs3 GROUP BY grp, hops) GROUP BY grp) USING (grp) WHERE hops<=stop"""


@query("f1_dataflow_slice", CAPPED, "bfs3")
def f1(spark, sf):
    return G.dataflow_slice(B.part_seeds(spark, sf), B.part_edges(spark, sf), GR, "both", 3, 15)


@query("f1_dataflow_slice_forward", "SELECT grp, node FROM bfs2f", "bfs2f")
def f1f(spark, sf):
    return G.slice_distance(B.part_seeds(spark, sf), B.part_edges(spark, sf), GR, None, 2, "forward").select("grp", "node")


cte("pmass", "SELECT p_brand AS grp, p_partkey AS line, (1+p_size%3)::DOUBLE AS mass FROM part WHERE p_size<=5")
cte("bfs1", bfs_sql("both_ways", "seeds_p", 1), "both_ways", "seeds_p")


@query("f4_expand_candidates", """SELECT grp, line, mass, false AS added FROM pmass UNION ALL SELECT b.grp, b.node, m*1e-3, true FROM bfs1 b JOIN (SELECT grp, min(mass) AS m FROM pmass GROUP BY ALL) USING (grp) JOIN part ON p_partkey=b.node
 WHERE hops=1 AND p_size<=40""", "bfs1", "pmass")
def f4(spark, sf):
    part = B.table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("line"), "p_size")
    voted = part.filter("p_size <= 5").select("grp", "line", (1 + F.col("p_size") % 3).cast("double").alias("mass"))
    spans = part.select("grp", F.col("line").alias("stmt"), F.col("line").alias("end"))
    return G.expand_candidates(voted, B.part_edges(spark, sf), spans, part.filter("p_size <= 40"), GR)


GROWN = """SELECT grp, node, hops FROM bfs3 JOIN (SELECT grp, coalesce(min(hops) FILTER (hops>=1 AND t>=s+25), 3) AS stop FROM (SELECT grp, hops, sum(count(*)) OVER (PARTITION BY grp ORDER BY hops) AS t,
 first_value(count(*)) OVER (PARTITION BY grp ORDER BY hops) AS s FROM bfs3 GROUP BY grp, hops) GROUP BY grp) USING (grp) WHERE hops<=stop"""
cte("grown", GROWN, "bfs3")


@query("f4_expand_candidates_capped", """SELECT grp, line, mass, false AS added FROM pmass UNION ALL SELECT b.grp, b.node, m*1e-3, true FROM grown b JOIN (SELECT grp, min(mass) AS m FROM pmass GROUP BY ALL) USING (grp) JOIN part ON p_partkey=b.node
 WHERE hops>=1 AND p_size<=40""", "grown", "pmass")
def f4c(spark, sf):
    part = B.table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("line"), "p_size")
    voted = part.filter("p_size <= 5").select("grp", "line", (1 + F.col("p_size") % 3).cast("double").alias("mass"))
    spans = part.select("grp", F.col("line").alias("stmt"), F.col("line").alias("end"))
    return G.expand_candidates(voted, B.part_edges(spark, sf), spans, part.filter("p_size <= 40"), GR, 3, 25)


@query("f5_callgraph_khop", """SELECT b.grp, b.node AS line, b.hops FROM bfs2f b WHERE b.node IN (SELECT l_partkey FROM lineitem WHERE l_linestatus='F' AND l_returnflag='R')""", "bfs2f")
def f5(spark, sf):
    part = B.table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("node"))
    executed = B.table(spark, sf, "lineitem").filter("l_linestatus = 'F' and l_returnflag = 'R'").select(F.col("l_partkey").alias("node")).distinct().join(part, "node")
    lines = part.withColumn("line", F.col("node"))
    return G.callgraph_khop(B.part_seeds(spark, sf), B.part_edges(spark, sf), lines, executed.withColumnRenamed("node", "line"), GR, 2)


cte("named_calls", """SELECT DISTINCT grp, src, p.p_partkey AS dst FROM (SELECT DISTINCT grp, src, b.p_name||'_'||(dst//128) AS callee FROM edges JOIN part b ON b.p_partkey=dst) c JOIN part p ON p.p_brand=c.grp AND p.p_name||'_'||(p.p_partkey//128)=c.callee WHERE src<>p.p_partkey""", "edges")
cte("callreach", bfs_sql("named_calls", "seeds_p", 2), "named_calls", "seeds_p")


def named_calls(spark, sf):
    """Calls by name and the functions that have the names."""
    funcs = B.table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("func_id"),
                                              F.concat("p_name", F.lit("_"), F.floor(F.col("p_partkey") / 128).cast("string")).alias("name"))
    calls = B.part_edges(spark, sf).join(funcs.select("grp", F.col("func_id").alias("dst"), F.col("name").alias("callee")), ["grp", "dst"])
    return calls.select("grp", F.col("src").alias("caller"), "callee"), funcs


@query("f5_call_reach", "SELECT grp, node, hops FROM callreach", "callreach")
def f5r(spark, sf):
    return G.call_reach(B.part_seeds(spark, sf), J.call_links(*named_calls(spark, sf), GR), GR, 2)


cte("allreach", bfs_sql("all_ways", "seeds_p", 2), "all_ways", "seeds_p")
cte("pgold", "SELECT p_brand AS grp, p_partkey AS node FROM part WHERE p_size BETWEEN 5 AND 8")


@query("f6_crossfile_bfs", """SELECT k, count(*) AS n, round(100*avg((hits=n_gold)::INT),6) AS superset, round(avg(size),6) AS loc, sum(missed)::BIGINT AS missed, sum(reached)::BIGINT AS reached FROM
 (SELECT grp, k, count(*) FILTER (hops<=k OR base) AS size, count(*) FILTER (g) AS n_gold, count(*) FILTER (g AND (hops<=k OR base)) AS hits, count(*) FILTER (g AND NOT base) AS missed, count(*) FILTER (g AND NOT base AND hops<=k) AS reached FROM
  (SELECT grp, node, coalesce(hops,99) AS hops, b.node IS NOT NULL AS base, g.node IS NOT NULL AS g FROM allreach FULL JOIN (SELECT * FROM seeds_p) b USING (grp, node) FULL JOIN pgold g USING (grp, node)), (VALUES (0),(1),(2)) t(k) GROUP BY ALL) WHERE n_gold>0 GROUP BY k""", "allreach", "seeds_p", "pgold")
def f6(spark, sf):
    seeds = B.part_seeds(spark, sf)
    reach = G.slice_distance(seeds, B.part_edges(spark, sf, None), GR, [], 2)
    part = B.table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("line"), "p_size")
    return G.bfs_gain(reach.withColumnRenamed("node", "line"), seeds.withColumnRenamed("node", "line"), part.filter("p_size between 5 and 8"), GR, L, 2)


@query("f6_limit_files", """SELECT p_brand AS grp, file, known, n_exec, pos FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY known DESC, n_exec DESC, file) AS pos FROM
 (SELECT p_brand, p_partkey AS file, (p_size<=5)::INT AS known, count(*) AS n_exec FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY ALL)) WHERE pos<=20""")
def f6l(spark, sf):
    n = B.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.count(F.lit(1)).alias("n_exec"))
    part = B.table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("grp"), (F.col("p_size") <= 5).cast("int").alias("known"))
    return G.limit_files(n.join(part, "file"), GR, 20)


def line_vars(spark, sf):
    """Statements of a document: the first token in name order is defined, the others are used."""
    t = B.lines(spark, sf).select("doc_id", F.col("line_no").alias("line"), F.array_sort(tokens(F.col("text"))).alias("t")).filter("size(t) > 1")
    return t.select("doc_id", "line", F.slice("t", 1, 1).alias("defs"), F.slice("t", 2, F.size("t")).alias("uses"))


cte("lvar", f"SELECT doc_id, line_no AS line, t[1] AS d, t[2:] AS u FROM (SELECT doc_id, line_no, list_sort({B.tokens_sql('text')}) AS t FROM lines) WHERE len(t)>1", "lines")
cte("lseed", "SELECT doc_id, max(line) AS line FROM lvar GROUP BY ALL", "lvar")
F7 = """SELECT doc_id, line FROM (WITH RECURSIVE uses AS (SELECT doc_id, line, unnest(u) AS v FROM lrun), link AS (SELECT u.doc_id, u.line AS at, max(l.line) AS def FROM uses u JOIN lrun l ON l.doc_id=u.doc_id AND l.d=u.v AND l.line<u.line GROUP BY u.doc_id, u.line, u.v),
 start AS (SELECT s.doc_id, max(l.line) AS line FROM lseed s JOIN (SELECT doc_id, line, unnest(u) AS v FROM lvar) u ON u.doc_id=s.doc_id AND u.line=s.line JOIN lrun l ON l.doc_id=s.doc_id AND l.d=u.v GROUP BY s.doc_id, u.v),
 sl AS (SELECT doc_id, line FROM start UNION SELECT k.doc_id, k.def FROM sl JOIN link k ON k.doc_id=sl.doc_id AND k.at=sl.line)
 SELECT doc_id, line FROM sl UNION SELECT doc_id, line FROM lseed SEMI JOIN lrun USING (doc_id, line))"""
cte("lrun_all", "SELECT * FROM lvar", "lvar")
cte("lrun_part", "SELECT * FROM lvar ANTI JOIN lseed USING (doc_id, line) WHERE line%5<>0", "lvar", "lseed")


@query("f7_backward_slice", F7.replace("lrun", "lrun_all"), "lvar", "lseed", "lrun_all")
def f7(spark, sf):
    rows = frozen(line_vars(spark, sf))
    return G.backward_slice(rows, rows.groupBy("doc_id").agg(F.max("line").alias("line")), ["doc_id"])


@query("f7_backward_slice_unexecuted", F7.replace("lrun", "lrun_part"), "lvar", "lseed", "lrun_part")
def f7u(spark, sf):
    """Seeds, and every fifth line, were not executed: the slice starts from what the seeds use."""
    rows = frozen(line_vars(spark, sf))
    seeds = rows.groupBy("doc_id").agg(F.max("line").alias("line"))
    ran = rows.filter("line % 5 <> 0").join(seeds, ["doc_id", "line"], "left_anti")
    return G.backward_slice(ran, seeds, ["doc_id"], rows)


LADDER = """SELECT instance_id, line, min(step) AS step FROM (SELECT instance_id, line, 0 AS step FROM cut5 UNION ALL SELECT v.instance_id, v.line, 1 FROM vcut10 v SEMI JOIN executed e ON e.instance_id=v.instance_id AND e.line=v.line
 UNION ALL SELECT s.instance_id, s.line, 2 FROM (SELECT * FROM static WHERE score>=40) s SEMI JOIN executed e ON e.instance_id=s.instance_id AND e.line=s.line) GROUP BY ALL"""
cte("ladder", LADDER, "cut5", "vcut10", "static", "executed")


def ladder(spark, sf):
    steps = [("base", fused_cut(spark, sf, 5)), ("votes", vote_cut(spark, sf, 10)), ("scored", B.vote_static(spark, sf).filter("score >= 40"))]
    return G.expansion_ladder(steps, B.vote_executed(spark, sf), I, L)


@query("f8_expansion_ladder", "SELECT * FROM ladder", "ladder")
def f8(spark, sf):
    return ladder(spark, sf)


@query("f8_ladder_quality", """SELECT step, count(*) AS n, round(100*avg((coalesce(h,0)=n_gold)::INT),6) AS superset, round(avg(coalesce(c,0)),6) AS loc FROM (SELECT * FROM ng, (VALUES (0),(1),(2)) t(step)) LEFT JOIN
 (SELECT l.instance_id, t.step, count(*) AS c, count(g.line) AS h FROM ladder l JOIN (VALUES (0),(1),(2)) t(step) ON l.step<=t.step LEFT JOIN gold g ON g.instance_id=l.instance_id AND g.line=l.line GROUP BY ALL) USING (instance_id, step) GROUP BY step""", "ng", "ladder", "gold")
def f8q(spark, sf):
    return G.ladder_quality(ladder(spark, sf), B.vote_gold(spark, sf), I, L, 3)


cte("pexec", "SELECT DISTINCT p_brand AS grp, p_partkey AS node FROM lineitem JOIN part ON p_partkey=l_partkey WHERE l_linestatus='F' AND l_returnflag='R' AND l_quantity>=25")


@query("f9_dynamic_slice", """SELECT arm, count(*) AS n, round(100*avg((h>0)::INT),6) AS gold_hit, median(np) AS median_size, round(avg(np),6) AS mean_size, round(round(100*avg((h>0)::INT),6)/greatest(median(np),1),6) AS density FROM
 (SELECT arm, r.grp, count(*) AS np, count(g.node) AS h FROM (SELECT 'coverage' AS arm, grp, node FROM pexec UNION ALL SELECT 'static', grp, node FROM bfs1 UNION ALL SELECT 'dynamic', b.grp, b.node FROM bfs1 b SEMI JOIN pexec p ON p.grp=b.grp AND p.node=b.node) r
  LEFT JOIN pgold g ON g.grp=r.grp AND g.node=r.node GROUP BY ALL) GROUP BY arm""", "pexec", "bfs1", "pgold")
def f9(spark, sf):
    part = B.table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("node"), "p_size")
    cov = (B.table(spark, sf, "lineitem").filter("l_linestatus = 'F' and l_returnflag = 'R' and l_quantity >= 25").select(F.col("l_partkey").alias("node")).distinct().join(part.select("grp", "node"), "node"))
    static = G.slice_distance(B.part_seeds(spark, sf), B.part_edges(spark, sf), GR, None, 1)
    arms = {"coverage": cov, "static": static, "dynamic": S.pool_intersect(static, cov, ["grp", "node"])}
    rows = None
    for name, a in arms.items():
        a = a.select("grp", "node", F.lit(name).alias("arm"))
        rows = a if rows is None else rows.unionByName(a)
    return M.region_quality(rows, part.filter("p_size between 5 and 8"), ["node"], "grp")


# ---- as-of and call joins -----------------------------------------------------------------

@query("d6_asof_last_def", """SELECT DISTINCT l_orderkey, var, "at", def_at FROM (SELECT l_orderkey, var, "at", kind, last_value(CASE WHEN kind='def' THEN "at" END IGNORE NULLS) OVER (PARTITION BY l_orderkey, var ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS def_at FROM
 (SELECT l_orderkey, l_suppkey%10 AS var, CASE WHEN l_returnflag='R' THEN 'use' ELSE 'def' END AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS "at" FROM lineitem)) WHERE kind='use' AND def_at IS NOT NULL""")
def d6(spark, sf):
    rows = B.order_rows(spark, sf).select("l_orderkey", "at", (F.col("l_suppkey") % 10).alias("var"), F.when(F.col("l_returnflag") == "R", "use").otherwise("def").alias("kind"))
    return J.last_definition(rows, ["l_orderkey"], ["at"])


@query("d7_resolve_calls", "SELECT * FROM named_calls", "named_calls")
def d7(spark, sf):
    return J.resolve_calls(*named_calls(spark, sf), GR)


# ---- coverage joins and spectra -------------------------------------------------------------

@query("d2_coverage_semi", "SELECT instance_id, line, row_number() OVER (PARTITION BY instance_id ORDER BY pos) AS pos FROM fused SEMI JOIN executed USING (instance_id, line)", "fused", "executed")
def d2(spark, sf):
    return J.coverage_semi(B.fused(spark, sf).select("instance_id", "line", "pos"), B.vote_executed(spark, sf), I, L)


@query("d5_frontier_band", "SELECT user_id, day, file, line FROM rgold g WHERE EXISTS(FROM rcov c WHERE c.user_id=g.user_id AND c.day=g.day AND c.file=g.file AND abs(c.line-g.line)<=2)", "rgold", "rcov")
def d5(spark, sf):
    return J.frontier_band(run_gold(spark, sf), run_cov(spark, sf), [*R_, "file"])


@query("d5_frontier_sweep", "SELECT delta, count(*) AS n FROM rgold g, (VALUES (0),(1),(2),(5)) t(delta) WHERE EXISTS(FROM rcov c WHERE c.user_id=g.user_id AND c.day=g.day AND c.file=g.file AND abs(c.line-g.line)<=delta) GROUP BY ALL", "rgold", "rcov")
def d5s(spark, sf):
    hit = J.frontier_sweep(run_gold(spark, sf), run_cov(spark, sf), [*R_, "file"], [0, 1, 2, 5])
    return hit.groupBy("delta").agg(F.count(F.lit(1)).alias("n"))


@query("d11_missed_gold", "SELECT user_id, day, file, line FROM rgold EXCEPT SELECT user_id, day, file, line FROM rcov", "rgold", "rcov")
def d11(spark, sf):
    return S.pool_except(run_gold(spark, sf), run_cov(spark, sf), [*R_, "file", "line"])


@query("d11_overlap_counts", "SELECT (SELECT count(*) FROM rgold SEMI JOIN rcov USING (user_id, day, file, line)) AS both_sides, (SELECT count(*) FROM rgold) AS n_gold, (SELECT count(*) FROM rcov) AS n_cov", "rgold", "rcov")
def d11o(spark, sf):
    cols = [*R_, "file", "line"]
    rows = run_gold(spark, sf).withColumn("g", F.lit(1)).withColumn("c", F.lit(0)).unionByName(run_cov(spark, sf).withColumn("g", F.lit(0)).withColumn("c", F.lit(1)))
    per = rows.groupBy(*cols).agg(F.max("g").alias("g"), F.max("c").alias("c"))
    return per.agg(F.sum(F.col("g") * F.col("c")).alias("both_sides"), F.sum("g").alias("n_gold"), F.sum("c").alias("n_cov"))


@query("d14_recovered_by", """SELECT count(*) AS n_gold, count(*) FILTER (NOT a) AS missed, count(*) FILTER (NOT a AND b) AS by_executed, count(*) FILTER (NOT a AND c) AS by_votes, count(*) FILTER (NOT a AND NOT b AND NOT c) AS by_none,
 round(avg(a::INT),6) AS recall_base, round(avg((a OR b)::INT),6) AS recall_base_executed, round(avg((a OR b OR c)::INT),6) AS recall_base_executed_votes FROM (SELECT EXISTS(FROM cut5 x WHERE x.instance_id=g.instance_id AND x.line=g.line) AS a,
 EXISTS(FROM executed x WHERE x.instance_id=g.instance_id AND x.line=g.line) AS b, EXISTS(FROM vcut10 x WHERE x.instance_id=g.instance_id AND x.line=g.line) AS c FROM gold g)""", "cut5", "executed", "vcut10", "gold")
def d14(spark, sf):
    sources = {"base": fused_cut(spark, sf, 5), "executed": B.vote_executed(spark, sf), "votes": vote_cut(spark, sf, 10)}
    return J.recovered_by(B.vote_gold(spark, sf), sources, IL)


@query("d13_value_context", r"""SELECT user_id, day, line, string_agg("at"||' -> '||snap, chr(10) ORDER BY "at") AS "values" FROM (SELECT c.user_id, c.day, c.line, v."at", v.snap, row_number() OVER (PARTITION BY c.user_id, c.day, c.line ORDER BY v."at") AS r FROM
 (SELECT DISTINCT user_id, day, line FROM rn WHERE event_type='error') c JOIN (SELECT user_id, day, line AS "at", string_agg(var||'='||line, ', ' ORDER BY var) AS snap FROM (SELECT DISTINCT user_id, day, line, event_type AS var FROM rn) GROUP BY ALL) v
 ON v.user_id=c.user_id AND v.day=c.day AND abs(v."at"-c.line)<=8) WHERE r<=14 GROUP BY ALL""", "rn")
def d13(spark, sf):
    r = runs(spark, sf)
    values = r.groupBy(*R_, "line", F.col("event_type").alias("var")).agg(F.min(F.col("line").cast("string")).alias("repr"))
    return J.value_context(values, r.filter("event_type = 'error'"), R_)


def element_groups(spark, sf):
    r = runs(spark, sf)
    fails = r.groupBy(*R_).agg(F.max(F.col("event_type") == "error").alias("failing"))
    return run_cov(spark, sf), fails


cte("rfail", "SELECT user_id, day, bool_or(event_type='error') AS failing FROM rn GROUP BY ALL", "rn")


@query("e13_ochiai_binary", """SELECT user_id, line, ef, ep, round(CASE WHEN ef+ep>0 THEN ef/sqrt(ef+ep) ELSE 0 END,6)::DOUBLE AS susp FROM (SELECT user_id, line, max(failing::INT) AS ef, max((NOT failing)::INT) AS ep FROM rcov JOIN rfail USING (user_id, day) GROUP BY ALL)""", "rcov", "rfail")
def e13(spark, sf):
    cov, fails = element_groups(spark, sf)
    j = cov.join(fails, R_)
    s = R.ochiai_binary(j.filter("failing"), j.filter("not failing"), ["user_id", "line"])
    return s.withColumn("susp", F.round("susp", 6))


cte("och", """SELECT line, ef, ep, f-ef AS nf, p-ep AS np, CASE WHEN f*(ef+ep)>0 THEN ef/sqrt((f*(ef+ep))::DOUBLE) ELSE 0 END AS susp FROM (SELECT line, count(*) FILTER (failing) AS ef, count(*) FILTER (NOT failing) AS ep FROM rcov JOIN rfail USING (user_id, day) GROUP BY ALL),
 (SELECT count(*) FILTER (failing) AS f, count(*) FILTER (NOT failing) AS p FROM rfail)""", "rcov", "rfail")


@query("e14_ochiai_per_test", "SELECT line, ef, ep, nf, np, round(susp,6) AS susp FROM och", "och")
def e14(spark, sf):
    cov, fails = element_groups(spark, sf)
    return R.ochiai_per_test(cov, fails, ["line"], R_).withColumn("susp", F.round("susp", 6))


@query("e14_ochiai_suppliers", """SELECT line, ef, ep, nf, np, round(ef/sqrt((f*(ef+ep))::DOUBLE),6) AS susp FROM (SELECT line, ef, ep, f, f-ef AS nf, p-ep AS np FROM (SELECT line, count(*) FILTER (failing) AS ef, count(*) FILTER (NOT failing) AS ep FROM
 (SELECT DISTINCT l_orderkey, l_suppkey AS line FROM lineitem) JOIN (SELECT l_orderkey, bool_or(l_returnflag='R') AS failing FROM lineitem GROUP BY ALL) USING (l_orderkey) GROUP BY ALL),
 (SELECT count(*) FILTER (x) AS f, count(*) FILTER (NOT x) AS p FROM (SELECT bool_or(l_returnflag='R') AS x FROM lineitem GROUP BY l_orderkey)))""")
def e14s(spark, sf):
    li = B.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("line"), "l_returnflag")
    fails = li.groupBy("l_orderkey").agg(F.max(F.col("l_returnflag") == "R").alias("failing"))
    return R.ochiai_per_test(li.select("l_orderkey", "line").distinct(), fails, ["line"], ["l_orderkey"]).withColumn("susp", F.round("susp", 6))


cte("bin2", "SELECT s.*, CASE WHEN e.line IS NOT NULL THEN 1 ELSE 0 END AS ef, CASE WHEN e.line IS NULL THEN 0 WHEN p.line IS NOT NULL THEN 1/sqrt(2) ELSE 1 END AS susp FROM static s "
            "LEFT JOIN executed e USING (instance_id, line) LEFT JOIN passing p USING (instance_id, line)", "static", "executed", "passing")


@query("e15_sbfl_rank", "SELECT instance_id, line, row_number() OVER (PARTITION BY instance_id ORDER BY susp DESC, score DESC, line) AS pos FROM bin2", "bin2")
def e15(spark, sf):
    susp = R.ochiai_binary(B.vote_executed(spark, sf), B.vote_passing(spark, sf), IL)
    return R.sbfl_rank(B.vote_static(spark, sf), susp, I).select("instance_id", "line", "pos")


@query("e15_sbfl_filter_rank", "SELECT instance_id, line, row_number() OVER (PARTITION BY instance_id ORDER BY susp DESC, score DESC, line) AS pos FROM bin2 WHERE ef=1", "bin2")
def e15f(spark, sf):
    susp = R.ochiai_binary(B.vote_executed(spark, sf), B.vote_passing(spark, sf), IL)
    return R.sbfl_rank(B.vote_static(spark, sf), susp, I, failing_only=True).select("instance_id", "line", "pos")
