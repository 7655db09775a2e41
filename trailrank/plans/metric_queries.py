"""Queries over the vote binding: metrics, sets, sweeps."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailrank.functions.ordered import number_rows
from trailrank.operators import metrics as M
from trailrank.operators import rank as R
from trailrank.operators import sets as S
from trailrank.plans import bindings as B
from trailrank.plans.bindings import ARMS
from trailrank.plans.registry import cte, query

I, L, IL = ["instance_id"], ["line"], ["instance_id", "line"]
IA = ["instance_id", "arm"]
KS = "(VALUES (1),(3),(5),(10)) t(k)"


def first(spark, sf):
    """First gold position of every arm of every instance with gold: every gold item has a vote, so all are there."""
    best = B.arm_positions(spark, sf).filter("gold = 1").groupBy("instance_id").agg(*[F.min(f"pos_{a}").alias(f"pos_{a}") for a in ARMS])
    return R.stack_arms(best, I, ARMS).withColumnRenamed("pos", "first")


def hits(spark, sf):
    return M.hit_at_k(first(spark, sf), None, IA)


def fused_cut(spark, sf, n):
    return B.fused(spark, sf).filter(F.col("pos") <= n).select("instance_id", "line", "pos")


def vote_cut(spark, sf, n):
    order = [F.desc("mass"), R.hash_order(F.col("line")), F.asc("line")]
    return R.first_k(B.vote_items(spark, sf), I, order, n).select("instance_id", "line", "pos")


cte("cut5", "SELECT instance_id, line, pos FROM fused WHERE pos<=5", "fused")
cte("cut10", "SELECT instance_id, line, pos FROM fused WHERE pos<=10", "fused")
cte("vcut10", "SELECT instance_id, line, pos FROM arms WHERE arm='vote_only' AND pos<=10", "arms")
cte("vcut5", "SELECT instance_id, line, pos FROM arms WHERE arm='vote_only' AND pos<=5", "arms")
cte("ng", "SELECT instance_id, count(*) AS n_gold FROM gold GROUP BY ALL", "gold")


@query("g1_hit_at_k", "SELECT arm, k, count(*) AS n, round(100*avg(hit),6) AS recall FROM hits GROUP BY ALL", "hits")
def g1(spark, sf):
    return M.recall_at_k(hits(spark, sf), ["arm"])


@query("g2_mrr", "SELECT arm, round(avg(coalesce(1.0::DOUBLE/first,0)),6) AS mrr FROM expected LEFT JOIN arm_first USING (instance_id, arm) GROUP BY ALL", "expected", "arm_first")
def g2(spark, sf):
    rr = M.reciprocal_rank(first(spark, sf), None, IA)
    return rr.groupBy("arm").agg(F.round(F.avg("rr"), 6).alias("mrr"))


@query("g3_exam", """SELECT arm, round(avg(coalesce(first::DOUBLE/n,1)),6) AS exam FROM expected LEFT JOIN arm_first USING (instance_id, arm)
 LEFT JOIN (SELECT instance_id, arm, count(*) AS n FROM arms GROUP BY ALL) USING (instance_id, arm) GROUP BY ALL""", "expected", "arm_first", "arms")
def g3(spark, sf):
    e = M.exam(B.arm_rankings(spark, sf), first(spark, sf), None, IA)
    return e.groupBy("arm").agg(F.round(F.avg("exam"), 6).alias("exam"))


@query("g4_set_prf", """SELECT instance_id, n_gold, n_pred, hits, round(r,6) AS recall, round(p,6) AS precision,
 round(CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0 END,6) AS f1 FROM (SELECT instance_id, n_gold, coalesce(np,0) AS n_pred, coalesce(h,0) AS hits,
 coalesce(h,0)::DOUBLE/n_gold AS r, CASE WHEN coalesce(np,0)>0 THEN coalesce(h,0)::DOUBLE/np ELSE 0 END AS p FROM ng LEFT JOIN
 (SELECT c.instance_id, count(*) AS np, count(g.line) AS h FROM cut10 c LEFT JOIN gold g USING (instance_id, line) GROUP BY ALL) USING (instance_id))""",
       "ng", "cut10", "gold")
def g4(spark, sf):
    gold = B.vote_gold(spark, sf)
    return M.set_prf(fused_cut(spark, sf, 10), gold, gold.select("instance_id").distinct(), I, L)


@query("g5_loose_metrics", """SELECT instance_id, round(hits::DOUBLE/n_gold,6) AS exact, round(hits::DOUBLE/5,6) AS precision, round(near::DOUBLE/n_gold,6) AS loose,
 round(hh::DOUBLE/nh,6) AS hunk_hit, round(fh::DOUBLE/nf,6) AS func_hit, round(5::DOUBLE/n_gold,6) AS "over" FROM
 (SELECT instance_id, count(*) AS n_gold, count(*) FILTER (exact) AS hits, count(*) FILTER (near) AS near, count(DISTINCT line//10) AS nh,
  count(DISTINCT line//10) FILTER (exact) AS hh, count(DISTINCT line//20) AS nf, count(DISTINCT line//20) FILTER (fn) AS fh
  FROM (SELECT g.*, EXISTS(FROM cut5 c WHERE c.instance_id=g.instance_id AND c.line=g.line) AS exact,
   EXISTS(FROM cut5 c WHERE c.instance_id=g.instance_id AND abs(c.line-g.line)<=2) AS near,
   EXISTS(FROM cut5 c WHERE c.instance_id=g.instance_id AND c.line//20=g.line//20) AS fn FROM gold g) GROUP BY ALL)""", "gold", "cut5")
def g5(spark, sf):
    gold = B.vote_gold(spark, sf)
    hunks = gold.withColumn("hunk", F.floor(F.col("line") / 10))
    spans = B.vote_static(spark, sf).select("instance_id", F.floor(F.col("line") / 20).alias("name"), "line")
    return M.loose_metrics(fused_cut(spark, sf, 5), gold, hunks, spans, I)


cte("loose5", """SELECT instance_id, round(hits::DOUBLE/n_gold,6) AS exact, round(hits::DOUBLE/5,6) AS precision, round(near::DOUBLE/n_gold,6) AS loose,
 round(hh::DOUBLE/nh,6) AS hunk_hit, round(fh::DOUBLE/nf,6) AS func_hit, round(5::DOUBLE/n_gold,6) AS "over" FROM
 (SELECT instance_id, count(*) AS n_gold, count(*) FILTER (exact) AS hits, count(*) FILTER (near) AS near, count(DISTINCT line//10) AS nh,
  count(DISTINCT line//10) FILTER (exact) AS hh, count(DISTINCT line//20) AS nf, count(DISTINCT line//20) FILTER (fn) AS fh
  FROM (SELECT g.*, EXISTS(FROM cut5 c WHERE c.instance_id=g.instance_id AND c.line=g.line) AS exact,
   EXISTS(FROM cut5 c WHERE c.instance_id=g.instance_id AND abs(c.line-g.line)<=2) AS near,
   EXISTS(FROM cut5 c WHERE c.instance_id=g.instance_id AND c.line//20=g.line//20) AS fn FROM gold g) GROUP BY ALL)""", "gold", "cut5")


@query("g5_loose_summary", """SELECT count(*) AS n, count(*) FILTER (NOT coalesce(ok, false)) AS parse_fail, round(avg(exact),6) AS mean_exact, round(avg(precision),6) AS mean_precision, round(avg(loose),6) AS mean_loose,
 round(avg(hunk_hit),6) AS mean_hunk_hit, round(avg(func_hit),6) AS mean_func_hit, round(avg("over"),6) AS mean_over FROM loose5 LEFT JOIN (SELECT instance_id, max(sample)>=3 AS ok FROM votes GROUP BY ALL) USING (instance_id)""", "loose5", "votes")
def g5s(spark, sf):
    """An instance's answer counts as parsed when a third sample was read."""
    parsed = B.votes(spark, sf).select("instance_id", (F.col("sample") >= 3).alias("parsed"))
    return M.loose_summary(g5(spark, sf), parsed, I)


FILES = "SELECT instance_id, file, row_number() OVER (PARTITION BY instance_id ORDER BY m DESC, file) AS pos FROM (SELECT instance_id, s_nationkey AS file, max(score) AS m FROM static JOIN supplier ON s_suppkey=line GROUP BY ALL)"


@query("g6_file_recall", f"""SELECT instance_id, round(count(pos)::DOUBLE/count(*),6) AS recall, (count(pos)=count(*))::INT AS all_found, coalesce(min(pos),0) AS hit_rank,
 coalesce(min(pos)<=1,false)::INT AS r1, coalesce(min(pos)<=5,false)::INT AS r5, coalesce(min(pos)<=10,false)::INT AS r10
 FROM (SELECT DISTINCT instance_id, s_nationkey AS file FROM gold JOIN supplier ON s_suppkey=line) LEFT JOIN (SELECT * FROM ({FILES}) WHERE pos<=10) USING (instance_id, file) GROUP BY ALL""",
       "gold", "static")
def g6(spark, sf):
    files = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("line"), F.col("s_nationkey").alias("file"))
    best = B.vote_static(spark, sf).join(files, "line").groupBy("instance_id", "file").agg(F.max("score").alias("score"))
    ranking = R.rank_lines(best, I, ["file"], 10)
    return M.file_recall(ranking, B.vote_gold(spark, sf).join(files, "line"))


@query("g7_ceilings", """SELECT count(*) AS n_groups, round(avg(r::DOUBLE/n),6) AS region_ceiling, round(avg(v::DOUBLE/n),6) AS voted_ceiling, round(sum(c)::DOUBLE/sum(n),6) AS covered_recall
 FROM (SELECT g.instance_id, count(*) AS n, count(e.line) AS r, count(v.line) AS v, count(p.line) AS c FROM gold g
 LEFT JOIN executed e USING (instance_id, line) LEFT JOIN (SELECT DISTINCT instance_id, line FROM votes WHERE rank<3) v USING (instance_id, line)
 LEFT JOIN passing p USING (instance_id, line) GROUP BY ALL)""", "gold", "executed", "votes", "passing")
def g7(spark, sf):
    voted = B.votes(spark, sf).filter("rank < 3")
    return M.ceilings(B.vote_executed(spark, sf), voted, B.vote_passing(spark, sf), B.vote_gold(spark, sf), I, L)


@query("g7_recall_given_found", """SELECT instance_id, count(*) AS n_gold, count(f.file) AS gold_in_found, count(p.line) AS hits, round(count(p.line)::DOUBLE/count(*),6) AS recall,
 round(CASE WHEN count(f.file)>0 THEN count(p.line)::DOUBLE/count(f.file) ELSE 0 END,6)::DOUBLE AS recall_given_found FROM (SELECT instance_id, line%10 AS file, line FROM gold) g
 LEFT JOIN (SELECT DISTINCT instance_id, line%10 AS file FROM votes WHERE rank<1) f USING (instance_id, file) LEFT JOIN (SELECT DISTINCT instance_id, line FROM votes WHERE rank<3 AND
  (instance_id, line%10) IN (SELECT instance_id, line%10 FROM votes WHERE rank<1)) p USING (instance_id, line) GROUP BY ALL""", "gold", "votes")
def g7f(spark, sf):
    """Files are last digits; a file is found when a first vote lies in it, and only found files' lines are predicted."""
    in_file = lambda df: df.select("instance_id", (F.col("line") % 10).alias("file"), "line")
    votes = B.votes(spark, sf).filter("rank < 3")
    found = in_file(votes.filter("rank < 1")).select("instance_id", "file").distinct()
    pred = in_file(votes).join(found, ["instance_id", "file"], "left_semi")
    return M.recall_given_found(pred, in_file(B.vote_gold(spark, sf)), found, ["line"])


@query("g8_superset_any", """SELECT instance_id, coalesce(h=n_gold,false)::INT AS superset, coalesce(h>0,false)::INT AS any_hit, coalesce(np,0) AS loc FROM ng LEFT JOIN
 (SELECT d.instance_id, count(*) AS np, count(g.line) AS h FROM (SELECT DISTINCT instance_id, unnest(range(greatest(1,line-1), least(n,line+1)+1)) AS line
  FROM cut10 JOIN (SELECT instance_id, max(line) AS n FROM static GROUP BY ALL) USING (instance_id)) d LEFT JOIN gold g USING (instance_id, line) GROUP BY ALL) USING (instance_id)""",
       "ng", "cut10", "static", "gold")
def g8(spark, sf):
    gold = B.vote_gold(spark, sf)
    length = B.vote_static(spark, sf).groupBy("instance_id").agg(F.max("line").alias("n"))
    wide = S.dilate(fused_cut(spark, sf, 10).join(length, "instance_id"), I, "line", 1, "n")
    return M.superset_any(wide, gold, gold.select("instance_id").distinct(), I, L)


@query("g9_per_sample_vs_merged", """WITH s AS (SELECT instance_id, sample, count(*) AS np, count(g.line) AS h FROM (SELECT * FROM votes WHERE rank<3) LEFT JOIN gold g USING (instance_id, line) GROUP BY ALL),
 a AS (SELECT instance_id, avg((h=n_gold)::INT) AS sup, avg((h>0)::INT) AS anyh, avg(np) AS loc FROM s JOIN ng USING (instance_id) GROUP BY ALL),
 b AS (SELECT instance_id, count(*) AS np, count(g.line) AS h FROM (SELECT DISTINCT instance_id, line FROM votes WHERE rank<3) LEFT JOIN gold g USING (instance_id, line) GROUP BY ALL)
 SELECT 'per_sample' AS view, count(*) AS n, round(100*avg(sup),6) AS superset, round(100*avg(anyh),6) AS any_hit, round(avg(loc),6) AS loc FROM a
 UNION ALL SELECT 'merged', count(*), round(100*avg(coalesce(h=n_gold,false)::INT),6), round(100*avg(coalesce(h>0,false)::INT),6), round(avg(coalesce(np,0)),6) FROM ng LEFT JOIN b USING (instance_id)""".replace("WITH s AS", "SELECT * FROM (WITH s AS", 1) + ")",
       "votes", "gold", "ng")
def g9(spark, sf):
    return M.per_sample_vs_merged(B.votes(spark, sf).filter("rank < 3"), B.vote_gold(spark, sf), L)


@query("g10_vote_threshold_curve", """SELECT t, round(avg(r),6) AS recall, round(avg(p),6) AS precision, round(avg(CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0 END),6) AS f1, round(avg(np),6) AS n_pred FROM
 (SELECT instance_id, t, coalesce(h,0)::DOUBLE/n_gold AS r, CASE WHEN coalesce(np,0)>0 THEN h::DOUBLE/np ELSE 0 END AS p, coalesce(np,0) AS np FROM (SELECT * FROM ng, (VALUES (1),(2),(3)) x(t)) LEFT JOIN
 (SELECT instance_id, t, count(*) AS np, count(g.line) AS h FROM mass JOIN (VALUES (1),(2),(3)) x(t) ON counts>=t LEFT JOIN gold g USING (instance_id, line) GROUP BY ALL) USING (instance_id, t)) GROUP BY ALL""",
       "ng", "mass", "gold")
def g10(spark, sf):
    return M.vote_threshold_curve(B.vote_items(spark, sf), B.vote_gold(spark, sf), L, [1, 2, 3])


@query("g11_region_quality", """SELECT arm, count(*) AS n, round(100*avg((h>0)::INT),6) AS gold_hit, median(np) AS median_size, round(avg(np),6) AS mean_size,
 round(round(100*avg((h>0)::INT),6)/greatest(median(np),1),6) AS density FROM (SELECT arm, r.instance_id, count(*) AS np, count(g.line) AS h FROM
 (SELECT 'executed' AS arm, * FROM executed UNION ALL SELECT 'top10', instance_id, line FROM cut10 UNION ALL
  SELECT 'both', instance_id, line FROM (SELECT * FROM executed SEMI JOIN cut10 USING (instance_id, line))) r LEFT JOIN gold g USING (instance_id, line) GROUP BY ALL) GROUP BY ALL""",
       "executed", "cut10", "gold")
def g11(spark, sf):
    ex, top = B.vote_executed(spark, sf), fused_cut(spark, sf, 10)
    parts = {"executed": ex, "top10": top, "both": S.pool_intersect(ex, top, IL)}
    regions = None
    for name, p in parts.items():
        p = p.select("instance_id", "line", F.lit(name).alias("arm"))
        regions = p if regions is None else regions.unionByName(p)
    return M.region_quality(regions, B.vote_gold(spark, sf), L)


@query("g12_prune_loss", """SELECT arm, count(*) AS n_gold, count(*) FILTER (NOT k) AS lost, round(avg((NOT k)::INT),6) AS loss_rate FROM
 (SELECT 'line' AS arm, EXISTS(FROM executed e WHERE e.instance_id=g.instance_id AND e.line=g.line) AS k FROM gold g UNION ALL
  SELECT 'function', EXISTS(FROM executed e WHERE e.instance_id=g.instance_id AND e.line//10=g.line//10) FROM gold g) GROUP BY ALL""", "gold", "executed")
def g12(spark, sf):
    base, ex = B.vote_items(spark, sf).select(*IL), B.vote_executed(spark, sf)
    spans = B.vote_static(spark, sf).select("instance_id", F.floor(F.col("line") / 10).alias("name"), "line")
    by_line = S.pool_intersect(base, ex, IL).withColumn("arm", F.lit("line"))
    by_func = M.executed_function_lines(base, spans, ex, I).withColumn("arm", F.lit("function"))
    return M.prune_loss(base, by_line.unionByName(by_func), B.vote_gold(spark, sf), L, ["line", "function"])


@query("g13_invariant_equal_sets", "SELECT instance_id, count(*) AS differing FROM (SELECT instance_id, line, count(DISTINCT arm) AS n FROM arms GROUP BY ALL) WHERE n<4 GROUP BY ALL", "arms")
def g13(spark, sf):
    return M.invariant_equal_sets(B.arm_rankings(spark, sf), ARMS, L)


@query("g13_zero_score_share", "SELECT round(avg((e.line IS NULL)::INT),6) AS zero_share, count(*) AS n FROM mass LEFT JOIN executed e USING (instance_id, line)", "mass", "executed")
def g13z(spark, sf):
    marked = B.vote_items(spark, sf).join(B.vote_executed(spark, sf).withColumn("_e", F.lit(1)), IL, "left")
    return marked.agg(F.round(F.avg(M.flag(F.col("_e").isNull())), 6).alias("zero_share"), F.count(F.lit(1)).alias("n"))


@query("g13_differing_sets", "SELECT instance_id, count(*) AS differing FROM (SELECT instance_id, line, count(DISTINCT arm) AS n FROM arms WHERE pos<=5 GROUP BY ALL) WHERE n<4 GROUP BY ALL", "arms")
def g13d(spark, sf):
    """Arms cut at five hold different sets."""
    return M.invariant_equal_sets(B.arm_rankings(spark, sf).filter("pos <= 5"), ARMS, L)


@query("i4_pool_health", """SELECT sample, count(*) AS n, count(*) FILTER (v.instance_id IS NULL) AS empty, round((count(*) FILTER (v.instance_id IS NULL))::DOUBLE/count(*),6) AS share,
 count(*) FILTER (v.instance_id IS NULL)<=0.1*count(*) AS healthy FROM (SELECT DISTINCT l_partkey AS instance_id, s.sample FROM lineitem, (SELECT DISTINCT l_linenumber AS sample FROM lineitem) s) e
 LEFT JOIN (SELECT DISTINCT instance_id, sample FROM votes) v USING (instance_id, sample) GROUP BY ALL""", "votes")
def g_health(spark, sf):
    """Every voted instance should have a pool in each of the seven samples."""
    votes = B.votes(spark, sf)
    expected = B.vote_source(spark, sf).select("instance_id").distinct().withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return M.pool_health(expected, votes, ["sample"])


@query("g14_coverage_stratum", """SELECT stratum, count(*) AS n, round(100*avg(h::DOUBLE/n_gold),6) AS gold_exec_rate, round(100*avg((h>0)::INT),6) AS any_gold_rate, median(ne) AS exec_median FROM
 (SELECT p_type AS stratum, n_gold, ne, coalesce(h,0) AS h FROM ng JOIN (SELECT instance_id, count(*) AS ne FROM executed GROUP BY ALL) USING (instance_id)
 LEFT JOIN (SELECT instance_id, count(*) AS h FROM gold SEMI JOIN executed USING (instance_id, line) GROUP BY ALL) USING (instance_id) JOIN part ON p_partkey=instance_id) GROUP BY ALL""",
       "ng", "executed", "gold")
def g14(spark, sf):
    strata = B.table(spark, sf, "part").select(F.col("p_partkey").alias("instance_id"), F.col("p_type").alias("stratum"))
    return M.coverage_stratum(B.vote_gold(spark, sf), B.vote_executed(spark, sf), strata, L)


@query("g15_stratified_table", """SELECT dimension, bucket, count(*) AS n, round(100*avg(hit),6) AS mean FROM (SELECT hit, p_type, p_brand, CASE WHEN p_size<=10 THEN 'small' WHEN p_size<=30 THEN 'medium' ELSE 'large' END AS size
 FROM hits JOIN part ON p_partkey=instance_id WHERE arm='fused' AND k=10), LATERAL (VALUES ('p_type',p_type),('p_brand',p_brand),('size',size)) d(dimension,bucket) GROUP BY ALL""", "hits")
def g15(spark, sf):
    part = B.table(spark, sf, "part").select(F.col("p_partkey").alias("instance_id"), "p_type", "p_brand",
                                             F.expr("CASE WHEN p_size<=10 THEN 'small' WHEN p_size<=30 THEN 'medium' ELSE 'large' END").alias("size"))
    fused = hits(spark, sf).filter("arm = 'fused' AND k = 10").join(part, "instance_id")
    return M.stratified_table(fused, ["p_type", "p_brand", "size"], "hit")


@query("g16_mix_counts", "SELECT source, lang, n, total, round(n::DOUBLE/total,6) AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) JOIN (SELECT source, count(*) AS total FROM documents GROUP BY ALL) USING (source)")
def g16(spark, sf):
    return M.mix_counts(B.table(spark, sf, "documents"), ["source"], "lang")


@query("g17_rate_by_role_category", """SELECT role, CASE WHEN grouping(category)=1 THEN 'total' ELSE category END AS category, count(*) AS n, count(*) FILTER (yes) AS yes, round(100.0*count(*) FILTER (yes)/count(*),6)::DOUBLE AS rate FROM
 (SELECT role, CASE WHEN contains(text, chr(10)) THEN 'multi' ELSE 'single' END AS category, contains(text, ',') AS yes FROM conversations WHERE length(text)>=100) GROUP BY role, ROLLUP(category)""")
def g17(spark, sf):
    c = B.table(spark, sf, "conversations")
    answers = c.select("role", F.when(F.contains("text", F.lit("\n")), "multi").otherwise("single").alias("category"),
                       F.when(F.contains("text", F.lit(",")), "YES").otherwise("NO").alias("ans"), (F.length("text") >= 100).alias("has_value"))
    return M.rate_by_role_category(answers)


GRID = [1, 2, 3, 5, 8, 10, 15, 25]
cte("grid", "SELECT unnest([1,2,3,5,8,10,15,25]) AS n_top")
cte("curve", """SELECT n_top, count(*) AS n, round(100*avg(coalesce(h=n_gold,false)::INT),6) AS superset, round(100*avg(coalesce(h>0,false)::INT),6) AS any_hit, round(avg(coalesce(np,0)),6) AS loc
 FROM (SELECT * FROM ng, grid) LEFT JOIN (SELECT f.instance_id, n_top, count(*) AS np, count(g.line) AS h FROM fused f JOIN grid ON pos<=n_top LEFT JOIN gold g USING (instance_id, line) GROUP BY ALL) USING (instance_id, n_top) GROUP BY ALL""",
    "ng", "grid", "fused", "gold")


def curve(spark, sf):
    return M.sweep_curve(B.fused(spark, sf), B.vote_gold(spark, sf), L, GRID)


@query("g18_sweep_curve", "SELECT * FROM curve", "curve")
def g18(spark, sf):
    return curve(spark, sf)


@query("g18_sweep_curve_window", """SELECT n_top, count(*) AS n, round(100*avg(coalesce(h=n_gold,false)::INT),6) AS superset, round(100*avg(coalesce(h>0,false)::INT),6) AS any_hit, round(avg(coalesce(np,0)),6) AS loc
 FROM (SELECT * FROM ng, grid) LEFT JOIN (SELECT w.instance_id, n_top, count(*) AS np, count(g.line) AS h FROM
 (SELECT DISTINCT instance_id, n_top, unnest(range(greatest(1,line-2), line+3)) AS line FROM fused JOIN grid ON pos<=n_top) w LEFT JOIN gold g USING (instance_id, line) GROUP BY ALL) USING (instance_id, n_top) GROUP BY ALL""",
       "ng", "grid", "fused", "gold")
def g18w(spark, sf):
    return M.sweep_curve(B.fused(spark, sf), B.vote_gold(spark, sf), L, GRID, window=2, parts=B.vote_parts(spark, sf))


cte("base5", "SELECT round(100*avg(coalesce(h=n_gold,false)::INT),6) AS base_superset, round(avg(coalesce(np,0)),6) AS base_loc FROM ng LEFT JOIN "
             "(SELECT c.instance_id, count(*) AS np, count(g.line) AS h FROM vcut5 c LEFT JOIN gold g USING (instance_id, line) GROUP BY ALL) USING (instance_id)", "ng", "vcut5", "gold")


def base5(spark, sf):
    gold = B.vote_gold(spark, sf)
    one = M.superset_any(vote_cut(spark, sf, 5), gold, gold.select("instance_id").distinct(), I, L)
    return M.summarize_sets(one.withColumn("g", F.lit(1)), ["g"])


@query("g19_matched_operating_point", "SELECT n_top, superset, any_hit, loc, base_loc, base_superset FROM curve, base5 ORDER BY abs(loc-base_loc), n_top LIMIT 1", "curve", "base5")
def g19(spark, sf):
    return M.matched_operating_point(curve(spark, sf), base5(spark, sf))


@query("g20_pareto_best", """SELECT n_top, superset, loc, round((superset-base_superset)+10*(base_loc-loc)/greatest(base_loc,1),6) AS gain FROM curve, base5
 WHERE superset>=base_superset AND loc<=base_loc AND (superset>base_superset OR loc<base_loc) ORDER BY gain DESC, n_top LIMIT 1""", "curve", "base5")
def g20(spark, sf):
    return M.pareto_best(curve(spark, sf), base5(spark, sf))


cte("rec", "SELECT arm, k, avg(hit) AS v FROM hits GROUP BY ALL", "hits")


@query("g21_ablation_delta", "SELECT r.arm, r.k, round(r.v,6) AS v, round(round(r.v,6)-round(f.v,6),6) AS delta FROM rec r JOIN rec f ON f.k=r.k AND f.arm='fused'", "rec")
def g21(spark, sf):
    rec = hits(spark, sf).groupBy("arm", "k").agg(F.round(F.avg("hit"), 6).alias("v"))
    return M.ablation_delta(rec, ["k"], "v", full="fused")


@query("g22_arm_table", """SELECT CASE arm WHEN 'vote_only' THEN 'Votes' WHEN 'fused' THEN 'Fusion' ELSE 'Consensus' END AS display,
 round(100*avg(hit) FILTER (k=1),6) AS "1", round(100*avg(hit) FILTER (k=5),6) AS "5", round(100*avg(hit) FILTER (k=10),6) AS "10" FROM hits WHERE arm<>'static_only' GROUP BY ALL""", "hits")
def g22(spark, sf):
    mapping = [("Votes", "main", "vote_only"), ("Fusion", "main", "fused"), ("Consensus", "main", "consensus")]
    return M.arm_table(hits(spark, sf).withColumn("run", F.lit("main")), mapping, "hit", [1, 5, 10])


@query("g23_best_setting", """SELECT arg_max(k, (value, -k)) AS best, max(value) AS best_value, coalesce(min(k) FILTER (value>=7), arg_max(k,(value,-k))) AS chosen,
 coalesce(arg_min(value, k) FILTER (value>=7), max(value)) AS chosen_value FROM (SELECT k, round(100*avg(coalesce(first<=1,false)::INT),6) AS value FROM
 (SELECT instance_id, k FROM ng, (VALUES (1),(5),(20),(60)) t(k)) LEFT JOIN (SELECT instance_id, k, min(pos) AS first FROM
 (SELECT k, instance_id, line, row_number() OVER (PARTITION BY instance_id, k ORDER BY 1.0::DOUBLE/(k+r0)+1.0::DOUBLE/(k+r1)+1.0::DOUBLE/(k+r2) DESC, first_seen) AS pos
  FROM ranks3, (VALUES (1),(5),(20),(60)) t(k)) JOIN gold USING (instance_id, line) GROUP BY ALL) USING (instance_id, k) GROUP BY k)""", "ng", "ranks3", "gold")
def g23(spark, sf):
    g = R.rrf_grid(B.vote_items(spark, sf), I, [[F.desc("mass")], [F.desc("score")], [F.desc("counts")]], B.seen(), [1, 5, 20, 60], B.vote_slices(spark, sf))
    gold = B.vote_gold(spark, sf)
    grid = gold.select("instance_id").distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 5, 20, 60)])))
    f = M.first_gold(g, gold, ["instance_id", "k"], L)
    at1 = grid.join(f, ["instance_id", "k"], "left").groupBy("k").agg(F.round(100 * F.avg(M.flag(F.col("first") <= 1)), 6).alias("value"))
    return M.best_setting(at1, "k", "value", 7.0)


@query("g24_promotions", """SELECT instance_id, rank_a, rank_b, kind, example FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY rank_a DESC, instance_id) AS example FROM
 (SELECT a.instance_id, a.first AS rank_a, b.first AS rank_b, CASE WHEN a.first>1 AND b.first=1 THEN 'to_top1' WHEN a.first>10 AND b.first<=10 THEN 'to_top10' END AS kind
 FROM arm_first a JOIN arm_first b USING (instance_id) WHERE a.arm='vote_only' AND b.arm='fused') WHERE kind IS NOT NULL) WHERE example<=6""", "arm_first")
def g24(spark, sf):
    f = first(spark, sf)
    moved = M.promotions(f.filter("arm = 'vote_only'"), f.filter("arm = 'fused'"))
    return M.examples(moved, ["kind"], [F.desc("rank_a"), F.asc("instance_id")], 6)


@query("g25_miss_recovery", """SELECT count(*) AS n, count(*) FILTER (a=0) AS missed, count(*) FILTER (a=0 AND b=1) AS recovered, round(100*avg(greatest(a,b)),6) AS union_ceiling
 FROM (SELECT instance_id, max(hit) FILTER (arm='static_only') AS a, max(hit) FILTER (arm='vote_only') AS b FROM hits WHERE k=10 GROUP BY ALL)""", "hits")
def g25(spark, sf):
    h = hits(spark, sf).filter("k = 10")
    return M.miss_recovery(h.filter("arm = 'static_only'"), h.filter("arm = 'vote_only'").withColumnRenamed("hit", "reached"))


@query("g26_recovery_audit", """SELECT count(*) AS miss_instances, count(*) FILTER (EXISTS(FROM vcut10 v WHERE v.instance_id=p.instance_id AND NOT EXISTS(FROM cut5 c WHERE c.instance_id=v.instance_id AND c.line=v.line))) AS with_additions,
 count(*) FILTER (t>0) AS touched, count(*) FILTER (t=m) AS flipped, count(*) FILTER (r=m) AS recoverable, count(*) FILTER (r=m AND t>0) AS recoverable_touched, count(*) FILTER (r=m AND t=m) AS recoverable_flipped
 FROM (SELECT instance_id, count(*) AS m, count(*) FILTER (EXISTS(FROM vcut10 v WHERE v.instance_id=g.instance_id AND v.line=g.line)) AS t,
  count(*) FILTER (EXISTS(FROM executed e WHERE e.instance_id=g.instance_id AND abs(e.line-g.line)<=2)) AS r
  FROM gold g ANTI JOIN cut5 c USING (instance_id, line) GROUP BY ALL) p""", "gold", "cut5", "vcut10", "executed")
def g26(spark, sf):
    near = (B.vote_executed(spark, sf).withColumn("line", F.explode(F.sequence(F.col("line") - 2, F.col("line") + 2))).distinct())
    return M.recovery_audit(B.vote_gold(spark, sf), fused_cut(spark, sf, 5), vote_cut(spark, sf, 10), near, IL)


@query("g27_label_flips", """SELECT doc_id, old_label, new_label, CASE WHEN old_label IS NULL THEN 'added' WHEN new_label IS NULL THEN 'dropped' ELSE 'flip' END AS change FROM
 (SELECT doc_id, max(quality) AS old_label FROM labels GROUP BY ALL) FULL JOIN (SELECT doc_id, (n_chars>=200)::INT AS new_label FROM documents WHERE lang<>'es') USING (doc_id) WHERE old_label IS DISTINCT FROM new_label""")
def g27(spark, sf):
    """The new labelling leaves the Spanish documents out and covers all others, labelled before or not."""
    new = B.table(spark, sf, "documents").filter("lang <> 'es'").select("doc_id", (F.col("n_chars") >= 200).cast("int").alias("quality"))
    return M.label_flips(B.table(spark, sf, "labels"), new, "doc_id", "quality")


@query("g27_relabel_summary", """SELECT count(*) AS n_total, count(*) FILTER (NOT err) AS n_ok, count(*) FILTER (err) AS n_err, count(*) FILTER (NOT err AND crash) AS crash_confirmed, count(*) FILTER (NOT err AND NOT crash) AS crash_denied,
 count(*) FILTER (NOT err AND new<>old) AS onpath_flips, count(*) FILTER (NOT err AND subset='good') AS n_good, count(*) FILTER (NOT err AND subset='bad') AS n_bad,
 count(*) FILTER (NOT err AND subset='good' AND (NOT crash OR new<>old)) AS changed_good, count(*) FILTER (NOT err AND subset='bad' AND (NOT crash OR new<>old)) AS changed_bad FROM
 (SELECT CASE WHEN quality=1 THEN 'good' ELSE 'bad' END AS subset, n_chars>=100 AS crash, quality=1 AS old, CASE WHEN lang<>'fr' THEN n_chars>=200 END AS new, coalesce(source='src3', false) AS err FROM labels JOIN documents USING (doc_id))""")
def g27s(spark, sf):
    j = B.table(spark, sf, "labels").join(B.table(spark, sf, "documents"), "doc_id")
    rows = j.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("subset"), (F.col("n_chars") >= 100).alias("crash"), (F.col("quality") == 1).alias("onpath_old"),
                    F.when(F.col("lang") != "fr", F.col("n_chars") >= 200).alias("onpath_new"), F.when(F.col("source") == "src3", "no run").alias("error"))
    return M.relabel_summary(rows, ["good", "bad"])


@query("g27_rule_disagreements", """SELECT stored, derived, count(*) AS n, stored IS NOT DISTINCT FROM derived AS agrees FROM (SELECT doc_id, CASE WHEN quality=1 THEN 'keep' WHEN toxic=1 THEN 'toxic' ELSE 'short' END AS stored FROM labels) s
 FULL JOIN (SELECT doc_id, CASE WHEN n_chars>=200 THEN 'keep' ELSE 'short' END AS derived FROM documents WHERE lang<>'es') d USING (doc_id) GROUP BY ALL""")
def g27r(spark, sf):
    stored = B.table(spark, sf, "labels").select("doc_id", F.expr("CASE WHEN quality=1 THEN 'keep' WHEN toxic=1 THEN 'toxic' ELSE 'short' END").alias("rule"))
    derived = B.table(spark, sf, "documents").filter("lang <> 'es'").select("doc_id", F.expr("CASE WHEN n_chars>=200 THEN 'keep' ELSE 'short' END").alias("rule"))
    return M.rule_disagreements(stored, derived, "doc_id")


@query("g28_fixed_dispersion", """SELECT arm, count(first) AS n, round(avg(first),6) AS mean, round(median(first),6) AS median FROM expected LEFT JOIN arm_first USING (instance_id, arm) GROUP BY ALL""", "expected", "arm_first")
def g28(spark, sf):
    return M.fixed_summary(first(spark, sf), ["arm"], "first")


@query("g29_overall_gold_drop", """SELECT element, count(*) AS n, round(avg(fd),6) AS drop_rate FROM (SELECT 'quality' AS element, (quality=0)::INT AS fd FROM labels UNION ALL
 SELECT 'toxic', (toxic=1)::INT FROM labels UNION ALL SELECT 'either', (quality=0 OR toxic=1)::INT FROM labels) GROUP BY ALL""")
def g29(spark, sf):
    def el(name, cond):
        return F.struct(F.lit(name).alias("element"), cond.cast("int").alias("false_drop"))
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    nested = F.array(F.array(el("quality", bad), el("toxic", toxic)), F.array(el("either", bad | toxic)))
    return M.overall_gold_drop(B.table(spark, sf, "labels").select(nested.alias("files")), "files")


# ---- caps, pools ----------------------------------------------------------------------

@query("h1_topk_per_group", "SELECT instance_id, sample, line, rank+1 AS pos FROM votes WHERE rank<3", "votes")
def h1(spark, sf):
    best = B.vote_source(spark, sf).groupBy("instance_id", "sample", "line").agg(F.max("l_extendedprice").alias("best"))
    return R.first_k(best, ["instance_id", "sample"], [F.desc("best"), F.asc("line")], 3).drop("best")


@query("h2_stable_order", "SELECT instance_id, line, row_number() OVER (PARTITION BY instance_id ORDER BY counts DESC, first_seen) AS pos FROM mass", "mass")
def h2(spark, sf):
    return number_rows(B.vote_items(spark, sf), I, [F.desc("counts"), *B.seen()]).select("instance_id", "line", "pos")


@query("h3_text_caps", "SELECT doc_id, text[1:5000] AS issue, text[1:1600] AS evidence, length(text) AS n FROM documents")
def h3(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 5000).alias("issue"),
                                                  F.substring("text", 1, 1600).alias("evidence"), F.length("text").alias("n"))


@query("i1_pool_union", "SELECT instance_id, line FROM cut5 UNION SELECT instance_id, line FROM vcut10 UNION SELECT instance_id, line FROM static WHERE score>=49", "cut5", "vcut10", "static")
def i1(spark, sf):
    return S.pool_union([fused_cut(spark, sf, 5), vote_cut(spark, sf, 10), B.vote_static(spark, sf).filter("score >= 49")], IL)


@query("i2_pool_intersect", """SELECT DISTINCT instance_id, line FROM (SELECT instance_id, line FROM cut5 UNION SELECT instance_id, line FROM vcut10) u
 WHERE EXISTS(FROM executed e WHERE e.instance_id=u.instance_id AND abs(e.line-u.line)<=2)""", "cut5", "vcut10", "executed")
def i2(spark, sf):
    pool = S.pool_union([fused_cut(spark, sf, 5), vote_cut(spark, sf, 10)], IL)
    frontier = B.vote_executed(spark, sf).withColumn("line", F.explode(F.sequence(F.col("line") - 2, F.col("line") + 2)))
    return S.pool_intersect(pool, frontier, IL)


@query("i3_pool_except", "SELECT instance_id, line FROM gold EXCEPT SELECT instance_id, line FROM cut10", "gold", "cut10")
def i3(spark, sf):
    return S.pool_except(B.vote_gold(spark, sf), fused_cut(spark, sf, 10), IL)


@query("i4_sample_merge", "SELECT instance_id, line, count(DISTINCT sample) AS n_samples FROM votes GROUP BY ALL", "votes")
def i4(spark, sf):
    return S.sample_merge(B.votes(spark, sf), IL)


# ---- pools ranked again ---------------------------------------------------------------

@query("e20_base_bonus_rank", """SELECT instance_id, line, row_number() OVER (PARTITION BY instance_id ORDER BY CASE WHEN c.line IS NOT NULL THEN 3*mx ELSE 0 END + score DESC, line) AS pos FROM
 (SELECT s.*, max(score) OVER (PARTITION BY instance_id) AS mx FROM static s) s LEFT JOIN cut5 c USING (instance_id, line)""", "static", "cut5")
def e20(spark, sf):
    base = fused_cut(spark, sf, 5).select(*IL, F.lit(1).alias("in_base"))
    pool = B.vote_static(spark, sf).join(base, IL, "left").fillna(0, ["in_base"])
    return R.base_bonus_rank(pool, I, L).select("instance_id", "line", "pos")


cte("pta_pool", """SELECT s.instance_id, s.line, s.score, (c.line IS NOT NULL)::INT AS in_base, coalesce(tier,0) AS tier FROM static s LEFT JOIN cut10 c USING (instance_id, line)
 LEFT JOIN adj USING (instance_id, line)""", "static", "cut10", "adj")


@query("e20_prune_then_add", """SELECT nb, kk AS k, instance_id, line FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, in_base ORDER BY CASE WHEN in_base=1 THEN tier ELSE score END DESC, line) AS pos FROM pta_pool),
 (VALUES (3),(6)) a(nb), (VALUES (0),(2),(4)) b(kk) WHERE (in_base=1 AND pos<=nb) OR (in_base=0 AND pos<=kk)""", "pta_pool")
def e20b(spark, sf):
    base = fused_cut(spark, sf, 10).select(*IL, F.lit(1).alias("in_base"))
    pool = B.vote_static(spark, sf).join(base, IL, "left").fillna(0, ["in_base"])
    pool = R.adjacency_tier(pool, B.vote_executed(spark, sf), I)
    return R.prune_then_add(pool, I, L, [3, 6], [0, 2, 4]).select("nb", "k", "instance_id", "line")


@query("e24_discovery_order", "SELECT instance_id, line, row_number() OVER (PARTITION BY instance_id ORDER BY first_seen, line) AS pos FROM mass", "mass")
def e24(spark, sf):
    found = B.votes(spark, sf).withColumnsRenamed({"sample": "round", "rank": "seq"})
    return R.discovery_order(found, I, L)


@query("e24_graph_order", """SELECT instance_id, line, row_number() OVER (PARTITION BY instance_id ORDER BY gp NULLS LAST, line) AS pos FROM mass
 LEFT JOIN (SELECT instance_id, line, pos AS gp FROM cut10) USING (instance_id, line)""", "mass", "cut10")
def e24g(spark, sf):
    graph = fused_cut(spark, sf, 10).withColumnRenamed("pos", "graph_pos")
    return R.graph_order(B.votes(spark, sf), graph, I, L).select("instance_id", "line", "pos")


@query("e25_oracle_union", "SELECT instance_id, k, max(hit) AS hit FROM hits GROUP BY ALL", "hits")
def e25(spark, sf):
    return M.oracle_union(hits(spark, sf), ["instance_id", "k"])


@query("m11_arm_metrics", "SELECT instance_id, arm, k, hit FROM hits", "hits")
def m11(spark, sf):
    return hits(spark, sf)
