"""Queries over the vote binding: scoring, fusion, ordered cuts."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailrank.functions.columns import hash_order
from trailrank.functions.ordered import number_rows
from trailrank.operators import rank as R
from trailrank.plans import bindings as B
from trailrank.plans.bindings import HASH
from trailrank.plans.registry import cte, query

I = ["instance_id"]
L = ["line"]


@query("e8_vote_mass", "SELECT instance_id, line, mass, counts, first_seen FROM mass", "mass")
def e8(spark, sf):
    return B.vote_items(spark, sf).select("instance_id", "line", "mass", "counts", "first_seen")


@query("e8_vote_mass_in_region", """SELECT v.instance_id, v.line, round(sum(1.0::DOUBLE/(1+rank)),6) AS mass, count(DISTINCT sample) AS counts
FROM votes v SEMI JOIN executed e ON v.instance_id=e.instance_id AND v.line=e.line GROUP BY ALL""", "votes", "executed")
def e8_region(spark, sf):
    return R.vote_mass(B.votes(spark, sf), I, L, B.vote_executed(spark, sf)).drop("first_seen")


@query("e9_rrf_fuse", "SELECT instance_id, line, round(rrf,9) AS rrf, pos FROM fused", "fused")
def e9(spark, sf):
    return B.fused(spark, sf).select("instance_id", "line", F.round("rrf", 9).alias("rrf"), "pos")


@query("e9_rrf_grid", """SELECT k, instance_id, line, row_number() OVER (PARTITION BY instance_id, k ORDER BY
 1.0::DOUBLE/(k+r0)+1.0::DOUBLE/(k+r1)+1.0::DOUBLE/(k+r2) DESC, first_seen) AS pos FROM ranks3, (VALUES (1),(5),(20),(60)) t(k)""", "ranks3")
def e9_grid(spark, sf):
    g = R.rrf_grid(B.vote_items(spark, sf), I, [[F.desc("mass")], [F.desc("score")], [F.desc("counts")]], B.seen(), [1, 5, 20, 60], B.vote_slices(spark, sf))
    return g.select("k", "instance_id", "line", "pos")


@query("e10_rank_consensus", "SELECT instance_id, line, pos FROM arms WHERE arm='consensus'", "arms")
def e10(spark, sf):
    return R.rank_consensus(B.vote_items(spark, sf), I, "line", sliced=B.vote_slices(spark, sf)).select("instance_id", "line", "pos")


TIERED = f"""t AS (SELECT i.*, CASE WHEN f.line IS NOT NULL THEN 3 WHEN e.line IS NOT NULL THEN 2 ELSE 1 END AS tier FROM items i
 LEFT JOIN executed e USING (instance_id, line)
 LEFT JOIN (SELECT DISTINCT l_partkey AS instance_id, l_suppkey AS line FROM lineitem WHERE l_linestatus='F' AND l_returnflag='R') f USING (instance_id, line)),
r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY mass DESC, first_seen, {HASH}, line)-1 AS r0,
 row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, first_seen, {HASH}, line)-1 AS r1,
 row_number() OVER (PARTITION BY instance_id ORDER BY counts DESC, first_seen, {HASH}, line)-1 AS r2,
 row_number() OVER (PARTITION BY instance_id ORDER BY tier DESC, counts DESC, mass DESC, first_seen, {HASH}, line)-1 AS r3 FROM t)"""


@query("e11_rank_coverage_tier", f"""SELECT instance_id, line, tier, row_number() OVER (PARTITION BY instance_id ORDER BY rrf DESC, {HASH}, line) AS pos
 FROM (WITH {TIERED} SELECT *, 1.0::DOUBLE/(20+r0)+1.0::DOUBLE/(20+r1)+1.0::DOUBLE/(20+r2)+1.0::DOUBLE/(20+r3) AS rrf FROM r)""", "items", "executed")
def e11(spark, sf):
    src = B.vote_source(spark, sf)
    marks = src.groupBy("instance_id", "line").agg(
        F.max((F.col("l_linestatus") == "F").cast("int")).alias("executed"),
        F.max(((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).cast("int")).alias("on_frame"))
    items = B.vote_items(spark, sf).join(marks, ["instance_id", "line"])
    return R.rank_coverage_tier(items, I, "line", sliced=B.vote_slices(spark, sf)).select("instance_id", "line", "tier", "pos")


@query("e12_hash_tiebreak", f"SELECT s_suppkey AS line, {HASH.replace('line', 's_suppkey')} AS h FROM supplier")
def e12(spark, sf):
    return B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("line"), hash_order(F.col("s_suppkey")).alias("h"))


@query("e5_rank_lines", "SELECT * FROM (SELECT instance_id, line, score, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, line) AS pos FROM static) WHERE pos<=15", "static")
def e5(spark, sf):
    return R.rank_lines(B.vote_static(spark, sf), I, L, 15)


@query("e16_head_rerank", """SELECT instance_id, line, row_number() OVER (PARTITION BY instance_id ORDER BY pos>5, CASE WHEN pos<=5 THEN np END NULLS LAST, pos) AS pos
 FROM fused LEFT JOIN (SELECT instance_id, line, rank AS np FROM votes WHERE sample=1) USING (instance_id, line)""", "fused", "votes")
def e16(spark, sf):
    answer = B.votes(spark, sf).filter("sample = 1").select("instance_id", "line", F.col("rank").alias("new_pos"))
    return R.head_rerank(B.fused(spark, sf).select("instance_id", "line", "pos"), answer, I, L, 5)


@query("j10_random_head_control", f"""SELECT instance_id, line, row_number() OVER (PARTITION BY instance_id ORDER BY pos>10,
 CASE WHEN pos<=10 THEN {B.mix_sql('line', '7')} END NULLS LAST, pos) AS pos FROM fused""", "fused")
def j10(spark, sf):
    return R.shuffle_head(B.fused(spark, sf).select("instance_id", "line", "pos"), I, "line", 10, 7)


FILE_POS = "SELECT instance_id, line, s_nationkey AS file, row_number() OVER (PARTITION BY instance_id, s_nationkey ORDER BY score DESC, line) AS pos FROM static JOIN supplier ON s_suppkey=line"


def per_file(spark, sf):
    files = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("line"), F.col("s_nationkey").alias("file"))
    return number_rows(B.vote_static(spark, sf).join(files, "line"), ["instance_id", "file"], [F.desc("score"), F.asc("line")])


@query("e17_interleave", f"SELECT instance_id, file, line, row_number() OVER (PARTITION BY instance_id ORDER BY pos, file) AS pos FROM ({FILE_POS})", "static")
def e17(spark, sf):
    return R.interleave(per_file(spark, sf), I, "file", sliced=B.vote_slices(spark, sf)).select("instance_id", "file", "line", "pos")


@query("e17_interleave_distinct", """SELECT instance_id, line, row_number() OVER (PARTITION BY instance_id ORDER BY rank, sample) AS pos FROM
 (SELECT *, row_number() OVER (PARTITION BY instance_id, line ORDER BY rank, sample) AS d FROM votes) WHERE d=1""", "votes")
def e17d(spark, sf):
    lists = B.votes(spark, sf).withColumnRenamed("rank", "pos")
    return R.interleave_distinct(lists, I, L, "sample", B.vote_slices(spark, sf))


cte("adj", """SELECT instance_id, line, max(CASE WHEN d=0 THEN 2 ELSE 1 END) AS tier FROM
 (SELECT instance_id, line+d AS line, d FROM executed, range(-2,3) t(d)) GROUP BY ALL""", "executed")
cte("tiered", "SELECT i.*, coalesce(tier,0) AS tier FROM items i LEFT JOIN adj USING (instance_id, line)", "items", "adj")


def tiered_items(spark, sf):
    return R.adjacency_tier(B.vote_items(spark, sf), B.vote_executed(spark, sf), I)


@query("e18_soft_rank", """SELECT * FROM (SELECT instance_id, line, tier,
 row_number() OVER (PARTITION BY instance_id ORDER BY tier DESC, first_seen) AS pos FROM tiered) WHERE pos<=20""", "tiered")
def e18(spark, sf):
    return R.soft_rank(tiered_items(spark, sf), I, [F.desc("tier"), *B.seen()], 20).select("instance_id", "line", "tier", "pos")


@query("e19_top_executed", """SELECT * FROM (SELECT s.instance_id, s.line, s.score, row_number() OVER (PARTITION BY s.instance_id ORDER BY score DESC, s.line) AS pos
 FROM static s SEMI JOIN executed e ON s.instance_id=e.instance_id AND s.line=e.line) WHERE pos<=10""", "static", "executed")
def e19(spark, sf):
    return R.top_executed(B.vote_static(spark, sf), B.vote_executed(spark, sf), I, "line", 10)
