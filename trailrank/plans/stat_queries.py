"""Queries over paired outcomes of the arms."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailrank.functions.ordered import frozen
from trailrank.operators import metrics as M
from trailrank.operators import stats as T
from trailrank.plans import bindings as B
from trailrank.plans.bindings import mix_sql
from trailrank.plans.metric_queries import I, L, first, hits
from trailrank.plans.registry import cte, query

REPLICATES = 500
LO, HI = int(0.025 * REPLICATES), int(0.975 * REPLICATES)
cte("reps", f"SELECT range AS b FROM range({REPLICATES})")
cte("pairs", """SELECT instance_id, k, max(hit) FILTER (arm='fused') AS a, max(hit) FILTER (arm='vote_only') AS b FROM hits GROUP BY ALL""", "hits")
cte("rr10", "SELECT instance_id, 'fused' AS arm, coalesce(1.0::DOUBLE/first,0) AS rr FROM ng LEFT JOIN (SELECT * FROM arm_first WHERE arm='fused') USING (instance_id)", "ng", "arm_first")


def drawn_sql(low: str, high: str, term: str, u: str) -> str:
    """Inverse transform: the least k from ``low`` to ``high`` whose running sum of ``term(k)`` passes ``u``."""
    terms = f"list_transform(range({low}, {high}+1), lambda k: {{'t': {term}, 's': 0.0::DOUBLE, 'c': 0::BIGINT}})"
    add = f"lambda a, x: {{'t': x.t, 's': a.s+x.t, 'c': a.c+(a.s+x.t<={u})::BIGINT}}"
    return f"({low}+list_reduce(list_prepend({{'t': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'c': 0::BIGINT}}, {terms}), {add}).c)"


def binomial_sql(n: str, p: str, u: str) -> str:
    spread = f"(sqrt({n}*{p}*(1-{p}))*12+12)"
    low, high = f"greatest(0, floor({n}*{p}-{spread}))::BIGINT", f"least({n}, ceil({n}*{p}+{spread}))::BIGINT"
    term = f"exp(lgamma({n}+1)-lgamma(k+1)-lgamma({n}-k+1)+k*ln({p})+({n}-k)*ln(1-{p}))"
    return f"CASE WHEN {n}=0 THEN 0 WHEN {p}>=1 THEN {n} ELSE least({n}, {drawn_sql(low, high, term, u)}) END"


def interval_sql(src: str, by: str, value: str, means: str) -> str:
    """Mean and percentile interval of ``src(by, value)`` from the resampled ``means(by, b, m)``."""
    return f"""SELECT {by}, n, mean, lo, hi, p_gt0 FROM (SELECT {by}, count(*) AS n, round(avg({value}),6) AS mean FROM {src} GROUP BY ALL) JOIN
 (SELECT {by}, round(max(m) FILTER (i={LO}),6) AS lo, round(max(m) FILTER (i={HI}),6) AS hi, round(avg((m>0)::INT),6) AS p_gt0 FROM
  (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY m)-1 AS i FROM ({means})) GROUP BY ALL) USING ({by})"""


def boot_sql(src: str, by: str, value: str) -> str:
    """Reference SQL of the multinomial bootstrap over ``src(by, instance_id, value)``: counts dealt to the distinct values in ascending order."""
    vals = f"SELECT {by}, {value}::DOUBLE AS v, count(*) AS w, row_number() OVER (PARTITION BY {by} ORDER BY {value})-1 AS i FROM {src} GROUP BY {by}, {value}"
    draw = binomial_sql("left_n", "(w::DOUBLE/left_w)", f"(({mix_sql('i', 'b')}+0.5)/4294967296.0::DOUBLE)")
    means = f"""WITH RECURSIVE vals AS ({vals}), walk AS (SELECT {by}, b, 0::BIGINT AS i, n, n AS left_n, n AS left_w, 0.0::DOUBLE AS s FROM (SELECT {by}, sum(w)::BIGINT AS n FROM vals GROUP BY {by}), reps
  UNION ALL SELECT {by}, b, i+1, n, left_n-c, left_w-w, s+c*v FROM (SELECT *, ({draw})::BIGINT AS c FROM walk JOIN vals USING ({by}, i)))
  SELECT {by}, b, s/n AS m FROM walk WHERE left_w=0"""
    return interval_sql(src, by, value, means)


def pairs(spark, sf):
    return T.pair_arms(hits(spark, sf), "fused", "vote_only", ["instance_id", "k"], "hit")


@query("d10_pair_arms", "SELECT * FROM pairs", "pairs")
def d10(spark, sf):
    return pairs(spark, sf)


@query("j1_bootstrap_ci", boot_sql("rr10", "arm", "rr"), "rr10", "reps")
def j1(spark, sf):
    rr = M.reciprocal_rank(first(spark, sf), None, ["instance_id", "arm"]).filter("arm = 'fused'")
    return T.bootstrap_ci(rr, ["arm"], "instance_id", "rr", REPLICATES)


POISSON = "+".join(f"(u>={s})::INT" for s in T.POISSON_STEPS)


@query("j1_bootstrap_ci_poisson", f"""SELECT arm, n, mean, lo, hi, p_gt0 FROM (SELECT arm, count(*) AS n, round(avg(rr),6) AS mean FROM rr10 GROUP BY ALL) JOIN
 (SELECT arm, round(max(m) FILTER (i={LO}),6) AS lo, round(max(m) FILTER (i={HI}),6) AS hi, round(avg((m>0)::INT),6) AS p_gt0 FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY m)-1 AS i FROM
 (SELECT arm, b, sum(w*rr)/sum(w) AS m FROM (SELECT arm, b, rr, {POISSON} AS w FROM (SELECT *, {mix_sql('instance_id', 'b')}/4294967296.0::DOUBLE AS u FROM rr10, reps)) GROUP BY ALL)) GROUP BY ALL) USING (arm)""", "rr10", "reps")
def j1p(spark, sf):
    rr = M.reciprocal_rank(first(spark, sf), None, ["instance_id", "arm"]).filter("arm = 'fused'")
    return T.bootstrap_ci(rr, ["arm"], "instance_id", "rr", REPLICATES, "poisson_rows")


cte("diffs", "SELECT k, instance_id, (a-b)::DOUBLE AS d FROM pairs", "pairs")
cte("paired", boot_sql("diffs", "k", "d"), "diffs", "reps")


@query("j2_paired_bootstrap", "SELECT *, ((lo>0 OR hi<0) AND n>1) AS sig FROM paired", "paired")
def j2(spark, sf):
    return T.paired_bootstrap(pairs(spark, sf), ["k"], "instance_id", REPLICATES)


def mc_sql(w: str, l: str) -> str:
    n = f"({w}+{l})"
    terms = f"list_transform(range(0, (least({w},{l})+1)::BIGINT), lambda i: exp(lgamma({n}+1)-lgamma(i+1)-lgamma({n}-i+1)-{n}*ln(2)))"
    return f"CASE WHEN {n}=0 THEN 1.0 ELSE least(1.0, 2*list_sum({terms})) END"


cte("mcn", f"SELECT k, wins, losses, wins+losses AS discordant, round({mc_sql('wins', 'losses')},6) AS p FROM "
           "(SELECT k, count(*) FILTER (a=1 AND b=0) AS wins, count(*) FILTER (a=0 AND b=1) AS losses FROM pairs GROUP BY ALL)", "pairs")


@query("j3_mcnemar_exact", "SELECT * FROM mcn", "mcn")
def j3(spark, sf):
    return T.mcnemar(pairs(spark, sf), ["k"])


@query("j4_wilson_interval", """SELECT source, k, n, round(100*(p+1.96*1.96/(2*n)-1.96*sqrt(p*(1-p)/n+1.96*1.96/(4.0*n*n)))/(1+1.96*1.96/n),6)::DOUBLE AS lo,
 round(100*(p+1.96*1.96/(2*n)+1.96*sqrt(p*(1-p)/n+1.96*1.96/(4.0*n*n)))/(1+1.96*1.96/n),6)::DOUBLE AS hi FROM
 (SELECT source, count(*) FILTER (quality=1) AS k, count(*) AS n, (count(*) FILTER (quality=1))::DOUBLE/count(*) AS p FROM labels JOIN documents USING (doc_id) GROUP BY ALL)""")
def j4(spark, sf):
    j = B.table(spark, sf, "labels").join(B.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    counts = j.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    return T.wilson(counts, "k", "n")


@query("j5_holm_adjust", """SELECT k, p, round(max(least(1.0,(m-r)*p)) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING),6) AS p_adj FROM
 (SELECT k, p, row_number() OVER (ORDER BY p, k)-1 AS r, count(*) OVER () AS m FROM mcn)""", "mcn")
def j5(spark, sf):
    tests = T.mcnemar(pairs(spark, sf), ["k"]).withColumn("family", F.lit("arms"))
    return T.holm_adjust(tests, ["family"], "k").select("k", "p", "p_adj")


SEEDS = 20
cte("seeds", f"SELECT range AS seed FROM range({SEEDS})")
cte("tieprob", f"""SELECT instance_id, n_top, coalesce(ok,0)/{SEEDS}.0::DOUBLE AS prob FROM (SELECT * FROM ng, (VALUES (5),(10)) t(n_top)) LEFT JOIN
 (SELECT instance_id, n_top, count(*) AS ok FROM (SELECT instance_id, seed, n_top, count(*) AS c FROM
  (SELECT instance_id, line, seed, row_number() OVER (PARTITION BY instance_id, seed ORDER BY counts DESC, {mix_sql('line', 'seed')}, line) AS pos FROM mass, seeds)
  JOIN gold USING (instance_id, line) JOIN (VALUES (5),(10)) t(n_top) ON pos<=n_top GROUP BY ALL) JOIN ng USING (instance_id) WHERE c=n_gold GROUP BY ALL) USING (instance_id, n_top)""",
    "ng", "seeds", "mass", "gold")


def tie_prob(spark, sf, primary="counts"):
    """Every gold item has a vote, so the flag of its row tells."""
    return T.seeded_tie_control(B.vote_rows(spark, sf), I, "line", "gold", primary, [5, 10], SEEDS)


@query("j6_random_tiebreak_control", "SELECT * FROM tieprob", "tieprob")
def j6(spark, sf):
    return tie_prob(spark, sf)


@query("j6_random_order_control", f"""SELECT n_top, count(*) AS n, round(avg(p),6) AS prob FROM (SELECT instance_id, n_top, coalesce(ok,0)/{SEEDS}.0::DOUBLE AS p FROM (SELECT * FROM ng, (VALUES (5),(10)) t(n_top)) LEFT JOIN
 (SELECT instance_id, n_top, count(*) AS ok FROM (SELECT instance_id, seed, n_top, count(*) AS c FROM
  (SELECT instance_id, line, seed, row_number() OVER (PARTITION BY instance_id, seed ORDER BY {mix_sql('line', 'seed')}, line) AS pos FROM mass, seeds)
  JOIN gold USING (instance_id, line) JOIN (VALUES (5),(10)) t(n_top) ON pos<=n_top GROUP BY ALL) JOIN ng USING (instance_id) WHERE c=n_gold GROUP BY ALL) USING (instance_id, n_top)) GROUP BY ALL""",
       "ng", "seeds", "mass", "gold")
def j6r(spark, sf):
    p = tie_prob(spark, sf, None)
    return p.groupBy("n_top").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prob"), 6).alias("prob"))


cte("outc", """SELECT instance_id, n_top, (fl=1 AND prob<0.5)::INT AS win, (fl=0 AND prob>0.5)::INT AS loss FROM tieprob JOIN
 (SELECT instance_id, n_top, coalesce(h=n_gold,false)::INT AS fl FROM (SELECT * FROM ng, (VALUES (5),(10)) t(n_top)) LEFT JOIN
  (SELECT instance_id, n_top, count(*) AS h FROM fused JOIN gold USING (instance_id, line) JOIN (VALUES (5),(10)) t(n_top) ON pos<=n_top GROUP BY ALL) USING (instance_id, n_top)) USING (instance_id, n_top)""",
    "tieprob", "ng", "fused", "gold")


def outcomes(spark, sf):
    top = F.explode(F.array(F.lit(5), F.lit(10)))
    gold = B.vote_gold(spark, sf)
    ranked = B.fused(spark, sf).filter("pos <= 10").withColumn("n_top", top).filter("pos <= n_top")
    expect = gold.select("instance_id").distinct().withColumn("n_top", top)
    flags = M.superset_any(ranked, gold, expect, ["instance_id", "n_top"], L).withColumnRenamed("superset", "flag")
    return T.win_loss(flags, tie_prob(spark, sf), ["instance_id", "n_top"]).withColumn("grp", F.lit("all"))


@query("j7_cluster_net_sign", f"""SELECT grp, nw AS naive_wins, nl AS naive_losses, cw AS cluster_wins, cl AS cluster_losses, round({mc_sql('nw', 'nl')},6) AS naive_p, round({mc_sql('cw', 'cl')},6) AS cluster_p FROM
 (SELECT 'all' AS grp, sum(w)::BIGINT AS nw, sum(l)::BIGINT AS nl, count(*) FILTER (w>l) AS cw, count(*) FILTER (l>w) AS cl FROM (SELECT instance_id, sum(win) AS w, sum(loss) AS l FROM outc GROUP BY ALL))""", "outc")
def j7(spark, sf):
    return T.cluster_net_sign(outcomes(spark, sf), ["grp"])


def rows_sql(src: str, by: str, value: str) -> str:
    """Reference SQL of the bootstrap that draws every row of every replicate."""
    return f"""SELECT {by}, n, mean, lo, hi, p_gt0 FROM
 (SELECT {by}, count(*) AS n, round(avg({value}),6) AS mean FROM {src} GROUP BY ALL) JOIN
 (SELECT {by}, round(max(m) FILTER (i={LO}),6) AS lo, round(max(m) FILTER (i={HI}),6) AS hi, round(avg((m>0)::INT),6) AS p_gt0 FROM
  (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY m)-1 AS i FROM
   (SELECT s.{by} AS {by}, b, avg(v.{value}) AS m FROM (SELECT {by}, slot, n, b FROM (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY instance_id)-1 AS slot,
      count(*) OVER (PARTITION BY {by}) AS n FROM {src}), reps) s JOIN
     (SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY instance_id)-1 AS idx FROM {src}) v ON v.{by}=s.{by} AND v.idx = {mix_sql('s.slot', 's.b')} % s.n GROUP BY ALL)) GROUP BY ALL) USING ({by})"""


cte("paired_rows", rows_sql("diffs", "k", "d"), "diffs", "reps")


@query("j8_verdict", """SELECT k, n, lo, hi, sig, discordant, p, CASE WHEN n>=60 AND sig AND lo>0 AND discordant>=8 AND p<0.05 THEN 'GREEN' WHEN discordant>=8 AND NOT sig THEN 'RED' ELSE 'AMBER' END AS verdict
 FROM (SELECT *, ((lo>0 OR hi<0) AND n>1) AS sig FROM paired_rows) JOIN mcn USING (k)""", "paired_rows", "mcn")
def j8(spark, sf):
    p = frozen(pairs(spark, sf))
    report = T.paired_bootstrap(p, ["k"], "instance_id", REPLICATES, "rows").join(T.mcnemar(p, ["k"]), "k")
    return T.verdict(report).select("k", "n", "lo", "hi", "sig", "discordant", "p", "verdict")


@query("j9_sign_stability", """SELECT count(*) AS runs, sum(net)::BIGINT AS total, min(net) AS low, max(net) AS high, CASE WHEN min(net)>0 THEN 'positive' WHEN max(net)<0 THEN 'negative' ELSE 'flips' END AS stability
 FROM (SELECT k, sum(a-b)::BIGINT AS net FROM pairs GROUP BY ALL)""", "pairs")
def j9(spark, sf):
    return T.sign_stability(pairs(spark, sf), "k")


@query("j11_pair_flip_test", f"""SELECT grp, n, no_yes, yes_no, round({mc_sql('no_yes', 'yes_no')},6) AS p FROM (SELECT 'all' AS grp, count(*) AS n, count(*) FILTER (c='NO' AND t='YES') AS no_yes, count(*) FILTER (c='YES' AND t='NO') AS yes_no FROM
 (SELECT conv_id, turn//2 AS pair, max(ans) FILTER (turn%2=0) AS c, max(ans) FILTER (turn%2=1) AS t FROM (SELECT *, CASE WHEN contains(text, chr(10)) THEN 'YES' ELSE 'NO' END AS ans FROM conversations) GROUP BY ALL) WHERE c IS NOT NULL AND t IS NOT NULL)""")
def j11(spark, sf):
    c = B.table(spark, sf, "conversations")
    answers = c.select("conv_id", F.floor(F.col("turn") / 2).alias("pair"), F.when(F.col("turn") % 2 == 0, "ctrl").otherwise("real").alias("arm"),
                       F.when(F.contains("text", F.lit("\n")), "YES").otherwise("NO").alias("ans"), F.lit("all").alias("grp"))
    return T.pair_flip_test(answers, ["conv_id", "pair"], "ctrl", "real", ["grp"])


@query("flagship_arm_report", """SELECT k, round(100*avg(a),6) AS fused_recall, round(100*avg(b),6) AS vote_recall, any_value(m.wins) AS wins, any_value(m.losses) AS losses, any_value(m.p) AS p
 FROM pairs JOIN mcn m USING (k) GROUP BY k""", "pairs", "mcn")
def flagship(spark, sf):
    report = T.paired_report(pairs(spark, sf), ["k"])
    return report.withColumnsRenamed({"rate_a": "fused_recall", "rate_b": "vote_recall"})
