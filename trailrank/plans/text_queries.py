"""Queries over document lines, issues, pages and embeddings."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailrank.functions.columns import identifiers, is_code, tokens
from trailrank.functions.ordered import frozen
from trailrank.operators import classify as K
from trailrank.operators import graph as G
from trailrank.operators import joins as J
from trailrank.operators import parse as P
from trailrank.operators import rank as R
from trailrank.plans import bindings as B
from trailrank.plans.bindings import CODE_SQL, tokens_sql
from trailrank.plans.registry import cte, query
from trailrank.sources import ingest

D = ["doc_id"]
ID = ["item_id", "doc_id"]


@query("a2_read_source_lines", "SELECT * FROM lines", "lines")
def a2(spark, sf):
    return B.lines(spark, sf)


@query("a4_corpus_grep", "SELECT doc_id, line_no, text[1:300] AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM lines WHERE regexp_matches(text, '[0-9]+|https?:')) WHERE r<=5", "lines")
def a4(spark, sf):
    return ingest.corpus_grep(B.lines(spark, sf), r"[0-9]+|https?:", D, per_file=5)


@query("b4_identifier_tokens", "SELECT * FROM line_tok", "line_tok")
def b4(spark, sf):
    return R.line_tokens(B.lines(spark, sf))


@query("c12_code_lines", f"SELECT doc_id, line_no FROM lines WHERE {CODE_SQL}", "lines")
def c12(spark, sf):
    return B.lines(spark, sf).filter(is_code(F.col("text"))).select("doc_id", "line_no")


@query("e1_line_idf", "SELECT doc_id, token, df, round(idf,6) AS idf FROM line_idf", "line_idf")
def e1(spark, sf):
    idf = R.inverse_frequency(R.line_tokens(B.lines(spark, sf)), B.doc_sizes(spark, sf), D, "n_lines")
    return idf.withColumn("idf", F.round("idf", 6))


@query("m3_issue_gold", "SELECT * FROM issue_docs", "issue_docs")
def m3(spark, sf):
    return B.issue_docs(spark, sf)


@query("e2_issue_relevance", "SELECT item_id, doc_id, line, rel FROM sig", "sig")
def e2(spark, sf):
    return B.signals(spark, sf).select("item_id", "doc_id", "line", "rel")


@query("e3_line_score", "SELECT * FROM score1", "score1")
def e3(spark, sf):
    return R.line_score(B.signals(spark, sf)).select("item_id", "doc_id", "line", "score")


@query("e4_line_score_graded", "SELECT * FROM (SELECT item_id, doc_id, line, round(rel+0.6*prox+coalesce(1.2*power(0.6::DOUBLE,hops),0),6)::DOUBLE AS score FROM sig) WHERE score>0", "sig")
def e4(spark, sf):
    return R.line_score(B.signals(spark, sf), decay=0.6, use_coverage=False).select("item_id", "doc_id", "line", "score")


@query("e4_score_sweep", """SELECT * FROM (SELECT delta, item_id, doc_id, line, round(rel+0.6*prox+coalesce(1.2*power(0.6::DOUBLE,hops),0)+delta*covered,6)::DOUBLE AS score FROM sig, (VALUES (0.8::DOUBLE),(1.5),(3),(6)) t(delta)) WHERE score>0""", "sig")
def e4s(spark, sf):
    return R.score_sweep(B.signals(spark, sf), [0.8, 1.5, 3.0, 6.0], decay=0.6).select("delta", "item_id", "doc_id", "line", "score")


@query("e5_rank_suspect_lines", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, line) AS pos FROM score1) WHERE pos<=15", "score1")
def e5t(spark, sf):
    return R.rank_lines(R.line_score(B.signals(spark, sf)).select(*ID, "line", "score"), ID, ["line"], 15)


FN = """fscore AS (SELECT item_id, doc_id, name, start, "end", round(coalesce(sum(score),0)+1.5*coalesce(max(cov),0)+2.0*max((name='f'||((gs-1)//10))::INT),6)::DOUBLE AS score FROM
 (SELECT i.item_id, i.doc_id, s.name, s.start, s."end", i.start AS gs, unnest(range(s.start, s."end"+1)) AS line FROM issue_docs i JOIN spans s USING (doc_id))
 LEFT JOIN score1 USING (item_id, doc_id, line) LEFT JOIN (SELECT item_id, doc_id, line, 1 AS cov FROM sig WHERE covered=1) USING (item_id, doc_id, line) GROUP BY ALL)"""
cte("fscore", FN[len("fscore AS ("):-1], "issue_docs", "spans", "score1", "sig")


@query("e6_rank_functions", """SELECT item_id, doc_id, name, start, "end", score, pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, start, "end") AS pos FROM fscore WHERE score>0) WHERE pos<=6
 UNION ALL SELECT item_id, doc_id, name, start, "end", 0, pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY start, "end" DESC) AS pos FROM fscore f
  WHERE NOT EXISTS(FROM fscore g WHERE g.item_id=f.item_id AND g.doc_id=f.doc_id AND g.score>0)) WHERE pos<=6""", "fscore")
def e6(spark, sf):
    pairs = B.issue_docs(spark, sf)
    sig = frozen(B.signals(spark, sf, pairs).select(*ID, "line", "rel", "prox", "hops", "covered"))
    funcs = B.spans(spark, sf).join(pairs.select(*ID), "doc_id")
    named = pairs.select(*ID, F.concat(F.lit("f"), F.floor((F.col("start") - 1) / 10).cast("string")).alias("name"))
    return R.rank_functions(funcs, R.line_score(sig), sig.filter("covered = 1"), named, ID)


cte("ent", "SELECT DISTINCT l_orderkey AS issue, l_partkey AS file, name FROM (SELECT l_orderkey, l_partkey, unnest([p_name, p_type, p_brand]) AS name FROM lineitem JOIN part ON p_partkey=l_partkey)")
cte("ent_tok", f"SELECT DISTINCT issue, file, unnest({tokens_sql('name')}) AS token FROM ent", "ent")
cte("want", f"SELECT DISTINCT l_orderkey AS issue, p_type, unnest({tokens_sql('p_name || chr(32) || p_type')}) AS token FROM lineitem JOIN part ON p_partkey=l_partkey WHERE l_linenumber=1")
E7_SQL = """SELECT * FROM (SELECT issue, file, score, row_number() OVER (PARTITION BY issue ORDER BY score DESC, file) AS pos FROM
 (SELECT f.issue, f.file, round(coalesce(rel,0)+CASE WHEN EXISTS(FROM ent e JOIN want w ON w.issue=e.issue AND w.p_type=e.name WHERE e.issue=f.issue AND e.file=f.file) THEN 2.0 ELSE 0 END,6)::DOUBLE AS score
  FROM (SELECT DISTINCT issue, file FROM ent SEMI JOIN want USING (issue)) f LEFT JOIN (SELECT t.issue, t.file, sum(ln(1+n::DOUBLE/df)) AS rel FROM ent_tok t JOIN (SELECT DISTINCT issue, token FROM want) w USING (issue, token)
   JOIN (SELECT issue, token, count(*) AS df FROM ent_tok GROUP BY ALL) USING (issue, token) JOIN (SELECT issue, count(DISTINCT file) AS n FROM ent GROUP BY ALL) USING (issue) GROUP BY ALL) USING (issue, file))) WHERE pos<=5"""


@query("e7_rank_files", E7_SQL, "ent", "ent_tok", "want")
def e7(spark, sf):
    li = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("issue"), F.col("l_partkey").alias("file"), "l_linenumber")
    part = B.table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.array("p_name", "p_type", "p_brand").alias("names"), "p_name", "p_type")
    files = R.entity_tokens(part)
    entities = li.select("issue", "file").distinct().join(files.select("file", "names", "tokens"), "file")
    words = part.select("file", F.array("p_type").alias("_names"), tokens(F.concat_ws(" ", "p_name", "p_type")).alias("_tokens"))
    first = li.filter("l_linenumber = 1").select("issue", "file").distinct().join(words, "file")
    issues = first.groupBy("issue").agg(F.array_distinct(F.flatten(F.collect_set("_tokens"))).alias("issue_tokens"),
                                        F.array_distinct(F.flatten(F.collect_set("_names"))).alias("issue_names"))
    return R.rank_files(entities, issues, ["issue"], top=5)


DOMAIN = r"^https?://(?:[^/]*\.)?([^./]+\.[^./:]+)(?:[/:?#]|$)"


def pages(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", DOMAIN, 1).alias("domain"),
                                             F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path"))


cte("pg", rf"SELECT page_id, url, regexp_extract(url, '{DOMAIN}', 1) AS domain, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages")


@query("e22_prefilter_paths", f"""SELECT DISTINCT domain, path FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY o DESC, path) AS a, row_number() OVER (PARTITION BY domain ORDER BY path) AS b FROM
 (SELECT domain, path, len(list_intersect({tokens_sql("replace(path,'/',' ')")}, (SELECT list(DISTINCT token) FROM (SELECT domain AS dm, unnest({tokens_sql("replace(path,'/',' ')")}) AS token FROM pg WHERE contains(url,'page=')) WHERE dm=p.domain))) AS o
  FROM (SELECT DISTINCT domain, path FROM pg) p)) WHERE a<=40 OR b<=15""", "pg")
def e22(spark, sf):
    p = pages(spark, sf)
    wanted = p.filter(F.contains("url", F.lit("page="))).select("domain", F.explode(tokens(F.translate("path", "/", " "))).alias("token"))
    return R.prefilter_paths(p, wanted, ["domain"], "path", 40, 15).select("domain", "path")


DOT = "list_sum(list_transform(range(1,65), lambda i: a[i]::DOUBLE*b[i]::DOUBLE))"


@query("e23_cosine_rank", f"""SELECT * FROM (SELECT label, vec_id, sim AS similarity, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS pos FROM
 (SELECT label, vec_id, round({DOT}/(sqrt({DOT.replace('b[', 'a[')})*sqrt({DOT.replace('a[', 'b[')})+1e-9),6) AS sim FROM
  (SELECT e.label, e.vec_id, e.embedding AS a, q.embedding AS b FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY ALL) q USING (label)))) WHERE pos<=10""")
def e23(spark, sf):
    e = B.table(spark, sf, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return R.cosine_rank(e, q, ["label"], "vec_id", top=10)


cte("mod_score", f"""SELECT doc_id, line_no AS line, (len(list_intersect({tokens_sql('text')}, ['the','and','les','der','que'])) + 1.5*(length(text)>40)::INT)::DOUBLE AS score FROM lines WHERE {CODE_SQL} AND line_no>10""", "lines")


@query("e21_build_region", f"""SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) AS pos FROM (SELECT r.doc_id, r.line, coalesce(score,0) AS score FROM
 (SELECT doc_id, line_no AS line FROM lines JOIN sizes USING (doc_id) WHERE n_lines<=20 AND {CODE_SQL} UNION SELECT doc_id, unnest(range(start, least("end",n_lines)+1)) FROM spans JOIN sizes USING (doc_id) WHERE n_lines>20 AND name='f0'
  UNION SELECT doc_id, unnest(range(greatest(1,line-2), least(n_lines,line+2)+1)) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) AS p FROM mod_score WHERE score>0) JOIN sizes USING (doc_id) WHERE n_lines>20 AND p<=12) r
  LEFT JOIN mod_score m ON m.doc_id=r.doc_id AND m.line=r.line)) WHERE pos<=30""", "lines", "sizes", "spans", "mod_score")
def e21(spark, sf):
    lines = B.lines(spark, sf).filter(is_code(F.col("text"))).withColumnRenamed("line_no", "line")
    common = F.array(*[F.lit(w) for w in ("the", "and", "les", "der", "que")])
    module = lines.filter("line > 10").withColumn("score", F.size(F.array_intersect(tokens(F.col("text")), common)) + F.when(F.length("text") > 40, 1.5).otherwise(0.0))
    first = B.spans(spark, sf).filter("name = 'f0'")
    return G.build_region(lines, B.doc_sizes(spark, sf), first, module, None, module, D, small_file=20, module_lines=12, budget=30)


cte("region_raw", f"""SELECT doc_id, line_no AS line FROM lines JOIN sizes USING (doc_id) WHERE n_lines<=20 AND {CODE_SQL} UNION SELECT doc_id, unnest(range(start, least("end",n_lines)+1)) FROM spans JOIN sizes USING (doc_id) WHERE n_lines>20 AND name='f0'
 UNION SELECT doc_id, unnest(range(greatest(1,line-2), least(n_lines,line+2)+1)) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) AS p FROM mod_score WHERE score>0) JOIN sizes USING (doc_id) WHERE n_lines>20 AND p<=12""",
    "lines", "sizes", "spans", "mod_score")


@query("e21_build_region_executed", """SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) AS pos FROM (SELECT r.doc_id, r.line, coalesce(score,0) AS score FROM
 (SELECT *, bool_or(line%4=3) OVER (PARTITION BY doc_id) AS ran FROM region_raw) r LEFT JOIN mod_score m ON m.doc_id=r.doc_id AND m.line=r.line WHERE NOT ran OR r.line%4=3)) WHERE pos<=8""", "region_raw", "mod_score")
def e21x(spark, sf):
    """Every fourth line was executed; a region without one stays whole."""
    lines = B.lines(spark, sf).filter(is_code(F.col("text"))).withColumnRenamed("line_no", "line")
    common = F.array(*[F.lit(w) for w in ("the", "and", "les", "der", "que")])
    module = lines.filter("line > 10").withColumn("score", F.size(F.array_intersect(tokens(F.col("text")), common)) + F.when(F.length("text") > 40, 1.5).otherwise(0.0))
    ran = B.lines(spark, sf).select("doc_id", F.col("line_no").alias("line")).filter("line % 4 = 3")
    return G.build_region(lines, B.doc_sizes(spark, sf), B.spans(spark, sf).filter("name = 'f0'"), module, ran, module, D, small_file=20, module_lines=12, budget=8)


@query("d3_line_in_function", """SELECT doc_id, line, arg_max(name, (start, -"end", name)) AS name FROM (SELECT l.doc_id, l.line_no AS line, s.name, s.start, s."end" FROM lines l LEFT JOIN spans s ON s.doc_id=l.doc_id AND l.line_no BETWEEN s.start AND s."end") GROUP BY ALL""", "lines", "spans")
def d3(spark, sf):
    lines = B.lines(spark, sf).select("doc_id", F.col("line_no").alias("line"))
    return J.line_in_function(lines, B.spans(spark, sf), D).select("doc_id", "line", "name")


@query("d4_context_window", """SELECT DISTINCT doc_id, unnest(CASE WHEN e-s+1<=8 THEN range(s,e+1) ELSE range(greatest(1,line-3), least(n_lines,line+3)+1) END) AS line FROM
 (SELECT i.doc_id, i.start AS line, n_lines, ((i.start-1)//10)*10+1 AS s, least(((i.start-1)//10)*10+10, n_lines) AS e FROM issue_docs i JOIN sizes USING (doc_id))""", "issue_docs", "sizes")
def d4(spark, sf):
    centers = B.issue_docs(spark, sf).select("doc_id", F.col("start").alias("line"))
    spans = B.spans(spark, sf).filter("name like 'f%'")
    return J.context_window(centers, spans, B.doc_sizes(spark, sf), D, 3, 8)


@query("d12_text_contains_join", r"""SELECT DISTINCT item_id FROM issue_docs JOIN benchmark USING (item_id) JOIN lines USING (doc_id) WHERE length(trim(lines.text, E' \t\r\f\x0b'))>=4 AND contains(benchmark.text, trim(lines.text, E' \t\r\f\x0b'))""", "issue_docs", "lines")
def d12(spark, sf):
    pairs = B.issue_docs(spark, sf)
    evidence = B.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("evidence"))
    quotes = pairs.join(B.lines(spark, sf), "doc_id").select("item_id", F.col("text").alias("quote"))
    return J.text_contains_join(evidence, quotes, ["item_id"])


@query("d1_path_suffix_join", r"""SELECT path, arg_min(known, (path<>known, page_id)) AS known FROM (SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) AS path FROM pg) w
 JOIN (SELECT path AS known, min(page_id) AS page_id FROM pg GROUP BY ALL) k ON k.known=w.path OR ends_with(k.known, '/'||w.path) OR ends_with(w.path, '/'||k.known) GROUP BY ALL""", "pg")
def d1(spark, sf):
    p = pages(spark, sf)
    known = p.groupBy(F.col("path").alias("known")).agg(F.min("page_id").alias("file_ord"))
    return J.path_suffix_join(p.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("path")), known, [])


@query("d1_path_suffix_join_basename", r"""SELECT path, arg_min(known, (path<>known, page_id)) AS known FROM (SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) AS path FROM pg WHERE NOT ends_with(path, '/')) w
 JOIN (SELECT path AS known, min(page_id) AS page_id FROM pg WHERE NOT ends_with(path, '/') GROUP BY ALL) k ON ends_with(k.known, w.path) OR ends_with(w.path, regexp_extract(k.known, '([^/]*)$', 1)) GROUP BY ALL""", "pg")
def d1b(spark, sf):
    p = pages(spark, sf).filter(~F.col("path").endswith("/"))
    known = p.groupBy(F.col("path").alias("known")).agg(F.min("page_id").alias("file_ord"))
    return J.path_suffix_join(p.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("path")), known, [], "basename")


@query("d8_resolve_imports", r"""SELECT domain, path, pos FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY path) AS pos FROM (SELECT DISTINCT k.domain, k.path FROM
 (SELECT domain, regexp_extract(path, '/([a-z]+/\d+)', 1)||'.py' AS path, url FROM pg) k WHERE k.path<>'.py' AND NOT EXISTS(FROM pg q WHERE q.domain=k.domain AND contains(q.url,'utm_') AND regexp_extract(q.path, '/([a-z]+/\d+)', 1)||'.py'=k.path))) WHERE pos<=10""", "pg")
def d8(spark, sf):
    local = F.regexp_extract("path", r"/([a-z]+/\d+)", 1)
    p = pages(spark, sf).withColumn("_l", local).filter("_l <> ''").withColumn("path", F.concat("_l", F.lit(".py")))
    imports = p.select("domain", F.replace("_l", F.lit("/"), F.lit(".")).alias("module"))
    return J.resolve_imports(imports, p, p.filter(F.contains("url", F.lit("utm_"))), ["domain"])


F3_WORDS = "regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]*')"


@query("f3_seed_lines", f"""SELECT DISTINCT item_id, doc_id, line FROM (SELECT i.item_id, i.doc_id, s.start AS line FROM issue_docs i JOIN spans s USING (doc_id) WHERE s.name='f'||((i.start-1)//10)
 UNION ALL SELECT i.item_id, i.doc_id, ((l.line_no-1)//2)*2+1 FROM issue_docs i JOIN benchmark b USING (item_id) JOIN lines l USING (doc_id) WHERE l.line_no>1 AND {CODE_SQL.replace("text", "l.text")}
  AND len(list_intersect({F3_WORDS.format("l.text")}, {F3_WORDS.format("b.text")}))>0
 UNION ALL SELECT item_id, doc_id, (("end"-1)//2)*2+1 FROM issue_docs)""", "issue_docs", "spans", "lines")
def f3(spark, sf):
    pairs = B.issue_docs(spark, sf)
    issue = pairs.join(B.table(spark, sf, "benchmark"), "item_id").select(*ID, F.col("text").alias("issue"))
    funcs = B.spans(spark, sf).join(pairs.select(*ID), "doc_id")
    lines = B.lines(spark, sf).join(pairs.select(*ID), "doc_id").select(*ID, F.col("line_no").alias("line"), (F.floor((F.col("line_no") - 1) / 2) * 2 + 1).cast("int").alias("stmt"),
                                                                       "text", (F.col("line_no") > 1).alias("in_func"))
    frames = pairs.select(*ID, F.col("end").alias("line"))
    named = pairs.select(*ID, F.concat(F.lit("f"), F.floor((F.col("start") - 1) / 10).cast("string")).alias("name"))
    none = funcs.filter("1 = 0")
    return G.seed_lines(funcs, none, lines, issue, frames, named, ID)


@query("f3_seed_classes", """SELECT DISTINCT i.item_id, i.doc_id, l.line_no AS line FROM issue_docs i JOIN benchmark b USING (item_id) JOIN lines l ON l.doc_id=i.doc_id AND l.line_no=i.start
 WHERE len(list_intersect(regexp_extract_all(b.text, '[A-Za-z_][A-Za-z0-9_]*'), regexp_extract_all(l.text, '[A-Za-z_][A-Za-z0-9_]*')))>0""", "issue_docs", "lines")
def f3c(spark, sf):
    """A class for every identifier of the line where a passage begins: a seed where the issue says its name."""
    pairs = B.issue_docs(spark, sf)
    issue = pairs.join(B.table(spark, sf, "benchmark"), "item_id").select(*ID, F.col("text").alias("issue"))
    starts = B.lines(spark, sf).select("doc_id", F.col("line_no").alias("start"), "text")
    classes = pairs.select(*ID, "start").join(starts, ["doc_id", "start"]).select(*ID, F.explode(F.array_distinct(identifiers(F.col("text")))).alias("name"), "start")
    none = pairs.select(*ID, F.lit("").alias("name"), F.lit(0).alias("start"), F.lit(0).alias("end")).filter("false")
    lines = pairs.select(*ID, F.lit(1).alias("line"), F.lit(1).alias("stmt"), F.lit("").alias("text"), F.lit(False).alias("in_func")).filter("false")
    return G.seed_lines(none, classes, lines, issue, none.select(*ID, F.col("start").alias("line")), none.select(*ID, "name"), ID)


@query("c11_bucket_gold", """SELECT gold, files, count(*) AS n FROM (SELECT instance_id, CASE WHEN count(*)<=1 THEN '1' WHEN count(*)<=3 THEN '2-3' ELSE '>=4' END AS gold,
 CASE WHEN count(DISTINCT line%10)<=1 THEN '1' ELSE '>=2' END AS files FROM gold GROUP BY ALL) GROUP BY ALL""", "gold")
def c11g(spark, sf):
    per = B.vote_gold(spark, sf).groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("line") % 10).alias("f"))
    return per.groupBy(K.bucket_gold(F.col("n")).alias("gold"), K.bucket_files(F.col("f")).alias("files")).agg(F.count(F.lit(1)).alias("n"))


@query("c11_bucketize", """SELECT source, bucket, count(*) AS n FROM (SELECT source, CASE WHEN n_chars<=200 THEN '<=200' WHEN n_chars<=1000 THEN '200-1000' WHEN n_chars<=3000 THEN '1000-3000' ELSE '>3000' END AS bucket FROM documents
 WHERE source IN (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 6)) GROUP BY ALL""")
def c11(spark, sf):
    d = K.top_groups(B.documents(spark, sf).select("source", "n_chars"), "source", 6)
    return d.groupBy("source", K.bucket_size(F.col("n_chars")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("c4_seeded_sample", f"SELECT doc_id FROM documents ORDER BY {B.mix_sql('doc_id', '3')}, doc_id LIMIT 100")
def c4(spark, sf):
    return K.seeded_sample(B.documents(spark, sf).select("doc_id"), "doc_id", 100, 3)


@query("b8_parse_locations", """SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(range(1, least(3+2, n_lines)+1)) AS line FROM sizes UNION ALL SELECT doc_id, unnest(range(greatest(1,n_lines-2), n_lines+1)) FROM sizes
 UNION ALL SELECT doc_id, unnest(range(start, "end"+1)) FROM spans WHERE name IN ('f1','g0'))""", "sizes", "spans")
def b8(spark, sf):
    s = B.doc_sizes(spark, sf)
    loc = F.concat(F.lit("line: 3\nclass: g0\nfunction: mod.f1\nline: "), F.col("n_lines").cast("string"), F.lit("-"), (F.col("n_lines") + 1).cast("string"))
    return P.parse_locations(s.select("doc_id", loc.alias("loc")), B.spans(spark, sf), s, D, window=2)
