"""Queries over nested inputs and run control."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailrank.functions.ordered import shared_folder
from trailrank.operators import classify as K
from trailrank.plans import bindings as B
from trailrank.plans.registry import query
from trailrank.plans.text_queries import pages
from trailrank.sources import ingest, sinks
from trailrank.streaming.incremental import run_incremental


@query("a1_read_instances", """SELECT instance_id, len(f) AS n_failing, f[1] AS first_failing FROM (SELECT 'd'||lpad(doc_id::VARCHAR,9,'0') AS instance_id, CASE lang WHEN 'en' THEN ['t_a','t_b'] WHEN 'fr' THEN ['t_plain'] ELSE []::VARCHAR[] END AS f FROM documents) ORDER BY instance_id LIMIT 300""")
def a1(spark, sf):
    d = B.table(spark, sf, "documents")
    listed = F.when(F.col("lang") == "en", '["t_a", "t_b"]').when(F.col("lang") == "fr", "t_plain").otherwise("")
    rows = d.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("instance_id"), listed.alias("FAIL_TO_PASS"), F.lit("[]").alias("PASS_TO_PASS"))
    return ingest.instance_pool(rows, 300).select("instance_id", F.size("failing").alias("n_failing"), F.get("failing", F.lit(0)).alias("first_failing"))


@query("a3_list_paths", "SELECT DISTINCT domain, regexp_replace(path,'/$','')||'.py' AS path FROM pg WHERE NOT ends_with(path,'.html')", "pg")
def a3(spark, sf):
    p = pages(spark, sf)
    named = F.when(F.col("path").endswith(".html"), F.col("path")).otherwise(F.concat(F.regexp_replace("path", "/$", ""), F.lit(".py")))
    return ingest.list_paths(p.withColumn("path", named), ["domain"])


@query("a3_remote_tree", """SELECT doc_id, n_chars>5000 AS truncated, 'src/'||doc_id||'.py' AS path FROM documents WHERE lang<>'de' UNION SELECT doc_id, n_chars>5000, 'lib/'||source||'.py' FROM documents WHERE lang<>'de' AND source IS NOT NULL
 UNION SELECT doc_id, n_chars>5000, NULL FROM documents WHERE lang='de'""")
def a3r(spark, sf):
    """A tree listing per document; German ones hold no source files."""
    blob = '{"path": "%s", "type": "blob"}'
    d = B.documents(spark, sf)
    some = F.when(F.col("lang") != "de", F.concat_ws(", ", F.format_string(blob % "src/%d.py", "doc_id"), F.when(F.col("source").isNotNull(), F.format_string(blob % "lib/%s.py", "source")),
                                                     F.format_string(blob % "src/%d.py", "doc_id"))).otherwise(blob % "setup.cfg")
    tree = F.concat(F.lit('{"sha": "0", "truncated": '), (F.col("n_chars") > 5000).cast("string"), F.lit(', "tree": [{"path": "pkg.py", "type": "tree"}, '), some, F.lit("]}"))
    return ingest.list_remote_tree(d.filter("lang is not null").select("doc_id", tree.alias("tree")), ["doc_id"])


@query("a5_read_coverage_json", "SELECT event_id, 'src/'||event_type||'.py' AS file, 0 AS file_ord, unnest([k,k+1]) AS line FROM ev UNION ALL SELECT event_id, 'lib/m.py', 2, k FROM ev WHERE k%2=0", "ev")
def a5(spark, sf):
    t = B.traces(spark, sf)
    def lines(a):
        return F.struct(a.alias("executed_lines"))
    none = F.array().cast("array<int>")
    files = F.create_map(F.concat(F.lit("/testbed/src/"), F.col("event_type"), F.lit(".py")), lines(F.array(F.col("k"), F.col("k") + 1)),
                         F.lit("pkg/tests/test_a.py"), lines(F.array(F.col("k"))), F.lit("./lib/m.py"), lines(F.when(F.col("k") % 2 == 0, F.array(F.col("k"))).otherwise(none)))
    return ingest.coverage_long(t.select("event_id", files.alias("files")), ["event_id"])


@query("a6_read_value_trace", "SELECT event_id, 'src/a:b.py' AS file, k AS line, unnest(['kind','user']) AS var, unnest([event_type, user_id::VARCHAR]) AS repr FROM ev", "ev")
def a6(spark, sf):
    t = B.traces(spark, sf)
    trace = F.create_map(F.concat(F.lit("./src/a:b.py:"), F.col("k").cast("string")), F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")),
                         F.lit("tests/test_x.py:3"), F.create_map(F.lit("x"), F.lit("1")))
    return ingest.value_trace_long(t.select("event_id", trace.alias("trace")), ["event_id"])


@query("a7_read_locations", """SELECT doc_id, 0 AS sample, 0 AS file_no, source||'/a.py' AS file, 0 AS loc_no, 'line: 3' AS loc FROM documents UNION ALL SELECT doc_id, 1, 1, source||'/b.py', 1, 'function: f'||lang FROM documents""")
def a7(spark, sf):
    d = B.table(spark, sf, "documents")
    empty = F.array().cast("array<string>")
    files = F.array(F.concat("source", F.lit("/a.py")), F.concat("source", F.lit("/b.py")))
    locs = F.array(F.array(F.array(F.lit("line: 3")), empty), F.array(empty, F.array(F.lit(" "), F.concat(F.lit("function: f"), F.col("lang"))), F.array(F.lit("beyond the files"))))
    return ingest.locations_long(d.select("doc_id", files.alias("found_files"), locs.alias("found_edit_locs")), ["doc_id"])


@query("a8_read_keyed_cache", "SELECT event_id, 'src/'||event_type||'.py' AS file, k AS line, round(value,2) AS value FROM ev", "ev")
def a8(spark, sf):
    t = B.traces(spark, sf)
    key = F.format_string('["src/%s.py", %d]', "event_type", "k")
    return ingest.keyed_cache_long(t.select("event_id", F.create_map(key, F.round("value", 2)).alias("votes")), ["event_id"])


@query("m13_probe_answers", "SELECT 'e'||event_id AS instance_id, 'src/'||event_type||'.py' AS file, k AS line, CASE WHEN k%2=0 THEN 'missed' ELSE 'covered' END AS role, 'real' AS arm, 'c' AS cat, 'YES' AS ans, true AS vf FROM ev", "ev")
def m13(spark, sf):
    t = B.traces(spark, sf)
    key = F.format_string("e%d|src/%s.py|%d|%s|real", "event_id", "event_type", "k", F.when(F.col("k") % 2 == 0, "missed").otherwise("covered"))
    none = F.lit(None).cast("string")
    return ingest.probe_answers_long(t.select(key.alias("key"), F.lit("c").alias("cat"), none.alias("role"), none.alias("arm"), F.lit("YES").alias("ans"), F.lit(True).alias("vf")))


@query("a10_pending_work", "SELECT event_id FROM events WHERE event_type IN ('error','view') OR value>90")
def a10(spark, sf):
    e = B.table(spark, sf, "events")
    done = e.filter("event_type <> 'view'").withColumn("error", F.col("event_type") == "error")
    return ingest.pending_work(e.select("event_id"), done, "event_id", "not error", e.filter("value > 90"))


@query("a11_restrict_ids", "SELECT doc_id, lang, quality, ord FROM documents JOIN (SELECT doc_id, quality, doc_id*7 % 1009 AS ord FROM labels WHERE quality=1) USING (doc_id)")
def a11(spark, sf):
    ids = B.table(spark, sf, "labels").filter("quality = 1").select("doc_id", "quality", (F.col("doc_id") * 7 % 1009).alias("ord"))
    return ingest.restrict_ids(B.table(spark, sf, "documents").select("doc_id", "lang"), ids, "doc_id").withColumn("quality", F.lit(1))


@query("a12_given_file_override", "SELECT doc_id, CASE WHEN toxic=1 THEN 'gold/'||doc_id ELSE source||','||lang END AS files FROM documents LEFT JOIN labels USING (doc_id)")
def a12(spark, sf):
    got = B.table(spark, sf, "documents").select("doc_id", F.array("source", "lang").alias("files"))
    given = B.table(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.array(F.concat(F.lit("gold/"), F.col("doc_id").cast("string"))).alias("files"))
    return ingest.given_file_override(got, given, "doc_id").withColumn("files", F.array_join("files", ","))


@query("a13_cache_precedence", """SELECT DISTINCT user_id, line, src FROM (SELECT user_id, (props->>'$.k')::INT AS line, 'click' AS src FROM events WHERE event_type='click' UNION ALL
 SELECT user_id, (props->>'$.k')::INT, 'view' FROM events WHERE event_type='view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type='click'))""")
def a13(spark, sf):
    e = B.table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("line"), F.col("event_type").alias("src"))
    return ingest.cache_precedence([e.filter("src = 'click'"), e.filter("src = 'view'")], ["user_id"], ["line"])


@query("a14_completeness_report", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'present' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def a14(spark, sf):
    return ingest.completeness_report(B.table(spark, sf, "documents").select("doc_id"), B.table(spark, sf, "labels"), ["doc_id"])


@query("m8_vote_substrate", """SELECT instance_id, line, mass, counts, rank() OVER (PARTITION BY instance_id ORDER BY mass DESC) AS r FROM mass QUALIFY r<=3""", "mass")
def m8(spark, sf):
    """The best three masses of an instance with ties kept: a rank filter that Spark cuts before
    the shuffle."""
    from pyspark.sql import Window as W
    items = B.vote_items(spark, sf).select("instance_id", "line", "mass", "counts")
    return items.withColumn("r", F.rank().over(W.partitionBy("instance_id").orderBy(F.desc("mass")))).filter("r <= 3")


@query("a9_write_results", "SELECT CASE WHEN quality=1 THEN 'good' ELSE 'rest' END AS run, doc_id, toxic FROM labels")
def a9(spark, sf):
    """Two runs appended to one result folder and read back with their partition column."""
    out = shared_folder(spark, "results")
    labels = B.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    sinks.write_results(labels.filter("quality = 1").drop("quality"), out, "good")
    sinks.write_results(labels.filter("quality <> 1").drop("quality"), out, "rest")
    return spark.read.parquet(out)


@query("a10_incremental_run", """SELECT event_id, CASE event_type WHEN 'error' THEN 'traceback' WHEN 'view' THEN 'frames>=2' WHEN 'purchase' THEN 'raises' ELSE 'none' END AS rule FROM events""")
def a10s(spark, sf):
    """The event table as a stream of arriving files: one labelled record per new event."""
    def work(batch):
        t = B.trace_text(batch)
        return t.select("event_id", K.crash_rule(F.col("text"), F.col("test_patch")).alias("rule"))

    out = shared_folder(spark, "labelled")
    schema = B.table(spark, sf, "events").schema.simpleString()[len("struct<"):-1].replace(":", " ")
    run_incremental(spark, sf, schema, out, shared_folder(spark, "progress"), "event_id", work, "parquet", {"pathGlobFilter": "events.parquet"}).awaitTermination()
    return spark.read.parquet(out).drop("run", "batch")
