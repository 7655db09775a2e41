"""Queries over patches, failure text and answers."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailrank.operators import classify as K
from trailrank.operators import joins as J
from trailrank.operators import parse as P
from trailrank.plans import bindings as B
from trailrank.plans.bindings import CODE_SQL
from trailrank.plans.registry import cte, query

D, E = ["doc_id"], ["event_id"]
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def edits(spark, sf, mode="strict"):
    return P.diff_to_edit_lines(B.patches(spark, sf), D, mode=mode)


@query("b1_diff_to_edit_lines", "SELECT * FROM edits", "edits")
def b1(spark, sf):
    return edits(spark, sf)


@query("b1_diff_to_edit_lines_corrected", """SELECT doc_id, 'docs/'||doc_id||'.py' AS file, 1 AS hunk, line_no AS line, 'deleted' AS kind FROM lines WHERE line_no%7=0
 UNION SELECT doc_id, 'docs/'||doc_id||'.py', 1, line_no + d, 'anchor' FROM lines, (VALUES (0),(1)) t(d) WHERE line_no%3=0
 UNION SELECT doc_id, CASE WHEN lang='de' THEN 'lib/'||doc_id||'.py' ELSE 'notes/'||doc_id||'.txt' END, 2, l, k FROM documents, (VALUES (5,'deleted'),(5,'anchor'),(6,'anchor')) t(l,k) WHERE lang<>'en'""", "lines")
def b1c(spark, sf):
    return edits(spark, sf, "corrected")


cte("cleaned", rf"""SELECT doc_id, line FROM (SELECT DISTINCT doc_id, line FROM edits WHERE starts_with(file, 'docs/')) g JOIN (SELECT doc_id, line_no, text FROM lines WHERE {CODE_SQL}
 AND NOT regexp_full_match({STRIP.format("string_split(" + STRIP.format("text") + ", '#')[1]")}, '[()\[\]{{}},:;\\]+')) l USING (doc_id) WHERE l.line_no=g.line""", "edits", "lines")


def cleaned(spark, sf):
    gold = P.region_lines(edits(spark, sf).filter(F.col("file").startswith("docs/")), D).select("doc_id", "line")
    return P.clean_gold(gold, B.lines(spark, sf).withColumnRenamed("line_no", "line"), ["doc_id", "line"])


@query("b2_clean_gold", "SELECT * FROM cleaned", "cleaned")
def b2(spark, sf):
    return cleaned(spark, sf)


cte("adds", """SELECT doc_id, line_no//3 AS j, [4,4,4,0,0][(line_no//3-1)%5+1] AS indent, ['return','value = 1','# note','other = 2','if flag:'][(line_no//3-1)%5+1] AS text FROM lines WHERE line_no%3=0
 UNION ALL SELECT doc_id, 100000000, 0, 'y' FROM documents WHERE lang<>'en'""", "lines")


@query("b3_added_lines", "SELECT doc_id, indent, text, count(*) AS n FROM adds WHERE text<>'# note' GROUP BY ALL", "adds")
def b3(spark, sf):
    return P.added_lines(B.patches(spark, sf), D).groupBy("doc_id", "indent", "text").agg(F.count(F.lit(1)).alias("n"))


@query("c6_patch_kind", """SELECT doc_id, CASE WHEN n_lines>=21 THEN 'CF' ELSE 'DL' END AS kind, CASE WHEN n_lines>=15 THEN 'CF' ELSE 'DL' END AS naive FROM documents JOIN sizes USING (doc_id)""", "sizes")
def c6(spark, sf):
    patches = B.patches(spark, sf)
    return K.patch_kind(patches, P.added_lines(patches, D), D)


@query("b5_traceback_frames", "SELECT event_id, ord, path, line, func FROM frames", "frames")
def b5(spark, sf):
    return P.traceback_frames(B.traces(spark, sf), E)


@query("b5_deepest_frame", "SELECT event_id, 2 AS n_frames, path, line, func FROM frames WHERE ord=1", "frames")
def b5d(spark, sf):
    return P.deepest_frame(P.traceback_frames(B.traces(spark, sf), E), E)


@query("b5_loose_frames", """SELECT event_id, path, line FROM frames UNION SELECT event_id, 'click.py', k FROM ev WHERE event_type='click' UNION SELECT event_id, 'src/purchase.py', k FROM ev WHERE event_type='purchase'""", "frames", "ev")
def b5l(spark, sf):
    return P.loose_frames(B.traces(spark, sf), E)


@query("b5_named_functions", "SELECT event_id, func AS name FROM frames", "frames")
def b5n(spark, sf):
    return P.named_functions(B.traces(spark, sf), E)


cte("trace_tail", """SELECT event_id, 'File "src/'||event_type||'.py", line '||k||', in u'||user_id AS f1, 'File "lib/m'||(k%5)||'.py", line '||(k+1)||', in step_'||k AS f2, * EXCLUDE (event_id) FROM ev""", "ev")


@query("b6_crash_context", """SELECT event_id, CASE event_type WHEN 'error' THEN 'Traceback (most recent call last):'||chr(10)||'  '||f1||chr(10)||'    run()'||chr(10)||'  '||f2||chr(10)||'    go()'||chr(10)||'ValueError: bad '||k
 WHEN 'view' THEN f1||chr(10)||f2 WHEN 'click' THEN 'raise KeyError near click.py:'||k WHEN 'purchase' THEN 'src/purchase.py, line '||k||' looks wrong' ELSE 'user '||user_id||' signed up' END AS context FROM trace_tail""", "trace_tail")
def b6(spark, sf):
    return B.traces(spark, sf).select("event_id", P.crash_context(F.col("text")).alias("context"))


@query("b7_exception_facts", """SELECT event_id, CASE WHEN event_type='error' THEN 'ValueError' END AS error, CASE WHEN event_type='error' THEN 'bad '||k END AS message,
 CASE event_type WHEN 'error' THEN 'ValueError' WHEN 'click' THEN 'KeyError' ELSE '' END AS kinds, CASE event_type WHEN 'error' THEN 'ValueError' WHEN 'click' THEN 'KeyError' ELSE '' END AS real_errors FROM ev""", "ev")
def b7(spark, sf):
    facts = P.exception_facts(B.traces(spark, sf), E)
    return facts.withColumns({"kinds": F.array_join("kinds", "|"), "real_errors": F.array_join("real_errors", "|")})



def answers(spark, sf):
    """Answer texts in several shapes, built from conversation turns."""
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.length("text").alias("n"))
    a = (F.when(F.col("role") == "user", F.format_string("ranked: [%d, %d, %d, %d]", "n", F.col("n") + 2, "n", F.col("turn") + 1))
         .when(F.col("role") == "assistant", F.format_string("root cause: %d, then %d", F.col("n") + 5, F.col("turn") + 1))
         .otherwise(F.format_string("[] no list but %d", "n")))
    return c.withColumn("answer", a)


@query("b9_parse_ranked_answer", """SELECT conv_id, turn, rank, line FROM (SELECT conv_id, turn, unnest(range(0,len(l))) AS rank, unnest(l) AS line FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN CASE WHEN turn+1 IN (n,n+2) THEN [n,n+2] ELSE [n,n+2,turn+1] END
 WHEN 'assistant' THEN CASE WHEN n+5=turn+1 THEN [n+5] ELSE [n+5,turn+1] END ELSE [n] END AS l FROM (SELECT *, length(text) AS n FROM conversations)))""")
def b9(spark, sf):
    return P.parse_ranked_answer(answers(spark, sf), ["conv_id", "turn"])


@query("b9_parse_free_text", r"""SELECT doc_id, unnest(range(0,len(l))) AS rank, unnest(l) AS line FROM (SELECT doc_id, list_reduce(list_prepend([]::BIGINT[], list_transform(list_filter(list_transform(
 regexp_extract_all(text, '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NOT NULL), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS l FROM documents)""")
def b9f(spark, sf):
    """Whole documents as answers without a list: every number of the text counts."""
    return P.parse_ranked_answer(B.documents(spark, sf), ["doc_id"], "text")


@query("b10_parse_ranges", """SELECT DISTINCT conv_id, turn, true AS parsed, unnest(range(least(a,b), greatest(a,b)+1)) AS line FROM (SELECT conv_id, turn, turn+9 AS a, turn+7 AS b FROM conversations UNION ALL SELECT conv_id, turn, length(text), length(text)+turn FROM conversations)""")
def b10(spark, sf):
    c = B.table(spark, sf, "conversations")
    text = F.format_string("edit [[%d,%d],[%d,%d],[1,4000]] please", F.col("turn") + 9, F.col("turn") + 7, F.length("text"), F.length("text") + F.col("turn"))
    return P.parse_ranges(c.select("conv_id", "turn", text.alias("answer")), ["conv_id", "turn"])


@query("b10_parse_names", """SELECT conv_id, turn, unnest(CASE WHEN role='user' THEN [0] ELSE [0,1] END) AS rank, unnest(CASE WHEN role='user' THEN ['role_user'] ELSE ['f_'||turn, role] END) AS name FROM conversations""")
def b10n(spark, sf):
    c = B.table(spark, sf, "conversations")
    text = F.when(F.col("role") == "user", 'the name is "role_user" or "not a name"').otherwise(F.format_string('use ["f_%d", "%s", "f_%d"]', "turn", "role", "turn"))
    return P.parse_names(c.select("conv_id", "turn", text.alias("answer")), ["conv_id", "turn"])


@query("b10_parse_paths", """SELECT source, rank, path FROM (SELECT source, 0 AS rank, source||'/a.py' AS path, 1 AS o FROM documents UNION SELECT source, 1, source||'/x/'||m||'.py', 2 FROM (SELECT source, min(doc_id) AS m FROM documents GROUP BY source))""")
def b10p(spark, sf):
    d = B.documents(spark, sf)
    first = d.groupBy("source").agg(F.min("doc_id").alias("first"))
    valid = (d.select("source", F.concat("source", F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"))
             .unionByName(first.select("source", F.concat("source", F.lit("/a.py")).alias("path"))).unionByName(first.select("source", F.concat("source", F.lit("/b/__init__.py")).alias("path")))
             .unionByName(first.select("source", F.concat("source", F.lit("/c/__init__.py")).alias("path"))))
    text = F.concat(F.lit("Files:\n```\n1. "), F.col("source"), F.lit("/a.py\n__init__.py\n- x/"), F.col("first").cast("string"), F.lit(".py\nmade/up.py\n"), F.col("source"), F.lit("/a.py\n```"))
    return P.parse_paths(first.select("source", text.alias("answer")), valid, ["source"])


@query("b10_parse_path_list", """SELECT conv_id, turn, unnest(CASE role WHEN 'user' THEN [0,1] WHEN 'assistant' THEN [0,1] ELSE [] END) AS rank,
 unnest(CASE role WHEN 'user' THEN ['src/'||length(text)||'.py','a "b".txt'] WHEN 'assistant' THEN ['x/'||turn||'.py','y.py'] ELSE [] END) AS path FROM conversations""")
def b10l(spark, sf):
    c = B.table(spark, sf, "conversations")
    text = (F.when(F.col("role") == "user", F.format_string('Files: ["src/%d.py", %d, null, "a \\"b\\".txt"] and ["no.py"]', F.length("text"), "turn"))
            .when(F.col("role") == "assistant", F.format_string('I would edit ["x/%d.py" or "y.py", not "z.txt"', "turn")).otherwise('none: [] but not "q.py"'))
    return P.parse_path_list(c.select("conv_id", "turn", text.alias("answer")), ["conv_id", "turn"])


@query("b10_parse_triples", "SELECT conv_id, turn, 'src/'||role||'.py' AS file, 'f'||turn AS func, length(text) AS line, 0 AS ord FROM conversations")
def b10t(spark, sf):
    c = B.table(spark, sf, "conversations")
    row = F.format_string("file: src/%s.py, function: f%d, line: %d", "role", "turn", F.length("text"))
    text = F.concat(F.lit("so:\nLOCATIONS\n"), row, F.lit("\nnothing here\n"), row, F.lit("\nEND_LOCATIONS\nfile: no.py, function: g, line: 3"))
    return P.parse_triples(c.select("conv_id", "turn", text.alias("answer")), ["conv_id", "turn"])


@query("b10_yes_no", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'YES' WHEN 'assistant' THEN 'NO' END AS ans FROM conversations")
def b10y(spark, sf):
    c = B.table(spark, sf, "conversations")
    text = F.when(F.col("role") == "user", "I say yes, not no").when(F.col("role") == "assistant", "No. Yes").otherwise("none known")
    return c.select("conv_id", "turn", P.yes_no(text).alias("ans"))


@query("b10_keep_valid", "SELECT instance_id, sample, line, row_number() OVER (PARTITION BY instance_id, sample ORDER BY rank)-1 AS rank FROM votes SEMI JOIN executed USING (instance_id, line)", "votes", "executed")
def b10k(spark, sf):
    return P.keep_valid(B.votes(spark, sf), B.vote_executed(spark, sf), ["instance_id", "sample"], ["instance_id"])


@query("b12_skeleton", """SELECT doc_id, 'class C'||doc_id||'(Base)  [L1-'||n_lines||']'||chr(10)||string_agg(row, chr(10) ORDER BY p, i) AS skeleton FROM
 (SELECT doc_id, n_lines, 0 AS p, i, 'def C'||doc_id||'.f'||i||'(self, a, b)  [L'||(i*10+1)||'-'||least(i*10+10,n_lines)||']'||CASE WHEN i+1<=(n_lines-1)//10 THEN '  -> calls: f'||(i+1) ELSE '' END AS row FROM sizes, unnest(range(0, least(3,(n_lines-1)//10+1))) t(i)
  UNION ALL SELECT doc_id, n_lines, 1, 0, '... (+'||((n_lines-1)//10+1-3)||' more functions)' FROM sizes WHERE (n_lines-1)//10+1>3) GROUP BY doc_id, n_lines""", "sizes")
def b12(spark, sf):
    s = B.doc_sizes(spark, sf)
    classes = s.select("doc_id", F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("name"), F.lit(1).alias("start"), F.col("n_lines").alias("end"), F.array(F.lit("Base")).alias("bases"))
    i = F.regexp_extract("name", r"(\d+)", 1).cast("int")
    funcs = B.spans(spark, sf).filter("name like 'f%'").select("doc_id", "name", "start", "end", F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("class_name"), i.alias("seq"),
                                                              F.array(*[F.lit(x) for x in ("self", "a", "b")]).alias("args"),
                                                              F.array(F.concat(F.lit("f"), (i + 1).cast("string")), F.lit("print")).alias("calls"))
    return P.skeleton(classes, funcs, D, 3)


@query("b13_normalize_path", r"""SELECT doc_id, p AS path, (NOT regexp_matches(p, '/tests/|conftest') AND NOT regexp_matches(p, '(^|/)test_[^/]*$')) AS repo_source, regexp_matches(p, '(^|/)test_[^/]*$') AS test_file FROM
 (SELECT doc_id, CASE lang WHEN 'en' THEN 'src/'||doc_id||'.py' WHEN 'fr' THEN 'pkg/tests/test_'||doc_id||'.py' WHEN 'de' THEN 'lib/test_'||doc_id||'.py' ELSE 'x/conftest.py' END AS p FROM documents)""")
def b13(spark, sf):
    d = B.documents(spark, sf)
    i = F.col("doc_id").cast("string")
    raw = (F.when(F.col("lang") == "en", F.concat(F.lit("/testbed/src/"), i, F.lit(".py"))).when(F.col("lang") == "fr", F.concat(F.lit("pkg\\tests\\test_"), i, F.lit(".py")))
           .when(F.col("lang") == "de", F.concat(F.lit("./lib/test_"), i, F.lit(".py"))).otherwise("x/conftest.py"))
    p = P.normalize_path(raw)
    return d.select("doc_id", p.alias("path"), P.is_repo_source(p).alias("repo_source"), P.is_test_file(p).alias("test_file"))


def evidence_rows(spark, sf):
    d = B.documents(spark, sf)
    third = F.coalesce(F.get(F.split("text", "\n"), F.lit(2)), F.lit("none"))
    test = (F.when(F.col("lang") == "en", "+++ b/t.py\n+    call()\n+    assert value == 1").when(F.col("lang") == "fr", F.concat(F.lit("+check "), third)).otherwise("+    call()\n+    other()"))
    return d.select("doc_id", F.array(F.concat(F.lit("t_"), F.col("doc_id").cast("string"))).alias("failing"), test.alias("test_patch"), F.col("text").alias("problem"))


HEADS = "'Failing test(s): t_'||doc_id||chr(10)||chr(10)||'Test code / assertions (what it expects):'||chr(10)"
cte("evid", f"""SELECT doc_id, ({HEADS}||CASE lang WHEN 'en' THEN '    assert value == 1' WHEN 'fr' THEN 'check '||coalesce(l3,'none')[1:154] ELSE '    call()'||chr(10)||'    other()' END)[1:1600] AS evidence,
 (lang='en' OR (lang='fr' AND regexp_matches('check '||coalesce(l3,'none'), 'assert|raises|expect|==|!=|approx|isclose|pytest|with .*:'))) AS fired FROM (SELECT *, string_split(text, chr(10))[3] AS l3 FROM documents)""")


@query("b14_test_evidence", "SELECT * FROM evid", "evid")
def b14(spark, sf):
    return P.test_evidence(evidence_rows(spark, sf), D)


cte("leaky", rf"SELECT DISTINCT doc_id FROM evid e JOIN (SELECT c.doc_id, {STRIP.format('text')} AS q FROM cleaned c JOIN lines l ON l.doc_id=c.doc_id AND l.line_no=c.line) USING (doc_id) WHERE length(q)>=4 AND contains(evidence, q)", "evid", "cleaned", "lines")


@query("c10_primary_group", "SELECT doc_id FROM evid WHERE fired AND doc_id NOT IN (SELECT doc_id FROM leaky)", "evid", "leaky")
def c10(spark, sf):
    ev = P.test_evidence(evidence_rows(spark, sf), D)
    quotes = cleaned(spark, sf).join(B.lines(spark, sf).withColumnRenamed("line_no", "line"), ["doc_id", "line"]).select("doc_id", F.col("text").alias("quote"))
    return K.primary_group(ev.select("doc_id"), ev, J.text_contains_join(ev, quotes, D), D)


@query("c10_leak_instances", "SELECT * FROM leaky", "leaky")
def c10l(spark, sf):
    ev = P.test_evidence(evidence_rows(spark, sf), D)
    quotes = cleaned(spark, sf).join(B.lines(spark, sf).withColumnRenamed("line_no", "line"), ["doc_id", "line"]).select("doc_id", F.col("text").alias("quote"))
    return J.text_contains_join(ev, quotes, D)


@query("b15_edit_blocks", """SELECT doc_id, 0 AS block, s AS start, s+1 AS "end" FROM (SELECT doc_id, 1+length(pre)-length(replace(pre,chr(10),'')) AS s FROM (SELECT d.doc_id, d.text[1:instr(d.text, q)-1] AS pre FROM
 (SELECT doc_id, text, string_split(text,chr(10))[2]||chr(10)||string_split(text,chr(10))[3] AS q, len(string_split(text,chr(10))) AS n FROM documents) d WHERE n>=3 AND length(replace(replace(q,chr(10),''),' ',''))>0))""")
def b15(spark, sf):
    d = B.documents(spark, sf)
    parts = F.split("text", "\n")
    answer = F.concat(F.lit("Fix:\n<<<<<<< SEARCH\n2: "), parts[1], F.lit("\n3: "), parts[2], F.lit("\n=======\nnew\n>>>>>>> REPLACE\n<<<<<<< SEARCH\nno such text anywhere\n=======\nx\n>>>>>>> REPLACE"))
    return P.edit_blocks(d.filter(F.size(parts) >= 3).select("doc_id", answer.alias("answer")), d, D)


@query("b15_edit_blocks_files", """SELECT inst, file, block, s AS start, s+1 AS "end" FROM (SELECT inst, file, block, 1+length(pre)-length(replace(pre,chr(10),'')) AS s FROM (SELECT *, text[1:instr(text, q)-1] AS pre FROM
 (SELECT doc_id//2 AS inst, 'docs/'||doc_id||'.py' AS file, text, row_number() OVER (PARTITION BY doc_id//2 ORDER BY doc_id)-1 AS block, string_split(text,chr(10))[2]||chr(10)||string_split(text,chr(10))[3] AS q FROM documents
  WHERE len(string_split(text,chr(10)))>=3) WHERE length(replace(replace(q,chr(10),''),' ',''))>0))""")
def b15f(spark, sf):
    """Two files to an instance, and an answer with a block for each that has three lines, and one for a file that is not there."""
    d = B.documents(spark, sf).select(F.floor(F.col("doc_id") / 2).alias("inst"), "doc_id", F.format_string("docs/%d.py", "doc_id").alias("file"), "text")
    parts = F.split("text", "\n")
    block = F.concat(F.lit("<<<<<<< SEARCH file="), F.col("file"), F.lit("\n2: "), parts[1], F.lit("\n3: "), parts[2], F.lit("\n=======\nnew\n>>>>>>> REPLACE\n"))
    two = d.filter(F.size(parts) >= 3).groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("doc_id", block.alias("b")))).alias("bs"))
    answer = F.concat(F.array_join(F.transform("bs", lambda x: x["b"]), ""), F.lit("<<<<<<< SEARCH file=gone.py\n"), F.element_at(F.split(F.col("bs")[0]["b"], "\n"), 2), F.lit("\n=======\nx\n>>>>>>> REPLACE"))
    return P.edit_blocks(two.select("inst", answer.alias("answer")), d, ["inst"], file="file")


@query("b16_called_files", """SELECT DISTINCT instance_id, file FROM (SELECT l_partkey AS instance_id, l_returnflag AS file, l_suppkey AS line FROM lineitem) WHERE line%10 BETWEEN 3 AND 7""")
def b16(spark, sf):
    executed = B.vote_source(spark, sf).select("instance_id", F.col("l_returnflag").alias("file"), "line").distinct()
    low = F.floor(F.col("line") / 10) * 10
    bodies = executed.select("instance_id", "file", (low + 3).alias("body_start"), (low + 7).alias("end")).distinct()
    return P.called_files(executed, bodies, ["instance_id"])


# ---- labels over traces and patches -----------------------------------------------------

@query("c1_is_crash", """SELECT event_id, CASE event_type WHEN 'error' THEN 'traceback' WHEN 'view' THEN 'frames>=2' WHEN 'purchase' THEN 'raises' ELSE 'none' END AS rule,
 CASE event_type WHEN 'error' THEN ('Traceback (most recent call last):'||chr(10)||'  '||f1||chr(10)||'    run()'||chr(10)||'  '||f2)[1:80] WHEN 'view' THEN regexp_replace(f1, ', in .*', '')||' | '||regexp_replace(f2, ', in .*', '')
 WHEN 'purchase' THEN '+    with pytest.raises(ValueError):' ELSE '' END AS evidence, event_type IN ('error','view') AS strict, event_type IN ('error','click','purchase') AS alt FROM trace_tail""", "trace_tail")
def c1(spark, sf):
    p, t = F.col("text"), F.col("test_patch")
    return B.traces(spark, sf).select("event_id", K.crash_rule(p, t).alias("rule"), K.crash_evidence(p, t).alias("evidence"),
                                      K.is_crash_strict(p).alias("strict"), K.is_crash_alt(p, t).alias("alt"))


@query("c9_fail_mode", "SELECT event_id, CASE event_type WHEN 'error' THEN 'crash' WHEN 'view' THEN 'assertion' WHEN 'click' THEN 'reproduced_unclear' ELSE 'not_reproduced' END AS mode FROM ev", "ev")
def c9(spark, sf):
    log = (F.when(F.col("event_type") == "error", F.concat("text", F.lit("\n1 failed"))).when(F.col("event_type") == "view", "AssertionError: x\n2 failed in 3s")
           .when(F.col("event_type") == "click", "FAILED (failures=1)").when(F.col("event_type") == "purchase", F.concat("text", F.lit("\n3 passed"))).otherwise("ValueError\n1 failed"))
    return B.traces(spark, sf).select("event_id", K.fail_mode(log, F.col("event_type") != "signup").alias("mode"))


@query("c3_select_pool", """SELECT rule, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, unnest(list_concat(CASE lang WHEN 'en' THEN ['single_py','one_file'] WHEN 'de' THEN ['multi_py'] ELSE ['single_py'] END,
 CASE WHEN n_lines>=3 THEN ['all_py'] ELSE []::VARCHAR[] END)) AS rule FROM documents JOIN sizes USING (doc_id)) GROUP BY ALL""", "sizes")
def c3(spark, sf):
    shape = K.patch_shape(P.patch_files(B.patches(spark, sf), D), edits(spark, sf), D)
    inst = B.documents(spark, sf).select("doc_id", F.lit(True).alias("has_failing"))
    out = None
    for rule in ("single_py", "one_file", "multi_py", "all_py"):
        part = K.select_pool(inst, shape, D, rule).agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))
        out = part if out is None else out.unionByName(part)
    return out


def funnel_steps():
    return [("single_py", F.col("lang") != "de"), ("crash", F.contains("text", F.lit(","))), ("code_gold", F.col("n_chars") >= 500), ("quality", F.col("source").isNotNull())]


@query("c5_selection_funnel", """SELECT step, name, n FROM (SELECT count(*) AS a, count(*) FILTER (lang<>'de') AS b, count(*) FILTER (lang<>'de' AND contains(text,',')) AS c, count(*) FILTER (lang<>'de' AND contains(text,',') AND n_chars>=500) AS d FROM documents),
 LATERAL (VALUES (0,'total',a),(1,'single_py',b),(2,'crash',c),(3,'code_gold',d),(4,'quality',d)) t(step,name,n)""")
def c5(spark, sf):
    return K.selection_funnel(B.documents(spark, sf), funnel_steps())


@query("c5_dropped_at", "SELECT doc_id, CASE WHEN lang='de' THEN 'single_py' WHEN NOT contains(text,',') THEN 'crash' ELSE 'code_gold' END AS dropped_at FROM documents WHERE NOT (lang<>'de' AND contains(text,',') AND n_chars>=500)")
def c5d(spark, sf):
    return K.dropped_at(B.documents(spark, sf), funnel_steps(), "doc_id")


@query("c13_exclude_list", "SELECT doc_id, CASE WHEN toxic=1 THEN 'toxic' WHEN quality=0 THEN 'low quality' END AS reason, CASE WHEN toxic=1 OR quality=0 THEN 'excluded' ELSE 'confirmed' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def c13(spark, sf):
    bad = B.table(spark, sf, "labels").withColumn("reason", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low quality")).filter("reason is not null")
    return K.apply_exclusions(B.documents(spark, sf).select("doc_id"), bad, "doc_id")


# ---- frames against gold ------------------------------------------------------------------

def frame_gold(spark, sf):
    return B.traces(spark, sf).select("event_id", F.when(F.col("value") < 20, "src/error.py").when(F.col("value") < 40, F.concat(F.lit("pkg/lib/m"), (F.col("k") % 5).cast("string"), F.lit(".py")))
                                      .otherwise("else/where.py").alias("file"), (F.col("k") + 1).alias("line"))


@query("d9_frames_to_gold", """SELECT event_id, 2 AS n_frames, file_hit, deep_hit, func_hit, NOT file_hit AND NOT func_hit AS neither FROM (SELECT event_id, (value<20 AND event_type='error') OR (value>=20 AND value<40) AS file_hit, (value>=20 AND value<40) AS deep_hit, k%2=0 AS func_hit
 FROM ev WHERE event_type IN ('error','view'))""", "ev")
def d9(spark, sf):
    t = B.traces(spark, sf)
    gold = frame_gold(spark, sf)
    funcs = gold.join(t.select("event_id", "user_id", "k"), "event_id").select(
        "event_id", "file", F.when(F.col("k") % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise("other").alias("name"), F.greatest(F.lit(1), F.col("line") - 2).alias("start"), (F.col("line") + 2).alias("end"))
    return J.frames_to_gold(P.traceback_frames(t, E), gold, funcs, E)


# ---- spectrum labels ------------------------------------------------------------------------

R_ = ["user_id", "day"]


def runs(spark, sf):
    """Runs are user-days of events; a run fails when it holds an error; it covers the k of its other
    events. Line = k, file = k div 10."""
    e = B.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("line"))
    return e.withColumn("file", F.floor(F.col("line") / 10).cast("int"))


cte("rn", "SELECT user_id, ts::DATE AS day, event_type, (props->>'$.k')::INT AS line, (props->>'$.k')::INT//10 AS file FROM events")
cte("rcov", "SELECT DISTINCT user_id, day, file, line FROM rn WHERE event_type<>'error'", "rn")
cte("rgold", "SELECT DISTINCT user_id, day, file, line FROM rn WHERE event_type IN ('error','purchase')", "rn")


def run_cov(spark, sf):
    return runs(spark, sf).filter("event_type <> 'error'").select(*R_, "file", "line").distinct()


def run_gold(spark, sf):
    return runs(spark, sf).filter("event_type in ('error', 'purchase')").select(*R_, "file", "line").distinct()


@query("c2_assign_quadrant", """SELECT user_id, day, CASE WHEN c.user_id IS NULL THEN 'nocov' ELSE CASE WHEN failing THEN 'crash' ELSE 'behav' END||CASE WHEN hit>0 THEN '_onpath' ELSE '_offpath' END END AS subset, p.file FROM
 (SELECT user_id, day, bool_or(event_type='error') AS failing FROM rn GROUP BY ALL) LEFT JOIN (SELECT DISTINCT user_id, day FROM rcov) c USING (user_id, day)
 LEFT JOIN (SELECT user_id, day, arg_min(file, file) AS file, arg_min(h, file) AS hit FROM (SELECT g.user_id, g.day, g.file, count(c.line) AS h FROM rgold g LEFT JOIN rcov c USING (user_id, day, file, line)
  WHERE EXISTS(FROM rcov x WHERE x.user_id=g.user_id AND x.day=g.day AND x.file=g.file) GROUP BY ALL) GROUP BY ALL) p USING (user_id, day) WHERE c.user_id IS NULL OR p.file IS NOT NULL""", "rn", "rcov", "rgold")
def c2(spark, sf):
    inst = runs(spark, sf).groupBy(*R_).agg(F.max(F.col("event_type") == "error").alias("crash"))
    return K.assign_quadrant(inst, run_gold(spark, sf).withColumn("file_ord", F.col("file")), run_cov(spark, sf), R_)


@query("c7_offpath_mechanism", """SELECT user_id, day, CASE WHEN d IS NULL THEN 'other' WHEN d=0 THEN 'insertion' WHEN ran THEN 'missed-branch' ELSE 'func-never-reached' END AS mechanism FROM (SELECT DISTINCT user_id, day FROM rn)
 LEFT JOIN (SELECT user_id, day, max((kind='deleted')::INT) AS d, bool_or(EXISTS(FROM rcov c WHERE c.user_id=g.user_id AND c.day=g.day AND c.file=g.file AND c.line//5=g.line//5)) AS ran FROM
  (SELECT DISTINCT user_id, day, file, line, CASE WHEN event_type='error' THEN 'deleted' ELSE 'anchor' END AS kind FROM rn WHERE event_type IN ('error','purchase') AND file%5<>4
   QUALIFY file=min(file) OVER (PARTITION BY user_id, day)) g GROUP BY ALL) USING (user_id, day)""", "rn", "rcov")
def c7(spark, sf):
    r = runs(spark, sf)
    r = r.withColumn("file_ord", F.col("file")).withColumn("file", F.concat(F.lit("m"), F.col("file"), F.when(F.col("file") % 5 == 4, ".txt").otherwise(".py")))
    ed = r.filter("event_type in ('error', 'purchase')").select(*R_, "file", "file_ord", "line", F.when(F.col("event_type") == "error", "deleted").otherwise("anchor").alias("kind")).distinct()
    low = (F.floor(F.col("line") / 5) * 5).cast("int")
    funcs = r.select(*R_, "file", low.cast("string").alias("name"), low.alias("start"), (low + 4).alias("end")).distinct()
    return K.offpath_mechanism(r.select(*R_).distinct(), ed, funcs, r.filter("event_type <> 'error'").select(*R_, "file", "line").distinct(), R_)


MISS = """SELECT g.user_id, g.day, g.file, g.line, CASE WHEN NOT EXISTS(FROM rcov x WHERE x.user_id=g.user_id AND x.day=g.day AND x.file=g.file) THEN 'outfile'
 WHEN EXISTS(FROM rcov x WHERE x.user_id=g.user_id AND x.day=g.day AND x.file=g.file AND x.line=g.line) THEN 'infile_exec'
 WHEN EXISTS(FROM rcov x WHERE x.user_id=g.user_id AND x.day=g.day AND x.file=g.file AND abs(x.line-g.line)<=2) THEN 'infile_adj' ELSE 'infile_far' END AS category FROM (SELECT DISTINCT user_id, day, file, line FROM rn WHERE event_type='error') g"""
cte("misscat", MISS, "rn", "rcov")


def miss(spark, sf):
    cov = run_cov(spark, sf)
    missed = runs(spark, sf).filter("event_type = 'error'").select(*R_, "file", "line").distinct()
    return K.miss_category(missed, cov, cov, R_)


@query("c8_miss_category", "SELECT * FROM misscat", "misscat")
def c8(spark, sf):
    return miss(spark, sf)


@query("c8_recoverable_instances", "SELECT user_id, day, count(*) AS missed, bool_and(category IN ('infile_exec','infile_adj')) AS recoverable FROM misscat GROUP BY ALL", "misscat")
def c8r(spark, sf):
    return K.recoverable_instances(miss(spark, sf), R_)
