"""Queries over parsed Python sources."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailrank.functions.ordered import written
from trailrank.operators import facts as A
from trailrank.operators import joins as J
from trailrank.operators import parse as P
from trailrank.plans import bindings as B
from trailrank.plans.registry import query

D = ["doc_id"]


def facts(spark, sf, *kinds):
    return A.code_facts(B.python_files(spark, sf), D, kinds=kinds)


@query("b11_code_facts", """SELECT doc_id, 'f'||i AS name, 9+5*i AS start, 12+5*i AS "end", 10+5*i AS body_start, NULL AS class_name, i AS seq, 'x,y' AS args, 'f'||(i+1) AS calls FROM pyf
 UNION ALL SELECT doc_id, 'm', 5, 7, 6, 'C', nb, 'self,a', '' FROM pyf WHERE i=0""", "pyf")
def b11(spark, sf):
    return A.functions(facts(spark, sf, "function"), D).withColumns({"args": F.array_join("args", ","), "calls": F.array_join("calls", ",")})


@query("b11_parse_status", "SELECT doc_id, CASE WHEN lang='fr' THEN 'error' ELSE 'ok' END AS status FROM documents")
def b11s(spark, sf):
    return facts(spark, sf, "status").select("doc_id", F.col("name").alias("status"))


@query("b11_def_use", """SELECT doc_id, i AS func, v AS var, 9+5*i+u AS stmt, 9+5*i+d AS def_stmt FROM pyf, (VALUES ('x',1,0),('y',1,0),('t',2,1),('u',3,2)) t(v,u,d)
 UNION ALL SELECT doc_id, nb, v, u, d FROM pyf, (VALUES ('a',6,5),('b',7,6)) t(v,u,d) WHERE i=0""", "pyf")
def b11d(spark, sf):
    return J.last_definition(A.variable_events(facts(spark, sf, "statement", "header"), D), ["doc_id", "func"], ["stmt"], sliced=False)


@query("b11_statements", """SELECT doc_id, 9+5*i+u AS stmt, 9+5*i+u AS "end" FROM pyf, (VALUES (1),(2),(3)) t(u) UNION ALL SELECT doc_id, u, u FROM pyf, (VALUES (6),(7)) t(u) WHERE i=0""", "pyf")
def b11t(spark, sf):
    return A.statements(facts(spark, sf, "statement"), D)


@query("b11_imports", "SELECT doc_id, m AS module FROM pyf, (VALUES ('os'),('pkg.mod'),('pkg.mod.name')) t(m) WHERE i=0", "pyf")
def b11i(spark, sf):
    return A.imports(facts(spark, sf, "import"), D)


@query("b12_skeleton_from_source", """SELECT doc_id, 'class C  [L4-7]'||chr(10)||string_agg('def f'||i||'(x, y)  [L'||(9+5*i)||'-'||(12+5*i)||']'||CASE WHEN i+1<nb THEN '  -> calls: f'||(i+1) ELSE '' END, chr(10) ORDER BY i) FILTER (i<20)
 ||CASE WHEN nb<20 THEN chr(10)||'def C.m(self, a)  [L5-7]' ELSE '' END||CASE WHEN nb+1>20 THEN chr(10)||'... (+'||(nb+1-20)||' more functions)' ELSE '' END AS skeleton FROM pyf GROUP BY doc_id, nb""", "pyf")
def b12s(spark, sf):
    f = written(facts(spark, sf, "class", "function"), "facts")  # the outline reads them five times
    return P.skeleton(A.classes(f, D), A.functions(f, D), D, 20)


@query("d3_line_in_function_from_source", """SELECT doc_id, line, CASE WHEN line BETWEEN 5 AND 7 THEN 'm' WHEN line>=9 AND (line-9)%5<>4 THEN 'f'||((line-9)//5) END AS name FROM (SELECT DISTINCT doc_id, nb FROM pyf), unnest(range(1, 8+5*nb)) t(line)""", "pyf")
def d3s(spark, sf):
    f = facts(spark, sf, "status", "function")
    ok = f.filter("kind = 'status' and name = 'ok'").select("doc_id")
    lines = P.numbered_lines(B.python_files(spark, sf).join(ok, "doc_id"), D, line_no="line").select("doc_id", "line")
    return J.line_in_function(lines, A.functions(f, D), D).select("doc_id", "line", "name")
