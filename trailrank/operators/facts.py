"""Facts of Python source files, one parse per file inside Arrow batches.

Parsing needs Python's own grammar, so this is the one operator with Python workers. It only
reads facts off the syntax tree; resolving names, def-use links and spans is left to joins."""
from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

FACT_COLUMNS = ("kind string, name string, start int, end int, body_start int, owner string, seq int, "
                "args array<string>, refs array<string>, defs array<string>, uses array<string>")
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _last_name(node: ast.AST) -> str | None:
    return getattr(node, "id", None) or getattr(node, "attr", None)


def _row(kind, name=None, start=None, end=None, body_start=None, owner=None, seq=0, args=(), refs=(), defs=(), uses=()):
    return (kind, name, start, end, body_start, owner, seq, list(args), sorted(set(refs)), sorted(set(defs)), sorted(set(uses)))


def _variables(tree: ast.AST) -> tuple[set, set]:
    names = [n for n in ast.walk(tree) if isinstance(n, ast.Name)]
    defs = {n.id for n in names if not isinstance(n.ctx, ast.Load)} | {n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)}
    return defs, {n.id for n in names if isinstance(n.ctx, ast.Load)}


def _parameters(a: ast.arguments) -> list[str]:
    return [x.arg for x in [*a.args, *a.kwonlyargs]]


def _statements(tree: ast.AST) -> list[ast.AST]:
    """As ``ast.walk``, without expressions, which hold no statement."""
    nodes = [tree]
    for n in nodes:  # grows
        nodes.extend(c for c in ast.iter_child_nodes(n) if not isinstance(c, ast.expr))
    return nodes


def _calls(tree: ast.AST) -> set[str]:
    """Last names of what is called somewhere inside."""
    names, left = set(), [tree]
    while left:
        n = left.pop()
        if isinstance(n, ast.Call):
            names.add(_last_name(n.func))
        for v in vars(n).values():
            if isinstance(v, list):
                left.extend(x for x in v if isinstance(x, ast.AST))
            elif isinstance(v, ast.AST):
                left.append(v)
    return {x for x in names if x}


def file_facts(text: str, kinds: frozenset[str] = frozenset()) -> list[tuple]:
    """Rows of one file: status, class, function, statement, import, or only those ``kinds``. Statements are the top-level
    statements of a function body; a ``header`` statement defines the parameters."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [_row("status", "error")] if "status" in (kinds or ("status",)) else []
    wanted = lambda kind: not kinds or kind in kinds
    nodes = _statements(tree)
    classes = [n for n in nodes if isinstance(n, ast.ClassDef)]
    rows = [_row("status", "ok")] if wanted("status") else []
    if wanted("class"):
        rows += [_row("class", c.name, c.lineno, c.end_lineno, refs=filter(None, map(_last_name, c.bases)), seq=i) for i, c in enumerate(classes)]
    for i, f in enumerate(n for n in nodes if isinstance(n, _DEFS)):
        if wanted("function"):
            inside = [c for c in classes if c.lineno <= f.lineno <= c.end_lineno]
            owner = inside[-1].name if inside else None
            rows.append(_row("function", f.name, f.lineno, f.end_lineno, f.body[0].lineno, owner, i, _parameters(f.args), _calls(f)))
        if wanted("header"):
            extra = [a.arg for a in (f.args.vararg, f.args.kwarg) if a]
            rows.append(_row("header", f.name, f.lineno, f.lineno, seq=i, defs=[*_parameters(f.args), *extra]))
        for s in f.body if wanted("statement") else ():
            defs, uses = _variables(s)
            rows.append(_row("statement", f.name, s.lineno, s.end_lineno, seq=i, defs=defs, uses=uses))
    for n in nodes if wanted("import") else ():
        if isinstance(n, ast.Import):
            rows += [_row("import", a.name) for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module:
            rows += [_row("import", n.module), *[_row("import", f"{n.module}.{a.name}") for a in n.names]]
    return rows


#: Facts that leave a worker at a time.
FACTS = 10_000


def code_facts(files: DataFrame, keys: list[str], text: str = "text", kinds: tuple[str, ...] = ()) -> DataFrame:
    """Facts of all files in one table; ``kinds`` limits what leaves the Python workers (a filter
    after them cannot move below). Files that do not parse give one ``status`` row named ``error``."""
    source = files.select(*keys, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != text), FACT_COLUMNS])
    wanted, arrow = frozenset(kinds), list(to_arrow_schema(T.StructType.fromDDL(FACT_COLUMNS)))

    def table(batch: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array(of, pa.int64())
        columns = {**{k: batch.column(i).take(at) for i, k in enumerate(keys)}, **{f.name: pa.array(v, f.type) for f, v in zip(arrow, zip(*rows))}}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []
            for i, text in enumerate(batch.column(len(keys))):
                for fact in file_facts(text.as_py() or "", wanted):
                    of.append(i)
                    rows.append(fact)
                    if len(rows) >= FACTS:
                        yield table(batch, of, rows)
                        of, rows = [], []
            if rows:
                yield table(batch, of, rows)

    return source.mapInArrow(parse, schema)


def functions(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.filter("kind = 'function'").select(*keys, "name", "start", "end", "body_start", F.col("owner").alias("class_name"), "seq", "args",
                                                    F.col("refs").alias("calls"))


def classes(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.filter("kind = 'class'").select(*keys, "name", "start", "end", F.col("refs").alias("bases"))


def imports(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.filter("kind = 'import'").select(*keys, F.col("name").alias("module")).distinct()


def statements(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stmt, end): the longest span of every statement line."""
    return facts.filter("kind = 'statement'").groupBy(*keys, F.col("start").alias("stmt")).agg(F.max("end").alias("end"))


def variable_events(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, func, stmt, var, kind) rows for the as-of join of uses to definitions."""
    rows = facts.filter("kind in ('statement', 'header')").select(*keys, F.col("seq").alias("func"), F.col("start").alias("stmt"), "defs", "uses")
    d = rows.select(*keys, "func", "stmt", F.explode("defs").alias("var"), F.lit("def").alias("kind"))
    u = rows.select(*keys, "func", "stmt", F.explode("uses").alias("var"), F.lit("use").alias("kind"))
    return d.unionByName(u)
