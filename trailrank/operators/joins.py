"""Joins of lines, functions, paths, frames and captured values. Band, range and suffix
conditions are exploded on one side so that every join is an equality join."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailrank.functions.columns import strip
from trailrank.functions.ordered import first_k, running_last
from trailrank.operators.parse import path_suffixes
from trailrank.operators.rank import renumber


def _char_suffixes(path):
    return F.transform(F.sequence(F.lit(1), F.length(path)), lambda i: F.substr(path, i, F.length(path)))


def _tail_keys(tails):
    """Length and hash of each tail: a row per tail of a path costs the same, however long the tail is."""
    return F.transform(tails, lambda t: F.struct(F.length(t).alias("n"), F.xxhash64(t).alias("h")))


def path_suffix_join(wanted: DataFrame, known: DataFrame, keys: list[str], mode: str = "boundary") -> DataFrame:
    """Match each wanted path (keys, path) to one known path (keys, known, file_ord): the equal one,
    else the first suffix match by ``file_ord``.

    ``boundary``: one path is a tail of the other after a slash. ``suffix``: plain string suffix either
    way. ``basename``: known ends with wanted, or wanted ends with known's base name (pairs
    ``sym_expr.py`` with ``expr.py``; kept for recorded results). Tails meet by length and hash, and what met is compared as text."""
    w, k = F.col("path"), F.col("known")
    tails = path_suffixes if mode == "boundary" else _char_suffixes
    left = wanted.select(*keys, "path").distinct()

    def one_per_tail(rows: DataFrame, best) -> DataFrame:
        return rows.groupBy(*keys, "_s").agg(F.min_by("known", best).alias("known"), F.min_by("file_ord", best).alias("file_ord"))

    # a tail keeps one candidate before the join: the equal path, else the first in file order
    whole = F.substring_index(k, "/", -1) if mode == "basename" else k
    a = one_per_tail(known.withColumn("_s", F.explode(_tail_keys(tails(k)))), F.struct(F.length(k) != F.col("_s.n"), F.col("file_ord")))
    a = a.join(left.withColumn("_s", _tail_keys(F.array(w))[0]), [*keys, "_s"]).filter(F.endswith(k, w))
    b = one_per_tail(known.withColumn("_s", _tail_keys(F.array(whole))[0]), F.struct("file_ord"))
    b = b.join(left.withColumn("_s", F.explode(_tail_keys(tails(w)))), [*keys, "_s"]).filter(F.endswith(w, whole))
    both = a.select(*keys, "path", "known", "file_ord").unionByName(b.select(*keys, "path", "known", "file_ord"))
    return both.groupBy(*keys, "path").agg(F.min_by("known", F.struct(w != k, F.col("file_ord"))).alias("known"))


def coverage_semi(ranking: DataFrame, executed: DataFrame, keys: list[str], item: list[str], rank_keys: list[str] | None = None) -> DataFrame:
    """Keep the executed items of a ranking and close the gaps in ``pos``."""
    kept = ranking.join(executed.select(*keys, *item).distinct(), [*keys, *item], "left_semi")
    return renumber(kept, rank_keys or keys)


def function_of_line(functions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, name, start, end) with the innermost function of every covered line."""
    spans = functions.select(*keys, "name", "start", "end", F.explode(F.sequence("start", "end")).alias("line"))
    best = spans.groupBy(*keys, "line").agg(F.max_by(F.struct("name", "start", "end"), F.struct(F.col("start"), -F.col("end"), F.col("name"))).alias("_f"))
    return best.select(*keys, "line", "_f.*")


def line_in_function(lines: DataFrame, functions: DataFrame, keys: list[str]) -> DataFrame:
    return lines.join(function_of_line(functions, keys), [*keys, "line"], "left")


def context_window(centers: DataFrame, functions: DataFrame, sizes: DataFrame, keys: list[str], width: int, cap: int) -> DataFrame:
    """Lines around each center: its whole function when that is at most ``cap`` lines, else
    ``width`` lines either side, clipped to the file."""
    j = line_in_function(centers.select(*keys, "line").distinct(), functions, keys).join(sizes, keys)
    whole = F.col("start").isNotNull() & (F.col("end") - F.col("start") + 1 <= cap)
    low = F.when(whole, F.col("start")).otherwise(F.greatest(F.lit(1), F.col("line") - width))
    high = F.when(whole, F.col("end")).otherwise(F.least(F.col("n_lines"), F.col("line") + width))
    return j.select(*keys, F.explode(F.when(high >= low, F.sequence(low, high))).alias("line")).distinct()


def frontier_band(items: DataFrame, executed: DataFrame, keys: list[str], line: str = "line", delta: int = 2) -> DataFrame:
    """Items within ``delta`` lines of an executed line."""
    band = executed.select(*keys, F.explode(F.sequence(F.col(line) - delta, F.col(line) + delta)).alias(line)).distinct()
    return items.join(band, [*keys, line], "left_semi")


def frontier_sweep(items: DataFrame, executed: DataFrame, keys: list[str], deltas: list[int], line: str = "line") -> DataFrame:
    """Distance of each item to the nearest executed line within the widest band; an item belongs to
    every delta at or above it."""
    widest = max(deltas)
    band = (executed.select(*keys, F.col(line).alias("_l")).distinct()
            .withColumn(line, F.explode(F.sequence(F.col("_l") - widest, F.col("_l") + widest)))
            .groupBy(*keys, line).agg(F.min(F.abs(F.col(line) - F.col("_l"))).alias("_d")))
    steps = F.filter(F.array(*[F.lit(d) for d in deltas]), lambda d: d >= F.col("_d"))
    return items.join(band, [*keys, line]).withColumn("delta", F.explode(steps)).drop("_d")


def last_definition(statements: DataFrame, scope: list[str], stmt: list[str], var: str = "var", sliced: bool | None = None) -> DataFrame:
    """As-of join: each use of a variable with the statement that last defined it before, inside the
    scope. Rows: (scope, stmt..., var, kind in 'def'/'use'). A use comes before a definition in the
    same statement, and a definition in the same statement is not its own source. ``sliced=False`` skips
    the size check where a scope is known to be small (one function of one file)."""
    rows = statements.withColumn("_def", F.when(F.col("kind") == "def", F.struct(*stmt)))
    order = [*[F.asc(c) for c in stmt], F.desc("kind")]
    seen = running_last(rows, [*scope, var], order, "_def", "_last", sliced)
    me = F.struct(*stmt)
    uses = seen.filter("kind = 'use' and _last is not null").filter(F.col("_last") != me)
    return uses.select(*scope, var, *stmt, *[F.col(f"_last.{c}").alias(f"def_{c}") for c in stmt]).distinct()


def resolve_calls(calls: DataFrame, functions: DataFrame, keys: list[str], caller: str = "caller", name: str = "callee") -> DataFrame:
    """Call edges by name to every function of that name in the group; self-loops dropped. These are callers x functions rows for each
    name; traversals use ``call_links``, which are callers + functions."""
    targets = functions.select(*keys, F.col("name").alias(name), F.col("func_id").alias("target")).distinct()
    return (calls.select(*keys, caller, name).distinct().join(targets, [*keys, name])
            .filter(F.col(caller) != F.col("target")).select(*keys, F.col(caller).alias("src"), F.col("target").alias("dst")).distinct())


def call_links(calls: DataFrame, functions: DataFrame, keys: list[str], caller: str = "caller", name: str = "callee") -> DataFrame:
    """The same calls with the name as a node between callers and functions: (keys, src, dst), nodes are (of, id) with ``of`` f or n.
    A call is two steps long."""
    def node(of, c):
        return F.struct(F.lit(of).alias("of"), F.col(c).cast("string").alias("id"))
    up = calls.select(*keys, node("f", caller).alias("src"), node("n", name).alias("dst"))
    down = functions.select(*keys, node("n", "name").alias("src"), node("f", "func_id").alias("dst"))
    return up.unionByName(down).distinct()


def resolve_imports(imports: DataFrame, paths: DataFrame, present: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """Files a set of files imports and does not hold yet, in name order, at most ``most`` per group.
    ``imports``: (keys, module); ``paths``: (keys, path)."""
    dotted = F.regexp_replace(F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")
    known = paths.select(*keys, "path", dotted.alias("module"))
    near = imports.select(*keys, "module").distinct().join(known, [*keys, "module"]).select(*keys, "path").distinct()
    return first_k(near.join(present.select(*keys, "path").distinct(), [*keys, "path"], "left_anti"), keys, [F.asc("path")], most)


def frames_to_gold(frames: DataFrame, gold: DataFrame, functions: DataFrame, keys: list[str]) -> DataFrame:
    """Per instance: some frame / the deepest frame names a gold file; a gold line lies in a function
    a frame names; neither. ``frames``: (keys, ord, path, func); ``gold``: (keys, file, line);
    ``functions``: (keys, file, name, start, end)."""
    deep = frames.groupBy(*keys).agg(F.max("ord").alias("_last"), F.count(F.lit(1)).alias("n_frames"))
    marked = frames.join(deep, keys).withColumn("_deep", F.col("ord") == F.col("_last"))
    known = marked.groupBy(*keys, F.col("path").alias("known")).agg(F.max("_deep").alias("_deep"), F.min("ord").alias("file_ord"))
    files = gold.select(*keys, F.col("file").alias("path")).distinct()
    a = known.withColumn("_s", F.explode(path_suffixes(F.col("known")))).join(files.withColumn("_s", F.col("path")), [*keys, "_s"])
    b = known.withColumn("_s", F.col("known")).join(files.withColumn("_s", F.explode(path_suffixes(F.col("path")))), [*keys, "_s"])
    hit = (a.select(*keys, "_deep").unionByName(b.select(*keys, "_deep")).groupBy(*keys).agg(F.lit(True).alias("file_hit"), F.max("_deep").alias("deep_hit")))
    named = frames.select(*keys, F.col("func").alias("name")).distinct()
    spans = functions.join(named, [*keys, "name"], "left_semi").select(*keys, "file", F.explode(F.sequence("start", "end")).alias("line")).distinct()
    inside = gold.join(spans, [*keys, "file", "line"], "left_semi").select(*keys).distinct().withColumn("func_hit", F.lit(True))
    base = deep.join(gold.select(*keys).distinct(), keys, "left_semi").drop("_last")
    out = base.join(hit, keys, "left").join(inside, keys, "left").fillna(False, ["file_hit", "deep_hit", "func_hit"])
    return out.withColumn("neither", ~F.col("file_hit") & ~F.col("func_hit"))


def text_contains_join(evidence: DataFrame, quotes: DataFrame, keys: list[str], shortest: int = 4) -> DataFrame:
    """Groups whose evidence text holds one of their own quoted lines verbatim: an equality join on
    the group, ``contains`` as the residual."""
    long_enough = quotes.select(*keys, strip(F.col("quote")).alias("quote")).filter(F.length("quote") >= shortest).distinct()
    return evidence.join(long_enough, keys).filter(F.contains("evidence", "quote")).select(*keys).distinct()


def value_context(values: DataFrame, centers: DataFrame, keys: list[str], span: int = 8, variables: int = 8, lines: int = 14) -> DataFrame:
    """Captured values on lines near each center, at most ``variables`` per line and ``lines`` lines,
    as one text. ``values``: (keys, line, var, repr)."""
    near = centers.select(*keys, "line").distinct().withColumn("at", F.explode(F.sequence(F.col("line") - span, F.col("line") + span)))
    few = first_k(values, [*keys, "line"], [F.asc("var")], variables).drop("pos").withColumnRenamed("line", "at")
    per_line = few.groupBy(*keys, "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("var", "repr"))),
                                                                     lambda x: F.concat(x["var"], F.lit("="), x["repr"])), ", ").alias("snap"))
    picked = first_k(near.join(per_line, [*keys, "at"]), [*keys, "line"], [F.asc("at")], lines)
    row = F.struct("at", F.concat(F.col("at").cast("string"), F.lit(" -> "), F.col("snap")).alias("row"))
    return picked.groupBy(*keys, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"]), "\n").alias("values"))


def recovered_by(gold: DataFrame, sources: dict[str, DataFrame], cols: list[str]) -> DataFrame:
    """Membership of every gold item in each source, counted by combination, with the recall of the
    growing unions a, a+b, a+b+c."""
    g = gold.select(*cols).distinct()
    for name, part in sources.items():
        g = g.join(part.select(*cols).distinct().withColumn(name, F.lit(1)), cols, "left").fillna(0, [name])
    names = list(sources)
    first, rest = names[0], names[1:]
    missed = F.col(first) == 0
    aggs = [F.count(F.lit(1)).alias("n_gold"), F.count_if(missed).alias("missed")]
    aggs += [F.count_if(missed & (F.col(n) == 1)).alias(f"by_{n}") for n in rest]
    aggs += [F.count_if(reduce(lambda x, y: x & y, [F.col(n) == 0 for n in names])).alias("by_none")]
    for i in range(1, len(names) + 1):
        held = reduce(lambda x, y: x | y, [F.col(n) == 1 for n in names[:i]])
        aggs.append(F.round(F.avg(held.cast("double")), 6).alias("recall_" + "_".join(names[:i])))
    return g.agg(*aggs)
