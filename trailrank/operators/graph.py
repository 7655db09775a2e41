"""Bounded traversals over edge tables.

A level joins only the nodes found by the level before with their links, drops what is already seen by an anti-join, and is
written down, so no node is expanded twice and no plan holds more than one level. The links of a node that has more
than ``HUB`` of them are dealt over parts, and the node meets each part in another task."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailrank.functions.columns import identifiers, is_code, tokens
from trailrank.functions.ordered import first_k, frozen

HUB = 100_000
#: Nodes with parts are sent to every task up to this many; more are joined by shuffle.
HUBS_SENT = 100_000


def adjacency(edges: DataFrame, edge_keys: list[str], direction: str, hub: int = HUB) -> tuple[DataFrame, DataFrame | None]:
    """Distinct links (edge_keys, node, part, dst) in the asked direction, stored, and the number of parts of the nodes that have
    more than one; None where no node has."""
    s, d = F.col("src"), F.col("dst")
    ways = {"forward": [(s, d)], "backward": [(d, s)], "both": [(s, d), (d, s)]}[direction]
    pairs = F.explode(F.array(*[F.struct(x.alias("node"), y.alias("dst")) for x, y in ways]))
    links = frozen(edges.filter("src <> dst").select(*edge_keys, pairs.alias("_p")).select(*edge_keys, "_p.node", "_p.dst").distinct())
    degree = links.groupBy(*edge_keys, "node").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hub)
    hubs = frozen(degree.select(*edge_keys, "node", F.ceil(F.col("_n") / hub).cast("int").alias("parts")))
    n = hubs.limit(HUBS_SENT + 1).count()
    if not n:
        return links.withColumn("part", F.lit(0)), None
    hubs = F.broadcast(hubs) if n <= HUBS_SENT else hubs
    part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int"), F.lit(0))
    return links.join(hubs, [*edge_keys, "node"], "left").withColumn("part", part).drop("parts"), hubs


def slice_distance(seeds: DataFrame, edges: DataFrame, keys: list[str], edge_keys: list[str] | None = None, depth: int = 3,
                   direction: str = "both", cap: int | None = None, extra: int | None = None, hub: int = HUB) -> DataFrame:
    """Nodes within ``depth`` hops of a seed with their smallest hop count: (keys, node, hops).

    ``seeds``: (keys, node). ``edges``: (edge_keys, src, dst), where ``edge_keys`` are the keys the
    graph itself is split by. With ``cap``, or with ``extra`` nodes beyond its seeds, a group leaves the frontier after the level
    that brings it there; the whole level is kept, so it may hold more."""
    edge_keys = keys if edge_keys is None else edge_keys
    graph, hubs = adjacency(edges, edge_keys, direction, hub)
    cols = [*keys, "node"]
    front = frozen(seeds.select(*cols).distinct().withColumn("hops", F.lit(0)))
    levels = [front]
    for level in range(1, depth + 1):
        if front.isEmpty():
            break
        asked = front.select(*cols)
        if hubs is None:
            asked = asked.withColumn("part", F.lit(0))
        else:
            asked = asked.join(hubs, [*edge_keys, "node"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        met = asked.join(graph, [*edge_keys, "node", "part"]).select(*keys, F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, levels)
        new = met.join(seen.select(*cols), cols, "left_anti").withColumn("hops", F.lit(level))
        if level < depth:
            new = frozen(new)
        levels.append(new)
        front = new
        if level < depth and (cap is not None or extra is not None):
            sizes = reduce(DataFrame.unionByName, levels).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("hops") == 0).alias("_s"))
            limit = F.lit(cap) if cap is not None else F.col("_s") + extra
            front = new.join(sizes.filter(F.col("_n") < limit).select(*keys), keys, "left_semi")
    return reduce(DataFrame.unionByName, levels)


def dataflow_slice(seeds: DataFrame, edges: DataFrame, keys: list[str], direction: str = "both", depth: int = 3, cap: int = 80) -> DataFrame:
    return slice_distance(seeds, edges, keys, None, depth, direction, cap).select(*keys, "node")


def seed_lines(functions: DataFrame, classes: DataFrame, lines: DataFrame, issues: DataFrame, frames: DataFrame, named: DataFrame,
               keys: list[str]) -> DataFrame:
    """Seed lines of a file: starts of functions and classes the issue names, code lines inside
    functions that mention an issue identifier, lines and functions of its traceback.

    ``lines``: (keys, line, stmt, text, in_func); ``issues``: (keys, issue); ``frames``: (keys, line);
    ``named``: (keys, name). ``stmt`` is the statement a line belongs to."""
    raw = issues.select(*keys, F.explode(F.array_distinct(identifiers(F.col("issue")))).alias("name"))
    low = issues.select(*keys, F.explode(tokens(F.col("issue"))).alias("_tok"))
    f = functions.select(*keys, "name", F.col("start").alias("line"))
    by_name = f.join(raw, [*keys, "name"], "left_semi").select(*keys, "line")
    by_token = f.withColumn("_tok", F.lower("name")).join(low, [*keys, "_tok"], "left_semi").select(*keys, "line")
    by_class = classes.select(*keys, "name", F.col("start").alias("line")).join(raw, [*keys, "name"], "left_semi").select(*keys, "line")
    body = lines.filter(is_code(F.col("text")) & F.col("in_func"))
    words = body.select(*keys, "stmt", F.explode(F.array_distinct(identifiers(F.col("text")))).alias("name"))
    by_word = words.join(raw, [*keys, "name"], "left_semi").select(*keys, F.col("stmt").alias("line"))
    by_frame = frames.join(lines.select(*keys, "line", "stmt"), [*keys, "line"]).select(*keys, F.col("stmt").alias("line"))
    by_call = f.join(named, [*keys, "name"], "left_semi").select(*keys, "line")
    out = by_name
    for part in (by_token, by_class, by_word, by_frame, by_call):
        out = out.unionByName(part)
    return out.distinct()


def expand_candidates(voted: DataFrame, edges: DataFrame, spans: DataFrame, region: DataFrame, keys: list[str], depth: int = 1,
                      extra: int | None = None) -> DataFrame:
    """Voted lines plus the lines of slice-neighbour statements inside the region. New lines get a
    thousandth of the group's smallest mass. A group that has grown by ``extra`` statements or more beyond those it voted for grows no
    further. ``spans``: (keys, stmt, end); ``voted``: (keys, line, mass)."""
    lines = spans.select(*keys, F.col("stmt").alias("node"), F.explode(F.sequence("stmt", "end")).alias("line"))
    seeds = voted.join(lines, [*keys, "line"]).select(*keys, "node").distinct()
    grown = slice_distance(seeds, edges, keys, None, depth, "both", extra=extra)
    new = grown.join(lines, [*keys, "node"]).select(*keys, "line").distinct()
    new = new.join(region.select(*keys, "line").distinct(), [*keys, "line"], "left_semi").join(voted, [*keys, "line"], "left_anti")
    low = voted.groupBy(*keys).agg((F.min("mass") * 1e-3).alias("mass"))
    added = new.join(low, keys).withColumn("added", F.lit(True))
    return voted.select(*keys, "line", "mass", F.lit(False).alias("added")).unionByName(added.select(*keys, "line", "mass", "added"))


def callgraph_khop(seeds: DataFrame, calls: DataFrame, function_lines: DataFrame, executed: DataFrame, keys: list[str], hops: int) -> DataFrame:
    """Executed lines of every function reachable in at most ``hops`` calls, with the hop count of the
    nearest. ``function_lines``: (keys, node, line)."""
    reach = slice_distance(seeds, calls, keys, None, hops, "forward")
    lines = reach.join(function_lines, [*keys, "node"]).groupBy(*keys, "line").agg(F.min("hops").alias("hops"))
    return lines.join(executed.select(*keys, "line").distinct(), [*keys, "line"], "left_semi")


def call_reach(seeds: DataFrame, links: DataFrame, keys: list[str], hops: int) -> DataFrame:
    """Functions within ``hops`` calls of the seeds (keys, node) over ``call_links``: (keys, node, hops). Names are
    nodes on the way, so a call is two levels, and a name that many call and many define costs the sum of both."""
    kind = seeds.schema["node"].dataType.simpleString()
    start = seeds.select(*keys, F.struct(F.lit("f").alias("of"), F.col("node").cast("string").alias("id")).alias("node"))
    reach = slice_distance(start, links, keys, None, 2 * hops, "forward").filter(F.col("node.of") == "f")
    return reach.select(*keys, F.col("node.id").cast(kind).alias("node"), (F.col("hops") / 2).cast("int").alias("hops"))


def limit_files(files: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """At most ``cap`` files per instance: known files first, then those with most executed lines."""
    return first_k(files, keys, [F.desc("known"), F.desc("n_exec"), F.asc("file")], cap)


def bfs_gain(reached: DataFrame, base: DataFrame, gold: DataFrame, keys: list[str], item: list[str], depth: int) -> DataFrame:
    """``reached``: (keys, item, hops), the executed lines of the reached nodes. For each K up to ``depth``: share of instances whose base pool plus the slice up to K hops holds
    all gold, mean pool size, and how much of the missed gold the slice reaches."""
    cols = [*keys, *item]
    sliced = reached.groupBy(*cols).agg(F.min("hops").alias("hops"))
    b = base.select(*cols).distinct().withColumn("_b", F.lit(1))
    g = gold.select(*cols).distinct().withColumn("_g", F.lit(1))
    ks = F.explode(F.array(*[F.lit(k) for k in range(depth + 1)]))
    rows = (sliced.join(b, cols, "full_outer").join(g, cols, "full_outer").withColumn("k", ks))
    inside = F.col("hops") <= F.col("k")
    in_pool = F.coalesce(inside, F.lit(False)) | F.col("_b").isNotNull()
    is_gold, missed = F.col("_g").isNotNull(), F.col("_g").isNotNull() & F.col("_b").isNull()
    per = rows.groupBy(*keys, "k").agg(F.count_if(in_pool).alias("size"), F.count_if(is_gold).alias("n_gold"), F.count_if(is_gold & in_pool).alias("hits"),
                                       F.count_if(missed).alias("missed"), F.count_if(missed & F.coalesce(inside, F.lit(False))).alias("reached"))
    per = per.filter("n_gold > 0")
    return per.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.col("hits") == F.col("n_gold")).cast("int")), 6).alias("superset"),
                                F.round(F.avg("size"), 6).alias("loc"), F.sum("missed").alias("missed"), F.sum("reached").alias("reached"))


def backward_slice(lines: DataFrame, seeds: DataFrame, keys: list[str], statements: DataFrame | None = None) -> DataFrame:
    """Scan the executed lines of a file from the bottom with a set of needed variables: a line that
    defines one joins the slice, its definitions stop being needed and its uses become needed. What the seeds use is needed from the
    start, whether they were executed or not; the slice holds executed lines only.

    ``lines``: (keys, line, defs, uses), one row per executed line; ``statements``: the same for all lines, where unexecuted ones can
    be seeds. ``seeds``: (keys, line). Rows come to a task sorted by file and from the last line up, so the scan is one pass that holds the needed
    names of one file and a batch of rows, and no file is put into one row."""
    asked = seeds.select(*keys, "line").distinct()
    of_seeds = (lines if statements is None else statements).join(asked, [*keys, "line"], "left_semi")
    names = F.array().cast("array<string>")

    def rows(df, turn, line, defs, uses):
        return df.select(*keys, F.lit(turn).alias("_turn"), line.cast("long").alias("_line"), defs.alias("_defs"), uses.alias("_uses"))

    top, line = F.lit(None).cast("long"), F.col("line")
    files = asked.select(*keys).distinct()
    start = rows(of_seeds, 0, top, names, F.col("uses"))  # before the first line
    marks = rows(asked, 1, line, F.lit(None).cast("array<string>"), names)  # before their line
    body = rows(lines.join(files, keys, "left_semi"), 2, line, F.coalesce("defs", names), F.coalesce("uses", names))
    every = start.unionByName(marks).unionByName(body)
    ordered = every.repartition(*keys).sortWithinPartitions(*keys, F.desc_nulls_first("_line"), "_turn")
    schema = T.StructType([*[every.schema[k] for k in keys], T.StructField("line", T.IntegerType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, needed, marked = None, set(), None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "_line", "_defs", "_uses")]
            out, said = [], []
            for n, (*key, at, defs, uses) in enumerate(zip(*columns)):
                if key != file:
                    file, needed, marked = key, set(), None
                if at is None:
                    needed.update(uses)
                elif defs is None:
                    marked = at
                else:
                    taken = not needed.isdisjoint(defs)
                    if taken:
                        needed.difference_update(defs)
                        needed.update(uses)
                    if taken or marked == at:
                        out.append(n)
                        said.append(at)
            kept = pa.array(out, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(kept) for k in keys], pa.array(said, pa.int32())], names=[*keys, "line"])

    return ordered.mapInArrow(scan, schema)


def expansion_ladder(steps: list[tuple[str, DataFrame]], executed: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """Cumulative pools: the base, then each expansion in turn (expansions executed only). One row per
    item with the first step that holds it."""
    cols = [*keys, *item]
    out = None
    for i, (_, part) in enumerate(steps):
        rows = part.select(*cols).withColumn("step", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    first = out.groupBy(*cols).agg(F.min("step").alias("step"), F.min(F.when(F.col("step") > 0, F.col("step"))).alias("_later"))
    ex = executed.select(*cols).distinct().withColumn("_e", F.lit(1))
    return first.join(ex, cols, "left").filter("step = 0 or _e = 1").select(*cols, "step")


def ladder_quality(ladder: DataFrame, gold: DataFrame, keys: list[str], item: list[str], n_steps: int) -> DataFrame:
    """Superset share and mean size after each step of a ladder."""
    cols = [*keys, *item]
    g = gold.select(*cols).distinct()
    per = (ladder.join(g.withColumn("_g", F.lit(1)), cols, "left").groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("c"), F.count("_g").alias("h"))
           .withColumn("at", F.explode(F.sequence(F.col("step"), F.lit(n_steps - 1)))).groupBy(*keys, "at").agg(F.sum("c").alias("c"), F.sum("h").alias("h")))
    sizes = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))))
    j = sizes.join(per, [*keys, "at"], "left").fillna(0, ["c", "h"])
    return j.groupBy(F.col("at").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.col("h") == F.col("n")).cast("int")), 6).alias("superset"),
                                                     F.round(F.avg("c"), 6).alias("loc"))


def build_region(code_lines: DataFrame, sizes: DataFrame, spans: DataFrame, module_scores: DataFrame, executed: DataFrame | None,
                 scores: DataFrame, keys: list[str], small_file: int = 500, module_lines: int = 12, budget: int = 900) -> DataFrame:
    """Candidate region of a file: every code line of a small file; otherwise the chosen spans
    (functions, short classes, backstop functions) and the best module-level lines with two lines
    either side, clipped. Narrowed to executed lines where that leaves anything, then cut to the
    best-scored ``budget`` lines."""
    small = sizes.filter(F.col("n_lines") <= small_file).select(*keys)
    large = sizes.filter(F.col("n_lines") > small_file).select(*keys, "n_lines")
    whole = code_lines.join(small, keys, "left_semi").select(*keys, "line")
    chosen = spans.join(large, keys).select(*keys, F.explode(F.sequence("start", F.least("end", "n_lines"))).alias("line"))
    top = first_k(module_scores.filter("score > 0").join(large, keys), keys, [F.desc("score"), F.asc("line")], module_lines)
    near = top.select(*keys, F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - 2), F.least(F.col("n_lines"), F.col("line") + 2))).alias("line"))
    region = whole.unionByName(chosen).unionByName(near).distinct()
    if executed is not None:
        marked = region.join(executed.select(*keys, "line").distinct().withColumn("_e", F.lit(1)), [*keys, "line"], "left")
        any_ex = marked.groupBy(*keys).agg(F.count("_e").alias("_n"))
        region = marked.join(any_ex, keys).filter("_e = 1 or _n = 0").select(*keys, "line")
    scored = region.join(scores.select(*keys, "line", "score"), [*keys, "line"], "left").fillna(0.0, ["score"])
    return first_k(scored, keys, [F.desc("score"), F.asc("line")], budget).select(*keys, "line")
