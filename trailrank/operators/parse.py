"""Parsing jobs: a text column becomes a long table.

Every parser explodes one text cell; windows that follow are keyed by the row the cell came
from, so a group is never larger than one cell of the input."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailrank.functions import columns as C
from trailrank.functions.ordered import first_k, number_rows


def numbered_lines(files: DataFrame, keys: list[str], text: str = "text", line_no: str = "line_no", out: str = "text") -> DataFrame:
    """One row per line, 1-based."""
    rows = files.select(*keys, F.posexplode(C.split_lines(F.col(text))).alias("_p", "_t"))
    return rows.select(*keys, (F.col("_p") + 1).alias(line_no), F.col("_t").alias(out))


# ---- patches --------------------------------------------------------------------------

HUNK = r"@@ -(\d+)(?:,(\d+))? \+(\d+)"  # fixed value: hunk header, in lines that start with @@


def diff_to_edit_lines(patches: DataFrame, keys: list[str], patch: str = "patch", mode: str = "strict") -> DataFrame:
    """Unified diff to (keys, file, hunk, line, kind) in original line numbers.

    A removed line counts at its number and advances; an added line anchors the lines before
    and after it; a context line advances. ``strict`` keeps three habits of the recorded
    results: a removed line that starts with ``--`` is taken for a header, ``+++ /dev/null`` leaves
    the previous file current, and an empty context line does not advance. ``corrected`` tells
    headers by their neighbour line and repairs all three."""
    rows = patches.select(*keys, F.posexplode(F.split(F.col(patch), "\n")).alias("ord", "t"))
    w = W.partitionBy(*keys).orderBy("ord")
    t = F.col("t")
    if mode == "strict":
        path = F.when(t.startswith("+++ b/"), C.strip(F.expr("substring(t, 7)")))
        minus_head, plus_head, blank = t.startswith("---"), t.startswith("+++"), F.lit(False)
    else:
        before, after = F.lag("t").over(w), F.lead("t").over(w)
        rows = rows.withColumn("_minus", t.startswith("--- ") & F.coalesce(after.startswith("+++ "), F.lit(False)))
        rows = rows.withColumn("_plus", t.startswith("+++ ") & F.coalesce(before.startswith("--- "), F.lit(False)))
        rows = rows.withColumn("_old_path", F.regexp_extract(before, r"^--- (?:a/)?(.*)$", 1)).withColumn("_last", after.isNull())
        new_path = F.regexp_extract("t", r"^\+\+\+ (?:b/)?(.*)$", 1)
        path = F.when(F.col("_plus"), C.strip(F.when(new_path == "/dev/null", F.col("_old_path")).otherwise(new_path)))
        minus_head, plus_head, blank = F.col("_minus"), F.col("_plus"), (t == "") & ~F.col("_last")
    rows = rows.withColumn("file", F.last(path, ignorenulls=True).over(w))
    start = F.when(t.startswith("@@"), F.regexp_extract("t", HUNK, 1)).otherwise("")
    rows = rows.withColumn("_start", F.when(F.col("file").isNotNull() & (start != ""), F.try_to_number(start, F.lit("9999999999")).cast("int")))
    rows = rows.withColumn("hunk", F.count("_start").over(w)).withColumn("_from", F.last("_start", ignorenulls=True).over(w))
    removed, added = t.startswith("-") & ~minus_head, t.startswith("+") & ~plus_head
    rows = rows.withColumn("_kind", F.when(removed, "deleted").when(added, "anchor").when(t.startswith(" ") | blank, "context"))
    in_hunk = W.partitionBy(*keys, "hunk").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.col("_kind").isin("deleted", "context").cast("int")).over(in_hunk), F.lit(0))
    rows = rows.withColumn("_old", (F.col("_from") + moved).cast("int")).filter("_old is not null and _kind in ('deleted', 'anchor')")
    at = F.when(F.col("_kind") == "deleted", F.array("_old")).otherwise(F.array(F.col("_old") - 1, F.col("_old")))
    return (rows.select(*keys, "file", "hunk", F.explode(at).alias("line"), F.col("_kind").alias("kind"))
            .filter("line >= 1").distinct())


def patch_files(patches: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """Files that a patch names as its result, with or without lines that count: (keys, file)."""
    t = F.col("t")
    rows = patches.select(*keys, F.explode(F.split(F.col(patch), "\n")).alias("t")).filter(t.startswith("+++ b/"))
    return rows.select(*keys, C.strip(F.expr("substring(t, 7)")).alias("file")).distinct()


def region_lines(edits: DataFrame, keys: list[str]) -> DataFrame:
    return edits.select(*keys, "file", "line").distinct()


def clean_gold(gold: DataFrame, lines: DataFrame, cols: list[str], text: str = "text") -> DataFrame:
    """Drop gold that is out of range, blank, a comment, or only brackets and separators once a
    trailing comment is cut."""
    body = C.strip(F.col(text))
    core = C.strip(F.split(body, "#", 2)[0])
    keep = (body != "") & ~body.startswith("#") & ~core.rlike(r"^[()\[\]{},:;\\]+$")
    return gold.join(lines.filter(keep).select(*cols), cols, "left_semi")


def added_lines(patches: DataFrame, keys: list[str], patch: str = "patch", comments: bool = False) -> DataFrame:
    """Added, non-blank lines with their indent width; comment lines only on request."""
    rows = patches.select(*keys, F.posexplode(F.split(F.col(patch), "\n")).alias("ord", "t"))
    rows = rows.filter(F.col("t").startswith("+") & ~F.col("t").startswith("+++")).withColumn("raw", F.expr("substring(t, 2)"))
    rows = rows.withColumn("body", C.strip(F.col("raw"))).filter("body <> ''")
    if not comments:
        rows = rows.filter(~F.col("body").startswith("#"))
    indent = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    return rows.select(*keys, "ord", indent.alias("indent"), F.col("body").alias("text"), "raw")


# Fixed value: an edit block with its file, SEARCH text and REPLACE text.
EDIT_BLOCK = r"(?s)<<<<<<< SEARCH(?: file=([^\n]+?))?\s*\n(.*?)\n=======\s*\n(.*?)\n>>>>>>> REPLACE"


def edit_blocks(answers: DataFrame, files: DataFrame, keys: list[str], answer: str = "answer", text: str = "text", file: str | None = None) -> DataFrame:
    """SEARCH/REPLACE blocks to the line range their SEARCH text occupies in the file; when the text
    is not found, line-number prefixes are stripped and it is tried again. First occurrence only, in the file as it was.

    With ``file``, the column of ``files`` that names a file of the keys, a block that says ``file=`` is searched in that file only, and in none if
    there is no such file; a block that does not is searched in all. The result then has that column too."""
    both = F.arrays_zip(F.regexp_extract_all(answer, F.lit(EDIT_BLOCK), 1).alias("at"), F.regexp_extract_all(answer, F.lit(EDIT_BLOCK), 2).alias("search"))
    rows = answers.select(*keys, F.posexplode(both).alias("block", "_b")).select(*keys, "block", C.strip(F.col("_b.at")).alias("_at"), "_b.search").filter(C.strip(F.col("search")) != "")
    out = [*keys, *([file] if file else [])]
    source = files.select(*out, F.col(text).alias("_src"))
    if file:
        named = rows.filter("_at <> ''").withColumnRenamed("_at", file).join(source, out)
        rows = named.unionByName(rows.filter("_at = ''").drop("_at").join(source, keys))
    else:
        rows = rows.join(source, keys)
    bare = F.regexp_replace("search", r"(?m)^\s*\d+:\s?", "")
    found = F.when(F.contains("_src", "search"), F.col("search")).when(F.contains("_src", bare), bare)
    rows = rows.withColumn("_s", found).filter("_s is not null")
    before = F.expr("substring(_src, 1, instr(_src, _s) - 1)")
    start = 1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    height = F.length("_s") - F.length(F.replace("_s", F.lit("\n"), F.lit("")))
    return rows.select(*out, "block", start.alias("start"), (start + height).alias("end"))


# ---- failure text ---------------------------------------------------------------------

def _groups(text: Column, pattern: str, names: list[str]) -> Column:
    parts = [F.regexp_extract_all(text, F.lit(pattern), i + 1).alias(n) for i, n in enumerate(names)]
    return F.posexplode(F.arrays_zip(*parts))


def traceback_frames(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``File "p", line n, in f`` frames in order: (keys, ord, path, line, func)."""
    z = rows.select(*keys, _groups(F.col(text), C.FRAME_FULL, ["path", "line", "func"]).alias("ord", "f"))
    return z.select(*keys, "ord", "f.path", F.expr("try_cast(f.line as int)").alias("line"), "f.func")


def loose_frames(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``x.py, line 12`` and ``x.py:12`` mentions: (keys, path, line)."""
    both = [rows.select(*keys, _groups(F.col(text), p, ["path", "line"]).alias("_o", "f")) for p in (C.LOOSE_FRAME, C.SHORT_FRAME)]
    return both[0].unionByName(both[1]).select(*keys, "f.path", F.expr("try_cast(f.line as int)").alias("line")).distinct()


def named_functions(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Names after ``in``."""
    return rows.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(C.IN_NAME), 1))).alias("name"))


def deepest_frame(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"), F.max_by(F.struct("path", "line", "func"), "ord").alias("_d")).select(
        *keys, "n_frames", "_d.path", "_d.line", "_d.func")


def crash_context(text: Column, cap: int = 1600, frames: int = 20, tail: int = 1200) -> Column:
    """From the traceback header on, else the first frame lines, else the end of the text."""
    at = F.locate("Traceback (most recent call last)", text)
    heads = F.regexp_extract_all(text, F.lit(C.FRAME_LINE), 0)
    listed = F.substring(F.array_join(F.slice(heads, 1, frames), "\n"), 1, cap)
    return F.when(at > 0, F.substr(text, at, F.lit(cap))).when(F.size(heads) > 0, listed).otherwise(F.right(text, F.lit(tail)))


def exception_facts(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Last ``SomeError: message``, all exception types, and those that are real errors."""
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(C.EXCEPTION_TYPE), 1)))
    error = F.try_element_at(F.regexp_extract_all(t, F.lit(C.ERROR_LINE), 1), F.lit(-1))
    message = F.try_element_at(F.regexp_extract_all(t, F.lit(C.ERROR_LINE), 2), F.lit(-1))
    real = F.filter(kinds, lambda e: (e.endswith("Error") | e.endswith("Exception")) & (e != "AssertionError"))
    return rows.select(*keys, error.alias("error"), F.substring(C.strip(message), 1, C.ERROR_CHARS).alias("message"), kinds.alias("kinds"), real.alias("real_errors"))


def test_evidence(instances: DataFrame, keys: list[str], lines: int = 24, cap: int = 1600) -> DataFrame:
    """Failing test names, added test lines that check something (else any), and the head of the
    observed traceback, at most ``cap`` characters. Needs failing (array), test_patch, problem."""
    added = added_lines(instances, keys, "test_patch", comments=True)
    checks = F.col("raw").rlike(C.ASSERTION_KEY)
    best = first_k(added.withColumn("_k", checks), keys, [F.desc("_k"), F.asc("ord")], lines)
    any_key = F.max("_k")
    shown = best.groupBy(*keys).agg(any_key.alias("_any"), F.array_sort(F.collect_list(F.struct("ord", "_k", "raw"))).alias("_l"))
    body = F.array_join(F.transform(F.filter("_l", lambda x: x["_k"] | ~F.col("_any")), lambda x: F.substring(x["raw"], 1, 160)), "\n")
    j = instances.join(shown, keys, "left")
    at = F.locate("Traceback (most recent call last)", F.col("problem"))
    parts = [F.when(F.size("failing") > 0, F.concat(F.lit("Failing test(s): "), F.array_join(F.slice("failing", 1, 3), ", "))),
             F.when(F.col("_l").isNotNull(), F.concat(F.lit("Test code / assertions (what it expects):\n"), body)),
             F.when(at > 0, F.concat(F.lit("Observed failure (from issue):\n"), F.substr(F.col("problem"), at, F.lit(700))))]
    return j.select(*keys, F.substring(F.concat_ws("\n\n", *parts), 1, cap).alias("evidence"), F.coalesce("_any", F.lit(False)).alias("fired"))


# ---- model answers --------------------------------------------------------------------

def parse_ranked_answer(answers: DataFrame, keys: list[str], text: str = "answer") -> DataFrame:
    """Ranked integers of an answer, first occurrence kept: (keys, rank, line). The first bracketed
    list counts when it is a well-formed non-empty list; otherwise every integer of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    block = F.regexp_extract(t, r"(\[[\s\d,]*\])", 1)
    source = F.when(block.rlike(r"^\[\s*\d+(\s*,\s*\d+)*\s*\]$"), block).otherwise(t)
    numbers = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(source, F.lit(r"\d+"), 0), lambda x: x.try_cast("bigint")),
                                        lambda x: x.isNotNull()))
    return answers.select(*keys, F.posexplode(numbers).alias("rank", "line"))


def parse_ranges(answers: DataFrame, keys: list[str], text: str = "answer", widest: int = 2000) -> DataFrame:
    """``[[a,b],...]`` line ranges: swapped when reversed, dropped when wider than ``widest``. One row
    per line, or one row with a null line when nothing was parsed."""
    t = F.coalesce(F.col(text), F.lit(""))
    pair = r"\[\s*(\d+)\s*,\s*(\d+)"
    block = F.regexp_extract(t, r"(?s)(\[\s*\[.*?\]\s*\])", 1)
    source = F.when(F.size(F.regexp_extract_all(block, F.lit(pair), 1)) > 0, block).otherwise(t)
    closed = F.when(source == block, F.lit(pair)).otherwise(F.lit(pair + r"\s*\]"))
    rows = answers.select(*keys, source.alias("_s"), closed.alias("_r"))
    zipped = F.arrays_zip(F.regexp_extract_all("_s", F.col("_r"), 1).alias("a"), F.regexp_extract_all("_s", F.col("_r"), 2).alias("b"))
    rows = rows.select(*keys, F.explode_outer(zipped).alias("_p")).selectExpr(*keys, "try_cast(_p.a as int) as a", "try_cast(_p.b as int) as b")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    lines = F.when(high - low <= widest, F.sequence(low, high))
    return (rows.select(*keys, F.col("a").isNotNull().alias("parsed"), F.explode_outer(lines).alias("line"))
            .filter("line is not null or not parsed").distinct())


def parse_names(answers: DataFrame, keys: list[str], text: str = "answer") -> DataFrame:
    """Quoted names of the first bracketed list, else every quoted identifier."""
    t = F.coalesce(F.col(text), F.lit(""))
    block = F.regexp_extract(t, r"(?s)(\[.*?\])", 1)
    listed = F.regexp_extract_all(block, F.lit(r'"([^"]*)"'), 1)
    loose = F.regexp_extract_all(t, F.lit(r'"([A-Za-z_][A-Za-z0-9_]*)"'), 1)
    names = F.array_distinct(F.when(F.size(listed) > 0, listed).otherwise(loose))
    return answers.select(*keys, F.posexplode(names).alias("rank", "name"))


def parse_path_list(answers: DataFrame, keys: list[str], text: str = "answer") -> DataFrame:
    """Strings of the first bracketed list when it is a JSON array (other elements are passed over), else every quoted path that ends in ``.py``:
    (keys, rank, path), ranks 0-based."""
    rows = answers.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.withColumn("_l", F.expr("cast(try_parse_json(regexp_extract(_t, '(?s)(\\\\[.*?\\\\])', 1)) as array<variant>)"))
    listed = F.expr("transform(filter(_l, x -> schema_of_variant(x) = 'STRING'), x -> cast(x as string))")
    loose = F.regexp_extract_all("_t", F.lit(r'"([^"]+\.py)"'), 1)
    return rows.select(*keys, F.posexplode(F.coalesce(listed, loose)).alias("rank", "path"))


def parse_paths(answers: DataFrame, valid: DataFrame, keys: list[str], text: str = "answer", path: str = "path") -> DataFrame:
    """Paths of the fenced answer, kept when they exist or are the unique ``/``-suffix of an existing
    path; ``valid`` is (keys, path). First mention wins."""
    t = F.coalesce(F.col(text), F.lit(""))
    fence = F.regexp_extract(t, r"(?s)```[a-zA-Z]*\n?(.*?)```", 1)
    body = F.when(fence != "", fence).otherwise(t)
    rows = answers.select(*keys, F.posexplode(F.split(body, "\n")).alias("ord", "_c"))
    cleaned = F.translate(F.regexp_replace(C.strip(F.col("_c")), r"^[`\-*0-9. \t]+|[`\-*0-9. \t]+$", ""), "\\", "/")
    rows = rows.select(*keys, "ord", cleaned.alias("cand")).filter("cand <> '' and not endswith(cand, '/')")
    known = valid.select(*keys, F.col(path).alias("_valid")).distinct()
    tails = known.withColumn("cand", F.explode(path_suffixes(F.col("_valid")))).groupBy(*keys, "cand").agg(
        F.max(F.when(F.col("_valid") == F.col("cand"), F.col("_valid"))).alias("_exact"), F.count(F.lit(1)).alias("_n"), F.min("_valid").alias("_one"))
    hit = rows.join(tails, [*keys, "cand"])
    chosen = hit.withColumn("path", F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_one")))).filter("path is not null")
    firsts = chosen.groupBy(*keys, "path").agg(F.min("ord").alias("ord"))
    return firsts.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("ord")) - 1).select(*keys, "rank", "path")


def path_suffixes(path: Column) -> Column:
    """The path and all its tails that start after a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def parse_triples(answers: DataFrame, keys: list[str], text: str = "answer") -> DataFrame:
    """``file: a, function: f, line: n`` rows between LOCATIONS and END_LOCATIONS."""
    block = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?is)LOCATIONS\s*\n(.*?)\nEND_LOCATIONS", 1)
    row = r"(?i)file\s*:\s*(.+?)\s*,\s*function\s*:\s*(.+?)\s*,\s*line\s*:\s*(\d+)"
    z = answers.select(*keys, _groups(block, row, ["file", "func", "line"]).alias("ord", "_t"))
    z = z.select(*keys, "ord", "_t.file", "_t.func", F.expr("try_cast(_t.line as int)").alias("line"))
    return z.groupBy(*keys, "file", "func", "line").agg(F.min("ord").alias("ord"))


def yes_no(text: Column) -> Column:
    found = F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), r"\b(YES|NO)\b", 1)
    return F.nullif(found, F.lit(""))


def keep_valid(ranked: DataFrame, valid: DataFrame, keys: list[str], valid_keys: list[str] | None = None, item: str = "line") -> DataFrame:
    """Drop answers outside the candidate set and close the gaps in the 0-based ranks. The candidate
    set may be kept per ``valid_keys`` (an instance) while answers are kept per sample."""
    cols = [*(valid_keys or keys), item]
    kept = ranked.join(valid.select(*cols).distinct(), cols, "left_semi").withColumnRenamed("rank", "_old")
    return number_rows(kept, keys, [F.asc("_old")], "rank", start=0).drop("_old")


def parse_locations(locs: DataFrame, spans: DataFrame, sizes: DataFrame, keys: list[str], text: str = "loc", window: int = 10) -> DataFrame:
    """Location strings to lines: ``line: N`` and ``line: a-b`` widened by ``window``, and the whole
    span of every ``function:`` / ``class:`` they name. ``spans``: (keys, name, start, end); ``sizes``: (keys,
    n_lines), which bounds every range before it is expanded, whatever numbers an answer names."""
    t = F.col(text)
    single = F.transform(F.regexp_extract_all(t, F.lit(r"line:\s*(\d+)(?!\d|\s*-)"), 1), lambda x: F.struct(x.alias("a"), x.alias("b")))
    ranged = F.arrays_zip(F.regexp_extract_all(t, F.lit(r"line:\s*(\d+)\s*-\s*(\d+)"), 1).alias("a"),
                          F.regexp_extract_all(t, F.lit(r"line:\s*(\d+)\s*-\s*(\d+)"), 2).alias("b"))
    marks = locs.select(*keys, F.explode(F.concat(single, ranged)).alias("_p")).selectExpr(*keys, "try_cast(_p.a as int) as a", "try_cast(_p.b as int) as b")
    bounds = marks.join(sizes.select(*keys, "n_lines"), keys).selectExpr(
        *keys, f"greatest(1L, cast(a as bigint) - {window}) as a", f"least(cast(n_lines as bigint), cast(greatest(a, b) as bigint) + {window}) as b").filter("a <= b")
    by_line = bounds.select(*keys, F.explode(F.sequence("a", "b")).alias("line")).withColumn("line", F.col("line").cast("int"))
    named = locs.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?:function|class):\s*([\w.]+)"), 1))).alias("_n"))
    named = named.withColumn("name", F.substring_index("_n", ".", -1))
    by_name = named.join(spans, [*keys, "name"]).select(*keys, F.explode(F.sequence("start", "end")).alias("line"))
    return by_line.unionByName(by_name).distinct()


# ---- paths ----------------------------------------------------------------------------

def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"^/testbed/", ""), r"^\./", "")


def is_repo_source(path: Column) -> Column:
    p = F.translate(path, "\\", "/")
    return (p.endswith(".py") & ~p.rlike(r"site-packages|miniconda|/\.tox/|/tests/|conftest|/test/")
            & ~p.rlike(r"(^|/)test_[^/]*$|_test\.py$"))


def is_test_file(path: Column) -> Column:
    p = F.translate(path, "\\", "/")
    return p.rlike(r"(^|/)test_[^/]*$|_test\.py$|(^|/)tests\.py$") & ~p.rlike(r"/roots/|/data/")


def called_files(executed: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """Files where some executed line lies in a function body (not just a header or import time).
    ``bodies``: (keys, file, body_start, end)."""
    inside = bodies.select(*keys, "file", F.explode(F.sequence("body_start", "end")).alias("line")).distinct()
    return executed.join(inside, [*keys, "file", "line"], "left_semi").select(*keys, "file").distinct()


def skeleton(classes: DataFrame, functions: DataFrame, keys: list[str], most: int = 60) -> DataFrame:
    """Compact outline of a file: class lines, then at most ``most`` function lines with span, six
    arguments and eight in-file callees, then how many were left out."""
    base = F.when(F.size("bases") > 0, F.concat(F.lit("("), F.array_join("bases", ", "), F.lit(")"))).otherwise("")
    head = F.concat(F.lit("class "), F.col("name"), base, F.lit("  [L"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("]"))
    top = classes.select(*keys, F.lit(0).alias("part"), F.col("start").alias("seq"), head.alias("row"))
    names = functions.select(*keys, F.col("name").alias("_callee")).distinct()
    calls = functions.select(*keys, "seq", F.explode(F.array_distinct("calls")).alias("_callee")).join(names, [*keys, "_callee"], "left_semi")
    calls = first_k(calls, [*keys, "seq"], [F.asc("_callee")], 8).groupBy(*keys, "seq").agg(F.array_join(F.array_sort(F.collect_list("_callee")), ", ").alias("_calls"))
    shown = first_k(functions, keys, [F.asc("seq")], most).drop("pos").join(calls, [*keys, "seq"], "left")
    owner = F.when(F.col("class_name").isNotNull(), F.concat("class_name", F.lit("."))).otherwise("")
    line = F.concat(F.lit("def "), owner, F.col("name"), F.lit("("), F.array_join(F.slice("args", 1, 6), ", "), F.lit(")  [L"),
                    F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("]"),
                    F.coalesce(F.concat(F.lit("  -> calls: "), F.col("_calls")), F.lit("")))
    defs = shown.select(*keys, F.lit(1).alias("part"), "seq", line.alias("row"))
    more = (functions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
            .select(*keys, F.lit(2).alias("part"), F.lit(0).alias("seq"),
                    F.concat(F.lit("... (+"), (F.col("_n") - most).cast("string"), F.lit(" more functions)")).alias("row")))
    rows = top.unionByName(defs).unionByName(more)
    ordered = F.array_sort(F.collect_list(F.struct("part", "seq", "row")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["row"]), "\n").alias("skeleton"))
