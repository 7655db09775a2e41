"""Predicates, labels and selections over instances."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailrank.functions import columns as C
from trailrank.functions.columns import hash_seeded


def crash_rule(problem: Column, test_patch: Column) -> Column:
    """Which rule makes an instance a crash: traceback, frames>=2, raises, none."""
    p, t = F.coalesce(problem, F.lit("")), F.coalesce(test_patch, F.lit(""))
    return (F.when(p.rlike(C.TRACEBACK), "traceback").when(F.size(F.regexp_extract_all(p, F.lit(C.FRAME_HEAD), 0)) >= 2, "frames>=2")
            .when(t.rlike(C.RAISES), "raises").otherwise("none"))


def crash_evidence(problem: Column, test_patch: Column) -> Column:
    """The text the rule fired on."""
    p, t = F.coalesce(problem, F.lit("")), F.coalesce(test_patch, F.lit(""))
    frames = F.regexp_extract_all(p, F.lit(C.FRAME_HEAD), 0)
    rule = crash_rule(problem, test_patch)
    at = F.locate("Traceback (most recent call last)", p)
    hit = F.regexp_instr(t, F.lit(C.RAISES))
    low = F.greatest(F.lit(1), hit - 20)
    return (F.when(rule == "traceback", F.substr(p, at, F.lit(80)))
            .when(rule == "frames>=2", F.array_join(F.slice(frames, 1, 3), " | "))
            .when(rule == "raises", C.strip(F.substr(t, low, hit + 40 - low))).otherwise(""))


def is_crash_strict(problem: Column) -> Column:
    p = F.coalesce(problem, F.lit(""))
    return p.rlike(C.TRACEBACK) | (F.size(F.regexp_extract_all(p, F.lit(C.FRAME_HEAD), 0)) >= 2)


def is_crash_alt(problem: Column, test_patch: Column) -> Column:
    p, t = F.coalesce(problem, F.lit("")), F.coalesce(test_patch, F.lit(""))
    named = p.rlike(C.ERROR_NAME) & (F.contains(p, F.lit("Traceback")) | F.contains(p, F.lit("raise")))
    return F.contains(p, F.lit("Traceback (most recent call last)")) | named | t.rlike(C.RAISES_ALT)


def assign_quadrant(instances: DataFrame, gold: DataFrame, coverage: DataFrame, keys: list[str]) -> DataFrame:
    """crash/behav x onpath/offpath by the first gold file (by ``file_ord``) that has gold and
    coverage; instances without any coverage are labelled ``nocov``; the rest drop out.
    ``instances``: (keys, crash); ``gold``: (keys, file, file_ord, line); ``coverage``: (keys, file, line)."""
    cov_files = coverage.select(*keys, "file").distinct()
    with_cov = gold.join(cov_files, [*keys, "file"], "left_semi")
    hit = coverage.select(*keys, "file", "line").distinct().withColumn("_x", F.lit(1))
    per_file = with_cov.join(hit, [*keys, "file", "line"], "left").groupBy(*keys, "file").agg(F.min("file_ord").alias("file_ord"), F.count("_x").alias("n_hit"))
    picked = per_file.groupBy(*keys).agg(F.min_by(F.struct("file", "n_hit"), "file_ord").alias("_p"))
    covered = cov_files.select(*keys).distinct().withColumn("_c", F.lit(1))
    j = instances.join(covered, keys, "left").join(picked, keys, "left").filter("_c is null or _p is not null")
    kind = F.when(F.col("crash"), "crash").otherwise("behav")
    path = F.when(F.col("_p.n_hit") > 0, "onpath").otherwise("offpath")
    return j.select(*keys, F.when(F.col("_c").isNull(), "nocov").otherwise(F.concat_ws("_", kind, path)).alias("subset"), F.col("_p.file").alias("file"))


def patch_shape(files: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Counts that pool predicates test: files, python files, python files with a hunk. ``files`` (keys, file) holds
    every file of the patch (``parse.patch_files``), also one whose hunks touch no line of the original."""
    hunks = edits.groupBy(*keys, "file").agg(F.count("hunk").alias("_h"))
    files = files.join(hunks, [*keys, "file"], "left").fillna(0, ["_h"])
    py = F.col("file").endswith(".py")
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(py).alias("n_py"), F.count_if(py & (F.col("_h") > 0)).alias("n_py_hunks"))


def select_pool(instances: DataFrame, shape: DataFrame, keys: list[str], rule: str, repos: list[str] | None = None,
                min_lines: int | None = None, max_lines: int | None = None) -> DataFrame:
    """Instances whose patch has the asked shape (``single_py``, ``one_file``, ``multi_py``,
    ``all_py``), that have failing tests, and optionally come from listed repositories or have a
    file of the asked length."""
    rules = {"single_py": F.col("n_py") == 1, "one_file": (F.col("n_files") == 1) & (F.col("n_py") == 1),
             "multi_py": F.col("n_py") >= 2, "all_py": (F.col("n_py_hunks") > 0) & (F.col("n_py_hunks") == F.col("n_py"))}
    j = instances.join(shape, keys).filter(rules[rule] & F.col("has_failing"))
    if repos is not None:
        j = j.filter(F.col("repo").isin(repos))
    if min_lines is not None:
        j = j.filter(F.col("n_lines") > min_lines)
    return j if max_lines is None else j.filter(F.col("n_lines") <= max_lines)


def seeded_sample(instances: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` instances in hash order; the order does not depend on partitioning, and the cut
    is a distributed top-n."""
    return instances.orderBy(hash_seeded(F.col(key), F.lit(seed)), key).limit(n)


def selection_funnel(instances: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Instances that survive each successive predicate, in one pass."""
    alive, aggs = F.lit(True), [F.count(F.lit(1)).alias("s0")]
    for i, (_, cond) in enumerate(steps, 1):
        alive = alive & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(alive).alias(f"s{i}"))
    names = ["total", *[n for n, _ in steps]]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"s{i}").alias("n")) for i, n in enumerate(names)]))
    return instances.agg(*aggs).select(rows.alias("r")).select("r.*")


def dropped_at(instances: DataFrame, steps: list[tuple[str, Column]], key: str) -> DataFrame:
    """The first predicate each dropped instance fails."""
    reason = F.coalesce(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(n)) for n, cond in steps])
    return instances.select(key, reason.alias("dropped_at")).filter("dropped_at is not null")


def patch_kind(instances: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """CF when an added if/elif/else gets a body that holds a statement other than a control
    transfer, else DL; ``naive`` is CF for any such header. ``added``: (keys, ord, indent, text). Every
    instance gets a row; one without added lines is DL.

    Lines are cut into segments that end with a non-transfer line. A header ends its segment, so
    its body reaches a real statement exactly when the next segment is complete and all of it is
    indented deeper than the header."""
    head, plain = F.col("text").rlike(C.BRANCH_HEAD), ~F.col("text").rlike(C.CONTROL_TRANSFER)
    w = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    rows = added.withColumn("_plain", plain.cast("int")).withColumn("_head", head.cast("int"))
    rows = rows.withColumn("_seg", F.coalesce(F.sum("_plain").over(w), F.lit(0)))
    segs = rows.groupBy(*keys, "_seg").agg(F.min("indent").alias("_min"), F.max("_plain").alias("_full"), F.max_by("indent", "ord").alias("_at"),
                                           F.max_by("_head", "ord").alias("_ends_head"), F.max("_head").alias("_any"))
    nxt = W.partitionBy(*keys).orderBy("_seg")
    deep = (F.col("_ends_head") == 1) & (F.lead("_full").over(nxt) == 1) & (F.lead("_min").over(nxt) > F.col("_at"))
    out = segs.withColumn("_cf", F.coalesce(deep, F.lit(False))).groupBy(*keys).agg(F.max("_cf").alias("_cf"), F.max("_any").alias("_any"))
    return instances.select(*keys).join(out, keys, "left").select(
        *keys, F.when(F.col("_cf"), "CF").otherwise("DL").alias("kind"), F.when(F.col("_any") == 1, "CF").otherwise("DL").alias("naive"))


def offpath_mechanism(instances: DataFrame, edits: DataFrame, functions: DataFrame, executed: DataFrame, keys: list[str]) -> DataFrame:
    """Why gold was not executed: a pure insertion, a branch missed inside an executed function, or a
    function never reached; ``other`` without data. ``edits``: (keys, file, file_ord, line, kind). Only the
    patch's first python file that has edit lines is looked at."""
    cols = [*keys, "file"]
    first = edits.filter(F.col("file").endswith(".py")).groupBy(*keys).agg(F.min_by("file", "file_ord").alias("file"))
    edits = edits.join(first, cols, "left_semi")
    dels = edits.groupBy(*keys).agg(F.max((F.col("kind") == "deleted").cast("int")).alias("_del"))
    spans = functions.select(*cols, "name", "start", F.explode(F.sequence("start", "end")).alias("line"))
    gold_f = spans.join(edits.select(*cols, "line").distinct(), [*cols, "line"], "left_semi").select(*cols, "name", "start").distinct()
    live = spans.join(executed.select(*cols, "line").distinct(), [*cols, "line"], "left_semi").select(*cols, "name", "start").distinct()
    ran = gold_f.join(live, [*cols, "name", "start"], "left_semi").select(*keys).distinct().withColumn("_ran", F.lit(1))
    j = instances.select(*keys).join(dels, keys, "left").join(ran, keys, "left")
    return j.select(*keys, F.when(F.col("_del").isNull(), "other").when(F.col("_del") == 0, "insertion").when(F.col("_ran") == 1, "missed-branch")
                    .otherwise("func-never-reached").alias("mechanism"))


def miss_category(missed: DataFrame, files: DataFrame, executed: DataFrame, keys: list[str], delta: int = 2) -> DataFrame:
    """Missed gold lines by reach: outside the candidate files, executed, near an executed line, far."""
    cols = [*keys, "file"]
    near = (executed.select(*cols, F.col("line").alias("_l")).distinct()
            .withColumn("line", F.explode(F.sequence(F.col("_l") - delta, F.col("_l") + delta)))
            .groupBy(*cols, "line").agg(F.max((F.col("line") == F.col("_l")).cast("int")).alias("_exact")))
    j = missed.join(files.select(*cols).distinct().withColumn("_f", F.lit(1)), cols, "left").join(near, [*cols, "line"], "left")
    return j.withColumn("category", F.when(F.col("_f").isNull(), "outfile").when(F.col("_exact") == 1, "infile_exec")
                        .when(F.col("_exact") == 0, "infile_adj").otherwise("infile_far")).drop("_f", "_exact")


def recoverable_instances(categories: DataFrame, keys: list[str]) -> DataFrame:
    """An instance is recoverable when none of its missed lines is outside the files or far."""
    bad = F.col("category").isin("outfile", "infile_far")
    return categories.groupBy(*keys).agg(F.count(F.lit(1)).alias("missed"), (F.max(bad.cast("int")) == 0).alias("recoverable"))


def fail_mode(log: Column, applied: Column) -> Column:
    """crash / assertion / reproduced_unclear / not_reproduced from a test log."""
    t = F.coalesce(log, F.lit(""))
    kinds = F.regexp_extract_all(t, F.lit(C.EXCEPTION_TYPE), 1)
    real = F.size(F.filter(kinds, lambda e: (e.endswith("Error") | e.endswith("Exception")) & (e != "AssertionError"))) > 0
    low = F.lower(t)
    failed = (low.rlike(r"\b\d+\s+(failed|error)") | F.contains(low, F.lit("failed (")) | F.contains(low, F.lit("errors="))
              | F.contains(low, F.lit("failures="))) & F.coalesce(applied, F.lit(True))
    return (F.when(~failed, "not_reproduced").when(t.rlike(C.TRACEBACK) | real, "crash")
            .when(F.array_contains(kinds, "AssertionError"), "assertion").otherwise("reproduced_unclear"))


def primary_group(instances: DataFrame, fired: DataFrame, leaks: DataFrame, keys: list[str]) -> DataFrame:
    """Instances whose test patch adds a check and whose evidence does not quote a gold line."""
    return instances.join(fired.filter("fired").select(*keys).distinct(), keys, "left_semi").join(leaks.select(*keys).distinct(), keys, "left_anti")


def bucket_size(n: Column) -> Column:
    return F.when(n <= 200, "<=200").when(n <= 1000, "200-1000").when(n <= 3000, "1000-3000").otherwise(">3000")


def bucket_gold(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 3, "2-3").otherwise(">=4")


def bucket_files(n: Column) -> Column:
    return F.when(n <= 1, "1").otherwise(">=2")


def top_groups(rows: DataFrame, group: str, n: int = 6) -> DataFrame:
    """Rows of the ``n`` most frequent groups. The kept list has ``n`` rows."""
    top = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_c")).orderBy(F.desc("_c"), F.asc(group)).limit(n).select(group)
    return rows.join(F.broadcast(top), group, "left_semi")


def apply_exclusions(instances: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Every instance with its status and the reason for an exclusion."""
    return instances.join(excluded.select(key, "reason"), key, "left").withColumn("status", F.when(F.col("reason").isNull(), "confirmed").otherwise("excluded"))
