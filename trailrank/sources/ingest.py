"""Readers: nested JSON and text become long tables with explicit schemas."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailrank import schemas
from trailrank.functions.ordered import first_k
from trailrank.operators.parse import is_repo_source, normalize_path, numbered_lines


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def text_list(col: Column) -> Column:
    """A list stored as JSON text, or the text itself as a one-item list."""
    return F.coalesce(F.from_json(col, "array<string>"), F.when(col.isNotNull() & (col != ""), F.array(col)), F.array().cast("array<string>"))


def read_instances(spark: SparkSession, path: str, n_pool: int | None = None, file_format: str = "json") -> DataFrame:
    """Instance pool with its test lists as arrays; the cap takes the first ids in order."""
    return instance_pool(spark.read.schema(schemas.INSTANCES).format(file_format).load(path), n_pool)


def instance_pool(rows: DataFrame, n_pool: int | None = None) -> DataFrame:
    out = rows.withColumns({"failing": text_list(F.col("FAIL_TO_PASS")), "passing": text_list(F.col("PASS_TO_PASS"))})
    return out if n_pool is None else out.orderBy("instance_id").limit(n_pool)


def read_source_files(spark: SparkSession, root: str) -> DataFrame:
    """Whole files below ``root`` as (path, text)."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/").alias("path"), F.col("value").alias("text"))


def read_source_lines(spark: SparkSession, root: str) -> DataFrame:
    return numbered_lines(read_source_files(spark, root), ["path"])


def list_paths(files: DataFrame, keys: list[str], path: str = "path", suffix: str = ".py") -> DataFrame:
    """Distinct source paths of a snapshot; one row each, never gathered into a list."""
    return files.filter(F.col(path).endswith(suffix)).select(*keys, F.col(path).alias("path")).distinct()


#: The part of a tree listing that is read.
TREE = "truncated boolean, tree array<struct<path: string, type: string>>"


def list_remote_tree(raw: DataFrame, keys: list[str], text: str = "tree", suffix: str = ".py") -> DataFrame:
    """Source paths of a tree listing (JSON text) and whether the listing was cut short: (keys, truncated, path). A listing without
    source files, or that cannot be read, gives one row with a null path, so a cut that hides all of them is seen."""
    t = F.from_json(F.col(text), TREE)
    files = F.array_distinct(F.transform(F.filter(t["tree"], lambda x: (x["type"] == "blob") & x["path"].endswith(suffix)), lambda x: x["path"]))
    rows = raw.select(*keys, F.coalesce(t["truncated"], F.lit(False)).alias("truncated"), F.explode_outer(files).alias("path"))
    return rows.distinct()


def corpus_grep(lines: DataFrame, pattern: str, file_keys: list[str], per_file: int | None = None, limit: int | None = None, width: int = 300) -> DataFrame:
    """Lines that match a regular expression, text cut to ``width``; at most ``per_file`` per file
    and/or ``limit`` in file order overall."""
    hits = lines.filter(F.col("text").rlike(pattern)).select(*file_keys, "line_no", F.substring("text", 1, width).alias("text"))
    if per_file is not None:
        hits = first_k(hits, file_keys, [F.asc("line_no")], per_file).drop("pos")
    return hits if limit is None else hits.orderBy(*file_keys, "line_no").limit(limit)


def coverage_long(raw: DataFrame, keys: list[str], nested: bool = True) -> DataFrame:
    """Coverage maps to (keys, file, file_ord, line): repository sources only, empty lists dropped."""
    entries = raw.select(*keys, F.posexplode(F.map_entries("files")).alias("file_ord", "e"))
    lines = F.col("e.value.executed_lines") if nested else F.col("e.value")
    rows = entries.select(*keys, normalize_path(F.col("e.key")).alias("file"), "file_ord", F.explode(lines).alias("line"))
    return rows.filter(is_repo_source(F.col("file"))).distinct()


def value_trace_long(raw: DataFrame, keys: list[str]) -> DataFrame:
    """``file:line`` keys, split on the last colon, to (keys, file, line, var, repr)."""
    rows = raw.select(*keys, F.explode("trace").alias("at", "vars"))
    parts = {"file": normalize_path(F.regexp_extract("at", r"^(.*):(\d+)$", 1)), "line": F.expr(r"try_cast(regexp_extract(at, '^(.*):(\\d+)$', 2) as int)")}
    rows = rows.withColumns(parts).filter("line is not null").filter(is_repo_source(F.col("file")))
    return rows.select(*keys, "file", "line", F.explode("vars").alias("var", "repr"))


def locations_long(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Nested location strings to (keys, sample, file_no, file, loc_no, loc); blank entries and entries
    beyond the file list are dropped."""
    s = raw.select(*keys, "found_files", F.posexplode("found_edit_locs").alias("sample", "_s"))
    f = s.select(*keys, "sample", "found_files", F.posexplode("_s").alias("file_no", "_f"))
    f = f.withColumn("file", F.get("found_files", F.col("file_no"))).filter("file is not null")
    return f.select(*keys, "sample", "file_no", "file", F.posexplode("_f").alias("loc_no", "loc")).filter(F.trim("loc") != "")


def keyed_cache_long(raw: DataFrame, keys: list[str], cache: str = "votes") -> DataFrame:
    """Keys stored as a JSON pair ``["file", 63]`` to (keys, file, line, value)."""
    rows = raw.select(*keys, F.explode(cache).alias("key", "value")).withColumn("_k", F.from_json("key", "array<string>"))
    return rows.select(*keys, F.get("_k", F.lit(0)).alias("file"), F.expr("try_cast(get(_k, 1) as bigint)").alias("line"), "value")


def probe_answers_long(raw: DataFrame) -> DataFrame:
    """Keys joined by a vertical bar to columns: instance, file, line, role and arm."""
    p = F.split("key", r"\|")
    return raw.select(p[0].alias("instance_id"), F.get(p, F.lit(1)).alias("file"), F.get(p, F.lit(2)).try_cast("int").alias("line"),
                      F.coalesce("role", F.get(p, F.lit(3))).alias("role"), F.coalesce("arm", F.get(p, F.lit(4))).alias("arm"), "cat", "ans", "vf")


def arm_metrics_long(raw: DataFrame) -> DataFrame:
    """(instance_id, arm, k, hit) from the nested per-arm record."""
    rows = raw.select("instance_id", F.explode("arms").alias("arm", "m"))
    ks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"m.R{k}").alias("hit")) for k in (1, 3, 5, 10)]))
    return rows.select("instance_id", "arm", ks.alias("x")).select("instance_id", "arm", "x.k", "x.hit")


# ---- run control ----------------------------------------------------------------------

def pending_work(all_ids: DataFrame, done: DataFrame, key: str, counts_as_done: str = "true", forced: DataFrame | None = None) -> DataFrame:
    """Ids still to do. ``counts_as_done`` is the condition under which a stored row is final (so that
    errored or empty rows run again); ``forced`` ids run whatever is stored."""
    todo = all_ids.join(done.filter(counts_as_done).select(key).distinct(), key, "left_anti")
    if forced is None:
        return todo
    return todo.unionByName(all_ids.join(forced.select(key).distinct(), key, "left_semi")).distinct()


def restrict_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a frozen id list with the list's order as a column."""
    first = ids.groupBy(key).agg(F.min("ord").alias("ord"))
    return rows.join(first, key)


def given_file_override(retrieved: DataFrame, given: DataFrame, key: str, files: str = "files") -> DataFrame:
    """Use the given file list where there is one, else the retrieved list."""
    g = given.select(key, F.col(files).alias("_given"))
    return retrieved.join(g, key, "left").withColumn(files, F.coalesce("_given", files)).drop("_given")


def cache_precedence(caches: list[DataFrame], key: list[str], unit: list[str]) -> DataFrame:
    """Merge caches; for each ``key`` all rows come from the first cache that has it. The winner per
    key is an aggregate, so a key with many rows is not sorted."""
    out = None
    for i, c in enumerate(caches):
        c = c.withColumn("_prio", F.lit(i))
        out = c if out is None else out.unionByName(c)
    best = out.groupBy(*key).agg(F.min("_prio").alias("_prio"))
    return out.join(best, [*key, "_prio"], "left_semi").drop("_prio").dropDuplicates([*key, *unit])


def completeness_report(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Every expected artifact with present / missing."""
    have = actual.select(*key).distinct().withColumn("_h", F.lit(1))
    return expected.join(have, key, "left").withColumn("status", F.when(F.col("_h") == 1, "present").otherwise("missing")).drop("_h")
