"""What the operators share: tables cut from their lineage, row keys, components of a link table."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode
    and an error anywhere else (executors would not see it)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="trailrank-")
    return _LOCAL[app]


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: its lineage ends there, and a lost
    executor costs only the tasks that read it. The shuffle files behind it are released."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trailrank-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by ``store`` that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``text_key``. Rows are told apart by the id and the key of
    the text, so a null or a repeated id loses nothing and repeated rows get the same answer."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def whole_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``documents``, with every column of the row in the struct ``row``, out of reach of other names."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def with_text(rows: DataFrame, columns: list[str], new: Column, text_col: str = "text") -> DataFrame:
    """The columns of ``row`` with another text (null stays null) and, where there is one, its count ``n_chars``."""
    null = F.col("row")[text_col].isNull()
    rows = rows.select("row", F.when(~null, new).alias("said"))
    swap = {text_col: F.col("said"), "n_chars": F.when(null, F.col("row")["n_chars"]).otherwise(F.length("said").cast("long"))}
    return rows.select(*[swap.get(c, F.col("row")[c]).alias(c) for c in columns])


def with_columns(batch, schema: T.StructType, values: dict):
    """An Arrow batch of ``schema`` from columns or arrays by name."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([_array(values[f.name], f.type) for f in arrow], schema=arrow)


def _array(value, kind):
    import pyarrow as pa
    if isinstance(value, pa.ChunkedArray):
        value = value.combine_chunks()
    if isinstance(value, pa.Array):
        return value if value.type == kind else value.cast(kind)
    return pa.array(value, type=kind)


def components(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, list[str]]:
    """Least node reachable by links: ``nodes(node)``, ``links(a, b)`` to ``(node, component)`` and the paths that hold it.

    In each round every node points to the least of itself and its neighbours, and links are redrawn between what
    their ends point to. A node that points to another leaves the graph unless others point to it, so what is left
    at least halves, a star takes one round, and all rounds together cost about twice the first. The pointers of all
    rounds, followed in turn, lead to the least node. A round is two written tables; a node with many links is only
    ever a join key between freshly shuffled tables, which Spark can split."""
    spark = nodes.sparkSession
    edges, path = store(links.select(F.col("a").alias("node"), F.col("b").alias("other"))
                        .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).filter("node <> other").distinct())
    turns, kept = [], []
    while not edges.isEmpty():
        points, points_path = store(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("to")))
        ends = edges.join(points.withColumnRenamed("to", "a"), "node").join(points.select(F.col("node").alias("other"), F.col("to").alias("b")), "other")
        fewer, fewer_path = store(ends.filter("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other")).distinct())
        drop(spark, path)
        edges, path = fewer, fewer_path
        turns.append(points)
        kept.append(points_path)
    last = None
    for points in reversed(turns):
        if last is not None:
            points = points.join(last.select(F.col("node").alias("to"), F.col("to").alias("on")), "to", "left").select("node", F.coalesce("on", "to").alias("to"))
        last = points
    if last is None:
        return nodes.select("node", F.col("node").alias("component")), [path]
    return nodes.join(last, "node", "left").select("node", F.coalesce("to", "node").alias("component")), [*kept, path]
