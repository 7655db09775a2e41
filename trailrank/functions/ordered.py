"""Ordered computations inside groups that stay balanced when one group is huge.

A plain window puts a whole group into one task. That is the right plan while groups are
small, and the wrong one when a single instance holds a third of the table. Every function
here first measures the largest group (a partial aggregation that returns one number) and
then picks one of two plans with the same result:

* groups up to the limit: one window over the group keys;
* a group beyond it: rows are range-partitioned by (keys, order), so that a large group
  covers many slices; the slice number is written down with a checkpoint, each slice is
  handled by its own window, and one small row per (group, slice) carries counts, sums or
  last values from one slice to the next.

The order must be total inside a group, otherwise the result depends on the run.
"""
from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows a single task sorts without trouble; override with the conf key below.
MAX_GROUP_ROWS = 2_000_000
MAX_GROUP_ROWS_CONF = "trailrank.maxGroupRows"

_SLICE = "_slice"


def group_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_GROUP_ROWS_CONF, str(MAX_GROUP_ROWS)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local one only in local mode, where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="trailrank-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to a folder of their own and read back, so that what made them runs once, however often they are read."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the biggest group. Counts are combined before the shuffle."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return int(top or 0)


def needs_slices(df: DataFrame, keys: list[str]) -> bool:
    """Is some group larger than a task should hold? The answer only selects between two plans with
    the same result. It is measured anew each time, since a table can grow between two calls; callers that
    know a bound pass it on instead."""
    keys = list(keys)
    return largest_group(df.select(*keys), keys) > group_limit(df.sparkSession)


def frozen(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder and read back from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def freeze_slices(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Range-partition by (keys, order) into slices of at most about ``MAX_GROUP_ROWS`` rows and store
    the slice number of each row."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // MAX_GROUP_ROWS))
    ranged = df.repartitionByRange(n, *[F.col(k).asc() for k in keys], *order)
    return frozen(ranged.withColumn(_SLICE, F.spark_partition_id()))


def _join_slices(cut: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    names = [*keys, _SLICE]
    right = carry.select(*[F.col(k).alias(f"_r_{k}") for k in names], *[c for c in carry.columns if c not in names])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in names])
    return cut.join(right, cond, "left").drop(*[f"_r_{k}" for k in names])


def _earlier(keys: list[str]):
    """Slices of a group that come before the current one."""
    return W.partitionBy(*keys).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)


def number_rows(df: DataFrame, keys: list[str], order: list[Column], out: str = "pos", start: int = 1,
                sliced: bool | None = None) -> DataFrame:
    """Dense 1-based position of each row inside its group (``row_number``)."""
    keys = list(keys)
    if sliced is None:
        sliced = needs_slices(df, keys)
    if not sliced:
        number = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        return df.withColumn(out, (number + F.lit(start - 1)).cast("bigint"))
    cut = freeze_slices(df, keys, order)
    carry = (cut.groupBy(*keys, _SLICE).agg(F.count(F.lit(1)).alias("_n"))
             .select(*keys, _SLICE, F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)).alias("_before")))
    local = F.row_number().over(W.partitionBy(*keys, _SLICE).orderBy(*order))
    numbered = _join_slices(cut.withColumn("_local", local), carry, keys)
    return (numbered.withColumn(out, (F.col("_local") + F.col("_before") + F.lit(start - 1)).cast("bigint"))
            .drop("_local", "_before", _SLICE))


def running_last(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str,
                 sliced: bool | None = None) -> DataFrame:
    """Last non-null ``value`` seen up to and including the current row."""
    keys = list(keys)
    if sliced is None:
        sliced = needs_slices(df, keys)
    if not sliced:
        frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(frame))
    cut = freeze_slices(df, keys, order)
    slice_rows = W.partitionBy(*keys, _SLICE).orderBy(*order)
    cut = (cut.withColumn("_at", F.row_number().over(slice_rows))
              .withColumn("_local", F.last(value, ignorenulls=True)
                          .over(slice_rows.rowsBetween(W.unboundedPreceding, 0))))
    carry = (cut.groupBy(*keys, _SLICE)
             .agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_tail"))
             .select(*keys, _SLICE, F.last("_tail", ignorenulls=True).over(_earlier(keys)).alias("_before")))
    joined = _join_slices(cut, carry, keys)
    return joined.withColumn(out, F.coalesce("_local", "_before")).drop("_local", "_before", "_at", _SLICE)


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, sliced: bool | None = None) -> DataFrame:
    """Sum of ``value`` up to and including the current row."""
    keys = list(keys)
    if sliced is None:
        sliced = needs_slices(df, keys)
    if not sliced:
        return df.withColumn(out, F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    cut = freeze_slices(df, keys, order)
    carry = (cut.groupBy(*keys, _SLICE).agg(F.sum(value).alias("_n"))
             .select(*keys, _SLICE, F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)).alias("_before")))
    local = F.sum(value).over(W.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    joined = _join_slices(cut.withColumn("_local", local), carry, keys)
    return joined.withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", _SLICE)


def value_counts(df: DataFrame, by: list[str], value: str, **more: Column) -> DataFrame:
    """One row per distinct value of each group, stored: ``_c`` rows (0 for null values, which are kept) with the sums of ``more`` over them, the rows up
    to and including it ``_to`` and the group's rows ``_n``. Means, shares and medians of a group follow from these rows alone."""
    counted = frozen(df.groupBy(*by, value).agg(F.count(value).alias("_c"), F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(n) for n, c in more.items()]))
    total = counted.groupBy(*by).agg(F.sum("_c").alias("_n"))
    return running_sum(counted, by, [F.asc_nulls_first(value)], "_c", "_to").join(total, by)


def median_of(value: str) -> Column:
    """Aggregate over ``value_counts`` rows: the value in the middle, or the mean of the two there."""
    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_to") - F.col("_c") <= place) & (F.col("_to") > place), F.col(value)))
    return (at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2


#: Spark cuts groups before the shuffle for limits up to this (its windowGroupLimitThreshold).
GROUP_CUT = 1000


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "pos") -> DataFrame:
    """First ``k`` rows of each group. Up to ``GROUP_CUT`` Spark cuts each task's groups to ``k``
    rows before the shuffle (window group limit), so a huge group never travels whole; larger cuts
    are numbered with the size check."""
    if k > GROUP_CUT:
        return number_rows(df, keys, order, out).filter(F.col(out) <= k)
    number = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, number.cast("bigint")).filter(F.col(out) <= k)
