"""Set algebra over long tables of (keys, item)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pool_union(parts: list[DataFrame], cols: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*cols) for p in parts]).distinct()


def pool_intersect(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    return left.select(*cols).distinct().join(right.select(*cols).distinct(), cols, "left_semi")


def pool_except(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    return left.select(*cols).distinct().join(right.select(*cols).distinct(), cols, "left_anti")


def sample_merge(samples: DataFrame, cols: list[str], sample: str = "sample") -> DataFrame:
    """Union of the samples with the number of samples that hold each item. Duplicates inside a
    sample are removed by the set, whose size is bounded by the number of samples."""
    return samples.groupBy(*cols).agg(F.size(F.collect_set(sample)).alias("n_samples"))


def dilate(items: DataFrame, keys: list[str], line: str = "line", width: int = 10, length: str | None = None) -> DataFrame:
    """All lines within ``width`` of an item, clipped to 1..``length``."""
    low = F.greatest(F.lit(1), F.col(line) - width)
    high = F.col(line) + width if length is None else F.least(F.col(length), F.col(line) + width)
    return (items.withColumn(line, F.explode(F.when(high >= low, F.sequence(low, high))))
            .select(*keys, line).distinct())
