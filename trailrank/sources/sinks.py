"""Writers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(rows: DataFrame, path: str, run: str, file_format: str = "parquet") -> None:
    """Append the records of one run; runs are partitions, nothing is rewritten."""
    rows.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").format(file_format).save(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
