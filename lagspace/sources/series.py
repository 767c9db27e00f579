"""The series contract: key columns, a dense 0-based position ``t`` and double value columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_table(df: DataFrame, order_by: Sequence[str], values: dict[str, str | Column], keys: Sequence[str] = ()) -> DataFrame:
    """Ordered observations as series: keys, t (0, 1, ...), and each value cast to double.

    Positions come from a window over the keys: one shuffle, which later windows
    and joins on the same keys reuse. A series without keys is ordered in one
    task; aggregate it (per day, per hour) first.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by)
    cols = [(F.col(v) if isinstance(v, str) else v).cast("double").alias(n) for n, v in values.items()]
    return df.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("t"), *cols)


def aggregated(df: DataFrame, bucket: Column, value: Column, name: str = "x") -> DataFrame:
    """A single series: one value per bucket of an ordered column. Partial sums make the shuffle one row per bucket and task."""
    return from_table(df.groupBy(bucket.alias("_b")).agg(value.alias("_v")), ["_b"], {name: "_v"})
