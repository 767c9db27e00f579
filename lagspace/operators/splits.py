"""Folds in time: half-open bounds of training and validation ranges."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Fold(NamedTuple):
    train_start: int
    train_end: int
    val_start: int
    val_end: int


def temporal_fold(n: int, train_ratio: float, gap: int = 0) -> Fold:
    """The first share of n positions for training, the rest after a gap for validation."""
    if not 0 < train_ratio < 1:
        raise ValueError("train_ratio must be between 0 and 1")
    if gap < 0:
        raise ValueError("gap must be non-negative")
    end = int(n * train_ratio)
    if end <= 0:
        raise ValueError("Training set is empty")
    if end + gap >= n:
        raise ValueError("Validation set is empty")
    return Fold(0, end, end + gap, n)


def _windows(n: int, train: int, validation: int, stride: int | None, gap: int, grows: bool) -> list[Fold]:
    if n <= 0:
        raise ValueError(f"a series of {n} positions has no folds: n must be positive")
    if train <= 0 or validation <= 0:
        raise ValueError("train and validation sizes must be positive")
    if gap < 0:
        raise ValueError("gap must be non-negative")
    stride = validation if stride is None else stride
    if stride <= 0:
        raise ValueError("stride must be positive")
    begins = range(train + gap, n - validation + 1, stride)
    return [Fold(0 if grows else v - gap - train, v - gap, v, v + validation) for v in begins]


def expanding_folds(n: int, initial_train_size: int, validation_size: int, stride: int | None = None, gap: int = 0) -> list[Fold]:
    """Training ranges that grow from the start; there may be none."""
    return _windows(n, initial_train_size, validation_size, stride, gap, True)


def sliding_folds(n: int, train_size: int, validation_size: int, stride: int | None = None, gap: int = 0) -> list[Fold]:
    """Training ranges of one size that move along; there may be none."""
    return _windows(n, train_size, validation_size, stride, gap, False)


def frame(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    """fold, train_start, train_end, val_start, val_end."""
    return spark.createDataFrame([(i, *f) for i, f in enumerate(folds)], "fold int, train_start long, train_end long, val_start long, val_end long")


def assigned(series: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of a series with fold and role ('train' or 'val'); folds are few rows, broadcast."""
    t = F.col("t")
    role = F.when((t >= F.col("train_start")) & (t < F.col("train_end")), "train").when((t >= F.col("val_start")) & (t < F.col("val_end")), "val")
    hit = ((t >= F.col("train_start")) & (t < F.col("train_end"))) | ((t >= F.col("val_start")) & (t < F.col("val_end")))
    return series.join(F.broadcast(folds), hit).withColumn("role", role).drop("train_start", "train_end", "val_start", "val_end")
