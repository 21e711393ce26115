"""Mini-batches of a table for training loops: an order for each epoch, numbers of batches, and reading from any step.

An epoch's order is that of a digest of seed, epoch and the row's keys. Rows are numbered in it by ranges and counts; consecutive rows
are a batch. The numbered table is written in that order, so a loop that goes on at a step reads from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.prefix import row_numbers


def numbered(df: DataFrame, keys: list[str], size: int, epoch: int = 0, seed: int = 42, drop_last: bool = False) -> DataFrame:
    """``df`` with ``epoch``, ``batch`` and ``place`` (in the batch), both from 0. ``keys`` tell rows apart; rows they don't are in any order.

    ``drop_last`` leaves out a last batch that isn't full.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    rows = row_numbers(df.withColumn("_order", order), ["_order", *keys], "_row", "_rows").drop("_order")
    rows = rows.filter(F.floor(F.col("_row") / size) < F.floor(F.col("_rows") / size)) if drop_last else rows
    return rows.withColumns({"epoch": F.lit(epoch), "batch": F.floor(F.col("_row") / size), "place": (F.col("_row") % size).cast("int")}).drop("_row", "_rows")


def write(rows: DataFrame, path: str) -> None:
    """Adds an epoch to the table at ``path``, in order within files, so that readers skip what lies before their step."""
    rows.repartitionByRange("batch", "place").sortWithinPartitions("batch", "place").write.mode("append").partitionBy("epoch").parquet(path)


def read(spark: SparkSession, path: str, epoch: int, step: int = 0) -> DataFrame:
    """The rows of an epoch's batches from ``step`` on, in order."""
    rows = spark.read.parquet(path).filter((F.col("epoch") == epoch) & (F.col("batch") >= step))
    return rows.repartitionByRange("batch", "place").sortWithinPartitions("batch", "place")


def batches(rows: DataFrame, features: list[str], label: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``number, x, y`` of each batch, in order. A training loop's driver holds one partition of ``rows`` at a time, never the table.

    ``rows`` come from :func:`read`; features that are null are NaN.
    """
    held, number = [], None
    for r in rows.select("batch", *[F.col(c).cast("double") for c in features], F.col(label).cast("double").alias("_y")).toLocalIterator():
        if number is not None and r[0] != number:
            yield _arrays(number, held)
            held = []
        number = r[0]
        held.append(tuple(np.nan if v is None else v for v in r[1:]))
    if held:
        yield _arrays(number, held)


def _arrays(number: int, rows: list[tuple]) -> tuple[int, np.ndarray, np.ndarray]:
    both = np.array(rows, dtype=np.float64)
    return number, both[:, :-1], both[:, -1]
