"""Small tables kept beside the data: versions, devices and thresholds, rounds of training, runs and explanations.

A table is written as a new snapshot and read from the newest one that is whole, so a writer that is lost leaves the table before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the snapshots, the whole ones only, in order."""
    files, root = _files(spark, folder)
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    whole = [n for n in names if n.startswith("snapshot-") and files.exists(_files(spark, f"{folder}/{n}/_SUCCESS")[1])]
    return sorted(int(n.split("-")[1]) for n in whole)


def save(table: DataFrame, folder: str, keep: int = 3) -> int:
    """Writes the next snapshot, drops those beyond the newest ``keep``, and tells its number."""
    spark = table.sparkSession
    number = max(_snapshots(spark, folder), default=0) + 1
    table.write.mode("overwrite").parquet(f"{folder}/snapshot-{number:06d}")
    for old in _snapshots(spark, folder)[:-keep]:
        files, path = _files(spark, f"{folder}/snapshot-{old:06d}")
        files.delete(path, True)
    return number


def load(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest snapshot, or an empty table of ``schema``."""
    found = _snapshots(spark, folder)
    return spark.read.schema(schema).parquet(f"{folder}/snapshot-{found[-1]:06d}") if found else spark.createDataFrame([], schema)


def read_keyed(spark: SparkSession, path: str, record: str, key: str = "key") -> DataFrame:
    """Rows of a JSON object of records by key; fields of ``record`` (a column list) that a record lacks are null."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{record}>>").alias("m"))
    return whole.select(F.explode("m").alias(key, "r")).select(key, "r.*")


def drop_artifacts(before: DataFrame, after: DataFrame, folder: str, key: str = "version_id") -> DataFrame:
    """Removes the artifact folders of versions that are in ``before`` and no longer in ``after``; a version for each row removed.

    Artifacts are folders named by version; the registry keeps some tens of them.
    """
    spark = before.sparkSession
    gone = sorted(r[0] for r in before.select(key).join(after.select(key), key, "left_anti").distinct().collect())
    removed = []
    for version in gone:
        files, path = _files(spark, f"{folder}/{version}")
        if files.delete(path, True):
            removed.append((version,))
    return spark.createDataFrame(removed, f"{key} string")


def save_round(cells: DataFrame, about: DataFrame, folder: str, number: int) -> None:
    """A round's averaged parameters (long table) and its facts; writing the same round again replaces it."""
    cells.write.mode("overwrite").parquet(f"{folder}/cells/round={number}")
    about.write.mode("overwrite").parquet(f"{folder}/about/round={number}")


def read_round(spark: SparkSession, folder: str, part: str = "cells", number: int | None = None) -> DataFrame:
    """Of all rounds, with ``round``, or of one."""
    out = spark.read.parquet(f"{folder}/{part}")
    return out if number is None else out.filter(F.col("round") == number)


def last_metrics(logged: DataFrame) -> DataFrame:
    """``run_id, metric, value`` from logged ``run_id, metric, step, value``: each metric's value at its last step; of several at
    that step the largest."""
    return logged.groupBy("run_id", "metric").agg(F.max_by("value", F.struct("step", "value")).alias("value"))


def run_table(logged: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each run, a column for each of ``metrics``; null where a run didn't log it."""
    at = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    return last_metrics(logged).groupBy("run_id").agg(*[at(m) for m in metrics])


def write_explanations(rows: DataFrame, path: str) -> None:
    """Contributions as comma-separated files with a header."""
    rows.write.mode("overwrite").csv(path, header=True)


def write_profile(fitted: DataFrame, features: list[str], path: str) -> None:
    """One JSON row: the fitted statistics and the features in their order."""
    fitted.withColumn("features", F.array(*map(F.lit, features))).coalesce(1).write.mode("overwrite").json(path)
