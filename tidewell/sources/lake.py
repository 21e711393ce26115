"""The data lake: envelopes, partitioned writes, pruned reads, the line queue, audit logs and the retraining buffer.

Files are partitioned by type and date only; entities are spread by hash within a partition, so that millions of entities
don't become millions of directories. A read by entity is pruned by file statistics instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "key string, timestamp timestamp, value string"
AUDIT = "timestamp timestamp, event_type string, source string, patient_id string, record_count long, status string, metadata map<string,string>"


def envelope(df: DataFrame, data_type: str, at: Column, key: str = "patient_id", source: str = "batch") -> DataFrame:
    """Metadata columns round a nested payload; a missing key becomes ``unknown``.

    The id is a hash of type, time and payload, so a task that runs again writes the same one.
    """
    identity = F.sha2(F.concat_ws("|", F.lit(data_type), F.lit(source), at.cast("string"), F.to_json(F.struct("*"))), 256)
    return df.select(
        F.substring(identity, 1, 12).alias("ingestion_id"),
        at.alias("ingestion_timestamp"),
        F.lit(source).alias("source"),
        F.lit("1.0.0").alias("schema_version"),
        F.lit(data_type).alias("data_type"),
        F.to_date(at).alias("date"),
        F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("patient_id"),
        F.struct("*").alias("payload"),
    )


def write_lake(enveloped: DataFrame, path: str, fmt: str = "parquet", files: int = 8) -> None:
    """Appends; rows of one day are spread over ``files`` files and sorted by entity in each."""
    spread = enveloped.repartition("data_type", "date", F.pmod(F.xxhash64("patient_id"), F.lit(files)))
    spread.sortWithinPartitions("data_type", "date", "patient_id").write.mode("append").partitionBy("data_type", "date").format(fmt).save(path)


def read_partition(spark: SparkSession, path: str, data_type: str, date: str, patient_id: str | None = None, fmt: str = "parquet") -> DataFrame:
    out = spark.read.format(fmt).load(path).filter((F.col("data_type") == data_type) & (F.col("date") == F.lit(date).cast("date")))
    return out.filter(F.col("patient_id") == patient_id) if patient_id is not None else out


def list_partitions(spark: SparkSession, path: str, data_type: str | None = None, fmt: str = "parquet") -> DataFrame:
    out = spark.read.format(fmt).load(path).select("data_type", "date").distinct()
    return out.filter(F.col("data_type") == data_type) if data_type else out


def queue_append(messages: DataFrame, path: str) -> None:
    """``topic, key, timestamp, value`` as JSON lines by topic and day."""
    messages.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("topic", "date").json(path)


def read_queue(spark: SparkSession, path: str, topic: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages, and the lines that aren't messages."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    lines = lines.filter(F.col("topic") == topic) if topic else lines
    parsed = lines.withColumn("m", F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE"}))
    good = F.col("m.value").isNotNull()
    keep = [c for c in lines.columns if c != "value"]
    return parsed.filter(good).select(*keep, "m.*"), parsed.filter(~good).select(*keep, "value")


def append_audit(events: DataFrame, path: str) -> None:
    events.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").json(path)


def read_audit(spark: SparkSession, path: str, date: str | None = None, event_type: str | None = None, patient_id: str | None = None) -> DataFrame:
    out = spark.read.schema(f"{AUDIT}, date date").json(path)
    for column, value in (("date", date), ("event_type", event_type), ("patient_id", patient_id)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def append_buffer(samples: DataFrame, path: str, at: Column, prediction: str = "prediction", outcome: str = "actual_outcome", key: str = "patient_id") -> None:
    """Retraining samples with their five bookkeeping columns, by day."""
    kept = samples.withColumns(
        {
            "_prediction": F.col(prediction).cast("double"),
            "_actual_outcome": F.col(outcome).cast("double"),
            "_patient_id": F.col(key).cast("string"),
            "_timestamp": F.unix_timestamp(at).cast("double"),
            "_ingested_at": F.current_timestamp(),
            "date": F.to_date(at),
        }
    )
    kept.drop(prediction, outcome).write.mode("append").partitionBy("date").parquet(path)


def clear_buffer(spark: SparkSession, path: str) -> int:
    """Removes the buffer's data files; how many there were."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0
    found, n = files.listFiles(root, True), 0
    while found.hasNext():
        n += found.next().getPath().getName().endswith(".parquet")
    files.delete(root, True)
    return n


def write_sequences(windows: DataFrame, path: str, columns: list[str], window: str = "window", split: str = "split") -> None:
    """Windows as rows of ``width x columns`` numbers, oldest first, by split; beside them a table that names the columns."""
    flat = F.flatten(F.transform(window, lambda r: F.array(*[r[c].cast("float") for c in columns])))
    windows.withColumn("values", flat).drop(window).write.mode("overwrite").partitionBy(split).parquet(f"{path}/sequences")
    windows.sparkSession.createDataFrame([(k, c) for k, c in enumerate(columns)], "position int, feature string").coalesce(1).write.mode("overwrite").json(f"{path}/features")


def read_sequences(spark: SparkSession, path: str, split: str) -> tuple[DataFrame, list[str]]:
    """A split's sequences, pruned at the scan, and the names of their columns in order."""
    names = [r["feature"] for r in spark.read.json(f"{path}/features").orderBy("position").collect()]  # a row for each feature
    return spark.read.parquet(f"{path}/sequences").filter(F.col("split") == split), names


def read_buffer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def buffer_size(spark: SparkSession, path: str) -> int:
    return spark.read.option("ignoreCorruptFiles", True).parquet(path).select("_timestamp").count()
