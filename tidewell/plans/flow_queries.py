"""Queries that go through files and streams: lake, queue, splits and event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.checkpoints import shared_folder
from tidewell.operators import labels, split
from tidewell.plans.oracle_text import with_panel
from tidewell.plans.panel_queries import panel
from tidewell.schemas import ENTITY, HOUR, KEYS
from tidewell.sources import lake
from tidewell.sources.panel import table
from tidewell.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def at_hour() -> Column:
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.col(HOUR) * 3600)


@query(with_panel("SELECT patient_id, hour_from_admission, round(hr_dense, 6) AS hr_dense FROM panel WHERE hour_from_admission BETWEEN 24 AND 47"))
def k01_lake_round_trip(spark, sf_dir) -> DataFrame:
    """Envelopes written by type and day; one day is read back, pruned at the scan."""
    path = scratch(spark, "lake")
    lake.write_lake(lake.envelope(panel(spark, sf_dir).select(*KEYS, "hr_dense"), "icu-vitals", at_hour()), path)
    day = lake.read_partition(spark, path, "icu-vitals", "2024-01-02")
    return day.select(F.col("payload.patient_id").alias("patient_id"), F.col("payload.hour_from_admission").alias("hour_from_admission"), F.round("payload.hr_dense", 6).alias("hr_dense"))


@query(with_panel("SELECT 'icu-vitals' AS data_type, CAST(DATE '2024-01-01' + CAST(hour_from_admission // 24 AS INTEGER) AS VARCHAR) AS date FROM panel GROUP BY 2"))
def s07_list_partitions(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "lake")
    lake.write_lake(lake.envelope(panel(spark, sf_dir).select(*KEYS, "hr_dense"), "icu-vitals", at_hour()), path)
    return lake.list_partitions(spark, path).select("data_type", F.col("date").cast("string").alias("date"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS BIGINT) AS event_id FROM events WHERE event_type = 'view'")
def s09_queue_round_trip(spark, sf_dir) -> DataFrame:
    """Messages by topic to JSON lines and back; only one topic is read."""
    path = scratch(spark, "queue")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("timestamp"), F.to_json(F.struct("event_id", "value")).alias("value")
    )
    lake.queue_append(rows, path)
    good, _ = lake.read_queue(spark, path, "view")
    return good.select("key", F.from_json("value", "event_id long")["event_id"].alias("event_id"))


@query(
    with_panel(
        "SELECT patient_id, hour_from_admission FROM panel JOIN split USING (patient_id) WHERE split = 'test'",
        """, ids AS (SELECT DISTINCT patient_id FROM panel), ranked AS (SELECT patient_id, row_number() OVER (ORDER BY md5(concat(patient_id, ':42'))) AS r, count(*) OVER () AS n FROM ids),
split AS (SELECT patient_id, CASE WHEN r <= n - h THEN 'train' WHEN r <= n - h + h // 2 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, CAST(ceil(n * 3 / 10) AS BIGINT) AS h FROM ranked))""",
    )
)
def k06_split_round_trip(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "splits")
    p = labels.deterioration(panel(spark, sf_dir), (12,))
    lake.write_splits(split.apply_split(p, split.assign(p)), path)
    return spark.read.parquet(path).filter("split = 'test'").select(ENTITY, HOUR)


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def st01_hourly_windows(spark, sf_dir) -> DataFrame:
    """A stream over the event files with a watermark and tumbling windows."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    out = jobs.hourly(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "40 days")
    got = jobs.run_to_files(out, scratch(spark, "stream"))
    return got.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("mean", 6).alias("mean"), "low", "high")
