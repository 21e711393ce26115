"""Feeds: landed message frames, searches over observations, and rows for topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.schemas import ENTITY

START, END = "\x0b", "\x1c\r"
LOINC_SYSTEM = "http://loinc.org"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """``message``: the framed messages of landed connection dumps; bytes before a frame's first start are dropped.

    The frame's end is the reader's line separator, so large dumps are split between tasks. What follows a file's last end is
    read as a frame too if it has a start.
    """
    parts = spark.read.option("lineSep", END).text(path)
    at = F.instr("value", START)
    return parts.filter(at > 0).select(F.substring(F.col("value"), at + 1, F.length("value")).alias("message"))


def search(obs: DataFrame, category: str | None = None, code: str | None = None, patient: str | None = None, count: int = 100) -> DataFrame:
    """Each patient's ``count`` newest observations of a category or LOINC code, newest first; of one time the larger id first.

    Observations without a date come last. The rank is cut before the shuffle, so a patient with many rows sends few.
    """
    subject = F.element_at(F.split("subject.reference", "/"), -1)
    rows = obs.withColumn("patient_id", subject)
    if category is not None:
        rows = rows.filter(of_category(category))
    if code is not None:
        rows = rows.filter(F.exists("code.coding", lambda c: (c["system"] == LOINC_SYSTEM) & (c["code"] == code)))
    if patient is not None:
        rows = rows.filter(F.col("patient_id") == patient)
    newest = Window.partitionBy("patient_id").orderBy(F.desc_nulls_last(F.try_to_timestamp("effectiveDateTime")), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= count)


def of_category(name: str) -> Column:
    """Whether an observation is of a category, such as ``vital-signs`` or ``laboratory``; without any it isn't."""
    return F.coalesce(F.exists("category", lambda c: F.exists(c["coding"], lambda k: k["code"] == name)), F.lit(False))


def topic_rows(df: DataFrame, key: str = ENTITY) -> DataFrame:
    """``key, value``: a message for each row, keyed by entity so that an entity's messages keep their order."""
    return df.select(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("key"), F.to_json(F.struct("*")).alias("value"))


def produce(df: DataFrame, servers: str, topic: str, key: str = ENTITY) -> None:
    """Rows to a topic, acknowledged by all replicas, each tried again three times (needs Spark's Kafka package)."""
    out = topic_rows(df, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    out.option("kafka.acks", "all").option("kafka.retries", "3").save()
