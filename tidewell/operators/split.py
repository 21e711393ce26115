"""Entity-level splits without leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.schemas import ENTITY

#: Hex digits of the hash that make a bucket.
DIGITS = 3


def assign(entities: DataFrame, seed: int = 42) -> DataFrame:
    """``patient_id, split``: 70 / 15 / 15 by the order of a hash of the id, so the same for any cluster.

    Ranks are taken within buckets of the hash's first digits and moved by the counts of the buckets before, so no task orders
    all entities; ties are impossible for distinct ids.
    """
    ids = entities.select(ENTITY).distinct().withColumn("_h", F.md5(F.concat_ws(":", ENTITY, F.lit(seed)))).withColumn("_b", F.substring("_h", 1, DIGITS))
    counts = ids.groupBy("_b").agg(F.count("*").alias("_c"))
    n = F.sum("_c").over(Window.partitionBy())
    # one row for each bucket, 16 ** DIGITS at most, so one task may sum them and every executor may hold them
    before = counts.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before"), n.alias("_n")).withColumn("_held", F.ceil(F.col("_n") * 3 / 10))
    ranked = ids.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h"))).join(F.broadcast(before), "_b")
    rank, train = F.col("_before") + F.col("_r"), F.col("_n") - F.col("_held")
    split = F.when(rank <= train, "train").when(rank <= train + F.floor(F.col("_held") / 2), "val").otherwise("test")
    return ranked.select(ENTITY, split.alias("split"))


def apply_split(df: DataFrame, assignment: DataFrame) -> DataFrame:
    return df.join(assignment, ENTITY)


def split_statistics(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.countDistinct(ENTITY).alias("n_entities"), F.round(F.avg(label), 6).alias("positive_rate")
    )
