"""Joins of fact tables, the continuous hourly grid, and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.schemas import CATEGORICAL, ENTITY, HOUR, KEYS, MAX_HOURS


def merge_facts(left: DataFrame, right: DataFrame, suffix: str = "_lab") -> DataFrame:
    """Full outer join on entity and hour; clashing columns of ``right`` get the suffix."""
    clash = [c for c in right.columns if c in left.columns and c not in KEYS]
    return left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), KEYS, "full")


def add_dimension(facts: DataFrame, dimension: DataFrame, key: str = ENTITY) -> DataFrame:
    """Left join of the dimension's columns that ``facts`` lacks. Spark broadcasts it if its size allows."""
    new = [c for c in dimension.columns if c not in facts.columns]
    return facts.join(dimension.select(key, *new), key, "left") if new else facts


def continuous_grid(df: DataFrame, max_hours: int = MAX_HOURS) -> DataFrame:
    """A row for each hour from an entity's first to its last (below ``max_hours``); hours without data have nulls."""
    span = df.groupBy(ENTITY).agg(F.min(HOUR).alias("a"), F.least(F.max(HOUR), F.lit(max_hours - 1)).alias("b")).filter("a <= b")
    grid = span.select(ENTITY, F.explode(F.sequence("a", "b")).alias(HOUR))
    return grid.join(df, KEYS, "left")


def in_order(df: DataFrame) -> DataFrame:
    """The panel in the order of entity and hour: by ranges, so that written files follow one another and a scan can skip."""
    return df.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)


def concatenate(*frames: DataFrame) -> DataFrame:
    """All rows of the frames, one after the other; a column that a frame lacks is null in its rows."""
    first, *rest = frames
    for more in rest:
        first = first.unionByName(more, allowMissingColumns=True)
    return first


def clip_stay(df: DataFrame, max_hours: int = MAX_HOURS) -> DataFrame:
    return df.filter(F.col(HOUR) < max_hours)


def resample(df: DataFrame, width: int, numeric: list[str]) -> DataFrame:
    """Buckets of ``width`` hours: means of numbers, the last row's categories."""
    if width == 1:
        return df.withColumn(HOUR, F.col(HOUR).cast("int"))
    bucket = (F.floor(F.col(HOUR) / width) * width).cast("long")
    last = [F.max_by(c, HOUR).alias(c) for c in CATEGORICAL if c in df.columns]
    return df.groupBy(ENTITY, bucket.alias(HOUR)).agg(*[F.avg(c).alias(c) for c in numeric], *last)


def fill_static(df: DataFrame, columns: list[str]) -> DataFrame:
    """Static columns filled forward, then backward, within the entity."""
    w = Window.partitionBy(ENTITY).orderBy(HOUR)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)) for c in columns if c in df.columns})
