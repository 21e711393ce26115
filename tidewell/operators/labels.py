"""Look-ahead outcome labels, class balance and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.schemas import ENTITY, HOUR


def _met(condition: Column) -> Column:
    """A comparison with a null counts as not met."""
    return F.coalesce(condition, F.lit(False))


def deterioration(df: DataFrame, horizons: tuple[int, ...] = (6, 10, 12)) -> DataFrame:
    """1 where the event's hour lies in (t, t + h]; -1 and null mean no event."""
    d, t = F.col("deterioration_hour"), F.col(HOUR)
    return df.withColumns({f"deterioration_next_{h}h": _met((d >= 0) & (t < d) & (d <= t + h)).cast("int") for h in horizons})


def sepsis_event() -> Column:
    c = F.col
    infection = _met(c("lactate") >= 2) | _met(c("wbc_count") >= 12) | _met(c("temperature_c") >= 38.3) | _met(c("temperature_c") <= 36)
    return _met(c("sepsis_risk_score") >= 0.6) | (_met(c("respiratory_rate") >= 22) & _met(c("systolic_bp") <= 100) & infection)


def cardiac_event() -> Column:
    c = F.col
    hard = _met(c("heart_rate") < 35) | _met(c("heart_rate") > 180) | _met(c("systolic_bp") < 65)
    soft = _met(c("heart_rate") < 40) | _met(c("heart_rate") > 150) | _met(c("systolic_bp") < 70)
    return hard | ((_met(c("deterioration_event") == 1) | _met(c("deterioration_hour") > 0)) & soft)


def respiratory_event() -> Column:
    c = F.col
    return _met(c("spo2_pct") < 88) | (_met(c("spo2_pct") < 90) & _met(c("respiratory_rate") >= 28)) | (_met(c("oxygen_flow") >= 6) & _met(c("respiratory_rate") >= 26))


#: Outcome: event and horizon in hours.
OUTCOMES = {
    "sepsis_next_6h": (sepsis_event, 6),
    "cardiac_arrest_next_12h": (cardiac_event, 12),
    "respiratory_failure_next_12h": (respiratory_event, 12),
}


def look_ahead(df: DataFrame, outcomes: dict = OUTCOMES) -> DataFrame:
    """1 where the entity has an event in (t, t + h]: one shuffle for all outcomes. Missing signals count as null."""
    needed = ("sepsis_risk_score", "wbc_count", "oxygen_flow", "deterioration_hour", "deterioration_event")
    wide = df.withColumns({c: F.lit(None).cast("double") for c in needed if c not in df.columns})
    w = Window.partitionBy(ENTITY).orderBy(HOUR)
    new = {n: F.coalesce(F.max(event().cast("int")).over(w.rangeBetween(1, h)), F.lit(0)) for n, (event, h) in outcomes.items() if n not in df.columns}
    return wide.withColumns(new).select(*df.columns, *new)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Counts, rates, imbalance and how many entities ever have an event; entities are pre-aggregated."""
    per = df.groupBy(ENTITY).agg(F.count(label).alias("n"), F.sum(label).alias("p"), F.max(label).alias("m"))
    total = per.agg(F.sum("n").alias("rows"), F.sum("p").alias("positives"), F.count("*").alias("entities"), F.sum("m").alias("entities_with_event"))
    ratio = F.try_divide(F.col("rows") - F.col("positives"), F.col("positives"))
    return total.select(
        "rows",
        "positives",
        "entities",
        "entities_with_event",
        F.round(F.col("positives") / F.col("rows"), 6).alias("positive_rate"),
        F.round(F.col("entities_with_event") / F.col("entities"), 6).alias("entity_event_rate"),
        F.round(ratio, 6).alias("imbalance_ratio"),
        F.when(ratio > 10, "severe").when(ratio > 3, "moderate").otherwise("balanced").alias("imbalance"),
    )


def sample_weights(df: DataFrame, label: str, root: bool = False) -> DataFrame:
    """Balanced class weights n / (2 n_c), or their square roots, on each row."""
    totals = df.agg(F.count(label).alias("_n"), F.sum(label).alias("_p"))
    of_class = F.when(F.col(label) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    weight = F.col("_n") / (2.0 * of_class)
    return df.crossJoin(F.broadcast(totals)).withColumn("weight", F.sqrt(weight) if root else weight).drop("_n", "_p")

