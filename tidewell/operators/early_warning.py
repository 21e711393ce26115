"""Early-warning point scores, the outcome catalogue and the clinical meaning of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Points of two published scores. For each signal the upper end of a band, itself included, and its points;
# values above the last end get the last points.
NEWS2 = {
    "respiratory_rate": ((8, 3), (11, 1), (20, 0), (24, 2), (None, 3)),
    "spo2_pct": ((91, 3), (93, 2), (95, 1), (None, 0)),
    "systolic_bp": ((90, 3), (100, 2), (110, 1), (219, 0), (None, 3)),
    "heart_rate": ((40, 3), (50, 1), (90, 0), (110, 1), (130, 2), (None, 3)),
    "temperature_c": ((35.0, 3), (36.0, 1), (38.0, 0), (39.0, 1), (None, 2)),
}
MEWS = {
    "systolic_bp": ((70, 3), (80, 2), (100, 1), (199, 0), (None, 2)),
    "heart_rate": ((40, 2), (50, 1), (100, 0), (110, 1), (129, 2), (None, 3)),
    "respiratory_rate": ((8, 3), (14, 0), (20, 1), (29, 2), (None, 3)),
    "temperature_c": ((35.0, 3), (38.4, 0), (None, 2)),
}
#: Points of NEWS2 for added oxygen and for a patient who isn't alert; levels that call for a response.
NEWS2_OXYGEN, NEWS2_NOT_ALERT, NEWS2_URGENT, MEWS_REVIEW = 2, 3, 7, 5
#: Points of MEWS by consciousness: alert, reacts to voice, to pain, unresponsive.
MEWS_AVPU = {"A": 0, "V": 1, "P": 2, "U": 3}


def points(value: Column, bands: tuple) -> Column:
    """Points of the band that holds ``value``; a missing value has none."""
    out = F.lit(bands[-1][1])
    for end, n in reversed(bands[:-1]):
        out = F.when(value <= end, n).otherwise(out)
    return F.when(value.isNull(), 0).otherwise(out)


def early_warning(df: DataFrame) -> DataFrame:
    """``df`` with ``news2, news2_urgent, mews, mews_review``. Inside the row.

    ``oxygen_flow`` above 0 counts as added oxygen and ``avpu`` (A, V, P or U) as consciousness; where the column or its value is
    missing, a patient breathes air and is alert.
    """
    flow = F.col("oxygen_flow") if "oxygen_flow" in df.columns else F.lit(None).cast("double")
    avpu = F.coalesce(F.upper("avpu"), F.lit("A")) if "avpu" in df.columns else F.lit("A")
    news = sum((points(F.col(c), b) for c, b in NEWS2.items()), F.lit(0))
    news = news + F.when(flow > 0, NEWS2_OXYGEN).otherwise(0) + F.when(avpu != "A", NEWS2_NOT_ALERT).otherwise(0)
    mews = sum((points(F.col(c), b) for c, b in MEWS.items()), F.lit(0))
    mews = mews + F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MEWS_AVPU.items() for x in kv]), avpu), F.lit(0))
    return df.withColumns({"news2": news, "news2_urgent": news >= NEWS2_URGENT, "mews": mews, "mews_review": mews >= MEWS_REVIEW})


# Label column, display name, horizon in hours, prevalence and ICD-10 codes of the four outcomes.
CATALOGUE = (
    ("deterioration_next_12h", "General Deterioration", 12, 0.10, ()),
    ("sepsis_next_6h", "Sepsis Onset", 6, 0.07, ("A41.9", "R65.20", "R65.21")),
    ("cardiac_arrest_next_12h", "Cardiac Arrest", 12, 0.02, ("I46.9", "I46.2", "I46.8")),
    ("respiratory_failure_next_12h", "Respiratory Failure", 12, 0.05, ("J96.00", "J96.01", "J96.20", "J80")),
)


def outcome_catalogue(spark: SparkSession) -> DataFrame:
    """A row for each outcome, in their fixed order."""
    rows = [(k, *row[:4], list(row[4])) for k, row in enumerate(CATALOGUE)]
    return spark.createDataFrame(rows, "position int, label_column string, display_name string, horizon_hours int, prevalence double, icd10 array<string>")


# What a part of a feature's name stands for; the first that a name contains counts.
MEANINGS = {
    "lactate": "Tissue hypoperfusion / sepsis marker",
    "heart_rate": "Cardiovascular instability",
    "respiratory_rate": "Respiratory distress",
    "systolic_bp": "Hemodynamic instability",
    "spo2_pct": "Oxygenation status",
    "temperature_c": "Infection / inflammatory response",
    "creatinine": "Renal function",
    "wbc_count": "Immune response / infection",
    "crp_level": "Systemic inflammation",
    "hemoglobin": "Oxygen-carrying capacity",
    "shock_index": "Compensated shock indicator",
    "map_": "Organ perfusion pressure",
    "qsofa": "Sepsis screening criteria",
    "hrv_": "Autonomic nervous system function",
    "bpv_": "Baroreflex sensitivity",
}
NO_MEANING = "Clinical feature"


def meaning(feature: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(F.lower(feature), F.lit(part)), text) for part, text in MEANINGS.items()], F.lit(NO_MEANING))
