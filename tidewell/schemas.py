"""Columns, value ranges and code tables of the hourly panel."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

KEYS = ["patient_id", "hour_from_admission"]
ENTITY, HOUR = KEYS
MAX_HOURS = 72

# The panel's columns by group.
VITALS = ["heart_rate", "respiratory_rate", "spo2_pct", "temperature_c", "systolic_bp", "diastolic_bp"]
LABS = ["wbc_count", "lactate", "creatinine", "crp_level", "hemoglobin"]
NUMERIC = [*VITALS, *LABS, "oxygen_flow", "mobility_score", "nurse_alert", "sepsis_risk_score"]
CATEGORICAL = ["gender", "admission_type", "oxygen_device"]
STATIC = ["age", "gender", "comorbidity_index", "admission_type"]

# Inclusive ranges of valid measurements.
RANGES = {
    "heart_rate": (20, 300),
    "respiratory_rate": (4, 60),
    "spo2_pct": (50, 100),
    "temperature_c": (30, 45),
    "systolic_bp": (40, 300),
    "diastolic_bp": (20, 200),
    "oxygen_flow": (0, 100),
    "mobility_score": (0, 4),
    "nurse_alert": (0, 1),
    "wbc_count": (0, 100),
    "lactate": (0, 30),
    "creatinine": (0, 20),
    "crp_level": (0, 500),
    "hemoglobin": (2, 25),
    "sepsis_risk_score": (0, 1),
    "age": (0, 120),
    "comorbidity_index": (0, 20),
    "hour_from_admission": (0, 72),
}
CATEGORIES = {
    "gender": ["F", "M"],
    "admission_type": ["ED", "Elective", "Transfer"],
    "oxygen_device": ["none", "nasal", "mask", "hfnc", "niv"],
}
INTEGERS = ["patient_id", "hour_from_admission", "mobility_score", "nurse_alert", "age", "comorbidity_index"]

# Laboratory and vital-sign codes (LOINC) and their panel columns.
LOINC = {
    "8867-4": "heart_rate",
    "9279-1": "respiratory_rate",
    "2708-6": "spo2_pct",
    "8310-5": "temperature_c",
    "8480-6": "systolic_bp",
    "8462-4": "diastolic_bp",
    "6690-2": "wbc_count",
    "2524-7": "lactate",
    "2160-0": "creatinine",
    "1988-5": "crp_level",
    "718-7": "hemoglobin",
}


def panel_type(columns: list[str] | None = None) -> StructType:
    """The explicit schema for reading panel files; nothing is inferred."""
    kinds = {"patient_id": LongType(), "hour_from_admission": LongType()} | {c: StringType() for c in CATEGORICAL}
    kinds |= {c: IntegerType() for c in INTEGERS[2:]}
    names = columns or [*KEYS, *NUMERIC, "oxygen_device", *STATIC, "deterioration_hour"]
    return StructType([StructField(c, kinds.get(c, DoubleType())) for c in names])
