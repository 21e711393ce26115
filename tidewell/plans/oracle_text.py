"""Shared pieces of the DuckDB oracles."""

from __future__ import annotations

PANEL = """e AS (SELECT CAST(user_id AS BIGINT) AS patient_id, CAST(floor(((day(ts)-1)*24+hour(ts))/10.0) AS BIGINT) AS hour_from_admission, event_type, value FROM events),
panel AS (SELECT patient_id, hour_from_admission,
  60.0 + max(CASE WHEN event_type='view' THEN value END)*0.6 AS heart_rate, 10.0 + max(CASE WHEN event_type='click' THEN value END)*0.2 AS respiratory_rate,
  100.0 - max(CASE WHEN event_type='error' THEN value END)*0.1 AS spo2_pct, 36.0 + max(CASE WHEN event_type='purchase' THEN value END)*0.02 AS temperature_c,
  140.0 - max(CASE WHEN event_type='signup' THEN value END)*0.5 AS systolic_bp, 85.0 - max(CASE WHEN event_type='signup' THEN value END)*0.2 AS diastolic_bp,
  0.5 + max(CASE WHEN event_type='error' THEN value END)*0.03 AS lactate, 60.0 + max(value)*0.6 AS hr_dense, 130.0 - min(value)*0.5 AS sbp_dense
  FROM e GROUP BY patient_id, hour_from_admission),
full_panel AS (SELECT *, CAST(18 + patient_id % 70 AS INTEGER) AS age, CASE WHEN patient_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender, CAST(patient_id % 9 AS INTEGER) AS comorbidity_index,
  CASE patient_id % 3 WHEN 0 THEN 'ED' WHEN 1 THEN 'Elective' ELSE 'Transfer' END AS admission_type,
  CAST(CASE WHEN patient_id % 4 = 0 THEN patient_id % 72 ELSE -1 END AS BIGINT) AS deterioration_hour,
  CAST((patient_id + hour_from_admission) % 5 AS INTEGER) AS mobility_score, CAST(CASE WHEN (patient_id + hour_from_admission) % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS nurse_alert FROM panel)"""
SIGNALS = ["heart_rate", "respiratory_rate", "spo2_pct", "temperature_c", "systolic_bp", "diastolic_bp", "lactate"]
W12 = "(PARTITION BY patient_id ORDER BY hour_from_admission ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
BACK = "(PARTITION BY patient_id ORDER BY hour_from_admission ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = "(PARTITION BY patient_id ORDER BY hour_from_admission ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
KEYS = "patient_id, hour_from_admission"
#: Scores and labels for the evaluation queries: a bounded rational function of the text's length, rounded.
SCORED = """s AS (SELECT d.doc_id, CAST(l.quality AS BIGINT) AS label, round(d.n_chars / (d.n_chars + 1500.0), 3) AS score, d.lang, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL)"""


def with_panel(rest: str, more: str = "") -> str:
    return f"WITH {PANEL}{more} {rest}"


def rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)
