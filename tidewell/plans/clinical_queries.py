"""Queries over point scores, catalogues, demographics and statistics of comparison, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import clinical_docs, early_warning, labels, metrics
from tidewell.plans.model_queries import scored
from tidewell.plans.oracle_text import KEYS, SCORED, SIGNALS, with_panel
from tidewell.plans.panel_queries import _EVENTS, _LABEL, panel
from tidewell.schemas import ENTITY
from tidewell.schemas import KEYS as KEY_COLUMNS
from tidewell.sources.panel import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(
    with_panel(
        f"""SELECT {KEYS}, news2, news2 >= 7 AS news2_urgent, mews, mews >= 5 AS mews_review FROM (SELECT {KEYS}, CAST(
  CASE WHEN respiratory_rate IS NULL THEN 0 WHEN respiratory_rate <= 8 OR respiratory_rate > 24 THEN 3 WHEN respiratory_rate > 20 THEN 2 WHEN respiratory_rate <= 11 THEN 1 ELSE 0 END
  + CASE WHEN spo2_pct <= 91 THEN 3 WHEN spo2_pct <= 93 THEN 2 WHEN spo2_pct <= 95 THEN 1 ELSE 0 END
  + CASE WHEN systolic_bp <= 90 OR systolic_bp > 219 THEN 3 WHEN systolic_bp <= 100 THEN 2 WHEN systolic_bp <= 110 THEN 1 ELSE 0 END
  + CASE WHEN heart_rate <= 40 OR heart_rate > 130 THEN 3 WHEN heart_rate > 110 THEN 2 WHEN heart_rate <= 50 OR heart_rate > 90 THEN 1 ELSE 0 END
  + CASE WHEN temperature_c <= 35 THEN 3 WHEN temperature_c > 39 THEN 2 WHEN temperature_c <= 36 OR temperature_c > 38 THEN 1 ELSE 0 END AS INTEGER) AS news2, CAST(
  CASE WHEN systolic_bp <= 70 THEN 3 WHEN systolic_bp <= 80 OR systolic_bp > 199 THEN 2 WHEN systolic_bp <= 100 THEN 1 ELSE 0 END
  + CASE WHEN heart_rate > 129 THEN 3 WHEN heart_rate <= 40 OR heart_rate > 110 THEN 2 WHEN heart_rate <= 50 OR heart_rate > 100 THEN 1 ELSE 0 END
  + CASE WHEN respiratory_rate <= 8 OR respiratory_rate > 29 THEN 3 WHEN respiratory_rate > 20 THEN 2 WHEN respiratory_rate > 14 THEN 1 ELSE 0 END
  + CASE WHEN temperature_c <= 35 THEN 3 WHEN temperature_c > 38.4 THEN 2 ELSE 0 END AS INTEGER) AS mews FROM full_panel)"""
    )
)
def p26_early_warning(spark, sf_dir):
    return early_warning.early_warning(panel(spark, sf_dir)).select(*KEY_COLUMNS, "news2", "news2_urgent", "mews", "mews_review")


_OBSERVED = " UNION ALL ".join(
    [f"SELECT 'deterioration_next_12h' AS label_column, {_LABEL.format(h=12)} AS y FROM full_panel"]
    + [
        f"SELECT '{n}', CAST(EXISTS (SELECT 1 FROM full_panel f WHERE f.patient_id = p.patient_id AND f.hour_from_admission > p.hour_from_admission AND f.hour_from_admission <= p.hour_from_admission + {h} AND ({x})) AS INTEGER) FROM full_panel p"
        for n, (x, h) in _EVENTS.items()
    ]
)


@query(
    with_panel(
        """SELECT t.*, CAST(positives AS BIGINT) AS positives, round(rate, 6) AS rate FROM (VALUES (0, 'deterioration_next_12h', 'General Deterioration', 12, 0.10::DOUBLE, ''), (1, 'sepsis_next_6h', 'Sepsis Onset', 6, 0.07, 'A41.9,R65.20,R65.21'),
  (2, 'cardiac_arrest_next_12h', 'Cardiac Arrest', 12, 0.02, 'I46.9,I46.2,I46.8'), (3, 'respiratory_failure_next_12h', 'Respiratory Failure', 12, 0.05, 'J96.00,J96.01,J96.20,J80'))
  t(position, label_column, display_name, horizon_hours, prevalence, icd10) JOIN (SELECT label_column, sum(y) AS positives, avg(y) AS rate FROM ob GROUP BY 1) USING (label_column)""",
        f", ob AS ({_OBSERVED})",
    )
)
def l07_outcome_catalogue(spark, sf_dir):
    """The catalogue beside what the panel's labels have of each outcome."""
    p = panel(spark, sf_dir)
    names = ["deterioration_next_12h", *labels.OUTCOMES]
    rows = labels.deterioration(labels.look_ahead(p)).select(F.inline(F.array(*[F.struct(F.lit(n).alias("label_column"), F.col(n).alias("y")) for n in names])))
    seen = rows.groupBy("label_column").agg(F.sum("y").cast("long").alias("positives"), F.round(F.avg("y"), 6).alias("rate"))
    return early_warning.outcome_catalogue(spark).withColumn("icd10", F.array_join("icd10", ",")).join(seen, "label_column")


_NAMED = [*SIGNALS, "shock_index", "map", "qsofa", "hrv", "bpv", "Lactate_MAX", "other"]
_MEANS = (
    "CASE WHEN f LIKE '%lactate%' THEN 'Tissue hypoperfusion / sepsis marker' WHEN f LIKE '%heart^_rate%' ESCAPE '^' THEN 'Cardiovascular instability' WHEN f LIKE '%respiratory^_rate%' ESCAPE '^' THEN 'Respiratory distress' "
    "WHEN f LIKE '%systolic^_bp%' ESCAPE '^' THEN 'Hemodynamic instability' WHEN f LIKE '%spo2%' THEN 'Oxygenation status' WHEN f LIKE '%temperature%' THEN 'Infection / inflammatory response' "
    "WHEN f LIKE '%shock%' THEN 'Compensated shock indicator' WHEN f LIKE '%map^_%' ESCAPE '^' THEN 'Organ perfusion pressure' WHEN f LIKE '%qsofa%' THEN 'Sepsis screening criteria' "
    "WHEN f LIKE '%hrv^_%' ESCAPE '^' THEN 'Autonomic nervous system function' WHEN f LIKE '%bpv^_%' ESCAPE '^' THEN 'Baroreflex sensitivity' ELSE 'Clinical feature' END"
)


@query(f"WITH n AS (SELECT DISTINCT [{', '.join(repr(x) for x in _NAMED)}][1 + user_id % {len(_NAMED)}] || '_' || event_type AS feature FROM events) SELECT feature, {_MEANS.replace(' f ', ' lower(feature) ')} AS meaning FROM n")
def m10_feature_meanings(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in _NAMED])
    e = table(spark, sf_dir, "events").select(F.concat_ws("_", F.get(names, (F.col("user_id") % len(_NAMED)).cast("int")), "event_type").alias("feature")).distinct()
    return e.select("feature", early_warning.meaning(F.col("feature")).alias("meaning"))


_VISIT = "CASE patient_id % 4 WHEN 0 THEN 'EL' WHEN 1 THEN 'transfer' WHEN 2 THEN 'E' END"
_BORN = "DATE '1900-03-01' + CAST(patient_id * 97 % 43000 AS INTEGER)"
_AGE = "CAST(greatest(2024 - year(b) - CASE WHEN strftime(b, '%m%d') > '0101' THEN 1 ELSE 0 END, 0) AS INTEGER)"


@query(
    with_panel(
        f"""SELECT CAST(patient_id AS VARCHAR) AS mrn, coalesce({_AGE}, 50) AS age, gender, 0 AS comorbidity_index, CASE patient_id % 4 WHEN 0 THEN 'Elective' WHEN 1 THEN 'Transfer' ELSE 'ED' END AS admission_type
  FROM (SELECT DISTINCT patient_id, gender, CASE WHEN patient_id % 5 > 0 THEN CAST({_BORN} AS DATE) END AS b FROM full_panel) WHERE coalesce({_AGE}, 50) <= 120"""
    )
)
def x07_message_demographics(spark, sf_dir):
    """Admission messages: dates in both forms, unreadable ones, and visit segments, some without a code."""
    p = panel(spark, sf_dir).select(ENTITY, "gender").distinct().withColumn("b", F.date_add(F.lit("1900-03-01").cast("date"), (F.col(ENTITY) * 97 % 43000).cast("int")))
    born = F.when(F.col(ENTITY) % 5 == 0, "unknown").when(F.col(ENTITY) % 2 == 0, F.date_format("b", "yyyy-MM-dd")).otherwise(F.date_format("b", "yyyyMMdd"))
    visit = F.coalesce(F.expr(_VISIT), F.lit(""))
    text = F.concat_ws("\r", F.lit(r"MSH|^~\&|ADM|H|EHR|H|20240101||ADT^A01|1|P|2.5"), F.concat(F.lit("PID|1||"), ENTITY, F.lit("^^^H||DOE^J||"), born, F.lit("|"), "gender"), F.concat(F.lit("PV1|1|I|ICU^1|"), visit))
    return clinical_docs.demographics(clinical_docs.parse_hl7(p.select(text.alias("message"))), F.lit("2024-01-01").cast("date"), ["mrn"])


@query(
    with_panel(
        f"""SELECT CAST(patient_id AS VARCHAR) AS id, coalesce({_AGE}, 50) AS age, CASE WHEN gender = 'F' THEN 'F' ELSE 'M' END AS gender, 0 AS comorbidity_index, 'ED' AS admission_type
  FROM (SELECT DISTINCT patient_id, gender, CASE WHEN patient_id % 5 > 0 THEN CAST({_BORN} AS DATE) END AS b FROM full_panel) WHERE coalesce({_AGE}, 50) <= 120"""
    )
)
def x06_bundle_patients(spark, sf_dir):
    """Patients of bundles that hold an observation too; every fifth has no birth date, men are named in part as unknown."""
    p = panel(spark, sf_dir).select(ENTITY, "gender").distinct().withColumn("b", F.date_add(F.lit("1900-03-01").cast("date"), (F.col(ENTITY) * 97 % 43000).cast("int")))
    sex = F.when(F.col("gender") == "F", "female").when(F.col(ENTITY) % 3 == 0, "unknown").otherwise("male")
    one = F.struct(F.lit("Patient").alias("resourceType"), F.col(ENTITY).cast("string").alias("id"), sex.alias("gender"), F.when(F.col(ENTITY) % 5 > 0, F.date_format("b", "yyyy-MM-dd")).alias("birthDate"))
    bundle = F.concat(F.lit('{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Observation","id":"o"}},{"resource":'), F.to_json(one), F.lit("}]}"))
    return clinical_docs.demographics(clinical_docs.patients(p.select(bundle.alias("bundle"))), F.lit("2024-01-01").cast("date"), ["id"])


@query(
    f"""WITH {SCORED}, p AS (SELECT label, score AS old, least(1.0, score * 1.2) AS new FROM s),
m AS (SELECT label, new - old AS gain, sign(CAST(new >= 0.25 AS INTEGER) + CAST(new >= 0.5 AS INTEGER) + CAST(new >= 0.75 AS INTEGER) - CAST(old >= 0.25 AS INTEGER) - CAST(old >= 0.5 AS INTEGER) - CAST(old >= 0.75 AS INTEGER)) AS move FROM p)
SELECT round(avg(move) FILTER (label = 1) - avg(move) FILTER (label = 0), 6) AS nri, round(avg(gain) FILTER (label = 1) - avg(gain) FILTER (label = 0), 6) AS idi FROM m"""
)
def a73_reclassification(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("new", F.least(F.lit(1.0), F.col("score") * 1.2))
    return metrics.reclassification(s, "score", "new").select(F.round("nri", 6).alias("nri"), F.round("idi", 6).alias("idi"))


@query(
    f"""WITH {SCORED}, c AS (SELECT lang, CAST(sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM s WHERE label = 1 GROUP BY lang)
SELECT lang, round((k / n + 1.9208 / n - 1.96 * sqrt((k / n * (1 - k / n) + 0.9604 / n) / n)) / (1 + 3.8416 / n), 6) AS low, round((k / n + 1.9208 / n + 1.96 * sqrt((k / n * (1 - k / n) + 0.9604 / n) / n)) / (1 + 3.8416 / n), 6) AS high FROM c"""
)
def a73_wilson_sensitivity(spark, sf_dir):
    counts = scored(spark, sf_dir).filter("label = 1").groupBy("lang").agg(F.sum((F.col("score") >= 0.5).cast("int")).alias("k"), F.count("*").alias("n"))
    return counts.select("lang", metrics.wilson(F.col("k"), F.col("n")).alias("w")).select("lang", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))
