"""Queries over scores, drift, risk, alerts, clinical documents, federation and lifecycle, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import alerts, clinical_docs, drift, federated, lifecycle, metrics, risk
from tidewell.plans.oracle_text import KEYS, SCORED, with_panel
from tidewell.plans.panel_queries import panel, tidy
from tidewell.schemas import ENTITY, HOUR, LOINC, VITALS
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


def scored(spark, sf_dir) -> DataFrame:
    """Labelled documents with a score: a bounded rational function of the text's length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("label")).filter("label is not null")
    return docs.join(marks, "doc_id").withColumn("score", F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 3))


_S = f"WITH {SCORED}"


@query(
    f"""{_S}, c AS (SELECT CAST(count_if(score >= 0.5 AND label = 1) AS BIGINT) AS tp, CAST(count_if(score >= 0.5 AND label = 0) AS BIGINT) AS fp, CAST(count_if(score < 0.5 AND label = 1) AS BIGINT) AS fn, CAST(count_if(score < 0.5 AND label = 0) AS BIGINT) AS tn FROM s)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn / (tn + fp), 6) AS specificity FROM c"""
)
def a38_confusion(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir))


@query(f"{_S} SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc FROM (SELECT score FROM s WHERE label = 1) p, (SELECT score FROM s WHERE label = 0) n")
def a39_auroc(spark, sf_dir):
    return metrics.auroc(scored(spark, sf_dir))


_CURVE = """, g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score),
c AS (SELECT score, CAST(pos AS DOUBLE) AS pos, CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS DOUBLE) AS fp, CAST(sum(pos) OVER () AS DOUBLE) AS p, CAST(sum(neg) OVER () AS DOUBLE) AS n FROM g)"""


@query(f"{_S}{_CURVE} SELECT round(sum(pos / p * tp / (tp + fp)), 6) AS auprc FROM c")
def a40_auprc(spark, sf_dir):
    return metrics.auprc(scored(spark, sf_dir))


@query(f"{_S}{_CURVE} SELECT score, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM c")
def a41_roc_points(spark, sf_dir):
    return metrics.roc_points(scored(spark, sf_dir))


def _grid(low: int, high: int, per: float) -> str:
    return f""", grid AS (SELECT k / {per} AS t FROM range({low}, {high + 1}) r(k)),
q AS (SELECT t, count_if(score >= t AND label = 1) AS tp, count_if(score >= t AND label = 0) AS fp, count_if(score < t AND label = 1) AS fn, count_if(score < t AND label = 0) AS tn FROM grid, s GROUP BY t),
m AS (SELECT t, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, round(coalesce(tp / nullif(tp + fn, 0), 0) - coalesce(fp / nullif(fp + tn, 0), 0), 12) AS yo FROM q)"""


@query(f"{_S}{_grid(10, 90, 100.0)} SELECT round((SELECT t FROM m ORDER BY f1 DESC, t LIMIT 1), 6) AS threshold, round(max(f1), 6) AS f1 FROM m")
def a42_f1_threshold(spark, sf_dir):
    g = metrics.grid_counts(scored(spark, sf_dir), 10, 90, 100.0)
    f1 = F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return g.withColumn("f1", f1).agg(F.round(F.max_by("threshold", F.struct("f1", -F.col("threshold"))), 6).alias("threshold"), F.round(F.max("f1"), 6).alias("f1"))


@query(
    f"""{_S}{_grid(10, 190, 200.0)} SELECT round((SELECT t FROM m ORDER BY f1 DESC, t LIMIT 1), 6) AS f1, round((SELECT t FROM m ORDER BY yo DESC, t LIMIT 1), 6) AS youden,
  round(coalesce((SELECT min(t) FROM m WHERE pr >= 0.9), 0.5), 6) AS precision_90, round(coalesce((SELECT max(t) FROM m WHERE re >= 0.9), 0.5), 6) AS recall_90,
  round(coalesce((SELECT t FROM m WHERE re >= 0.75 ORDER BY f1 DESC, t LIMIT 1), 0.5), 6) AS clinical"""
)
def a44_thresholds(spark, sf_dir):
    return metrics.thresholds(scored(spark, sf_dir))


@query(f"{_S} SELECT round(avg((score - label) * (score - label)), 6) AS brier FROM s")
def a45_brier(spark, sf_dir):
    return metrics.brier(scored(spark, sf_dir))


@query(f"{_S} SELECT round(sum(n * abs(a - b)) / (SELECT count(*) FROM s), 6) AS ece FROM (SELECT count(*) AS n, avg(score) AS a, avg(label) AS b FROM s WHERE score < 1 GROUP BY floor(score * 10))")
def a46_ece(spark, sf_dir):
    return metrics.calibration_error(scored(spark, sf_dir))


@query(
    f"""{_S}, z AS (SELECT label, ln(c / (1 - c)) AS z FROM (SELECT label, least(greatest(score, 1e-7), 1 - 1e-7) AS c FROM s)), t AS (SELECT 0.1 + k / 100.0 AS t FROM range(490) r(k)),
l AS (SELECT t, -avg(label * ln(q) + (1 - label) * ln(1 - q)) AS nll FROM (SELECT CAST(t AS DOUBLE) AS t, label, least(greatest(1 / (1 + exp(-z / t)), 1e-12), 1 - 1e-12) AS q FROM z, t) GROUP BY t)
SELECT round((SELECT t FROM l ORDER BY round(nll, 9), t LIMIT 1), 6) AS temperature, round(min(nll), 6) AS nll FROM l"""
)
def a47_temperature(spark, sf_dir):
    return metrics.temperature(scored(spark, sf_dir))


@query(
    f"""{_S}, b AS (SELECT *, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS size FROM s)
SELECT lang, size, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, CAST(count_if(score >= 0.5 AND label = 1) AS BIGINT) AS tp, CAST(count_if(score >= 0.5 AND label = 0) AS BIGINT) AS fp,
  round(coalesce(count_if(score >= 0.5 AND label = 1) / nullif(sum(label), 0), 0), 6) AS recall, round(coalesce(count_if(score >= 0.5 AND label = 1) / nullif(count_if(score >= 0.5), 0), 0), 6) AS precision FROM b GROUP BY GROUPING SETS ((lang), (size))"""
)
def a72_subgroup_grouping_sets(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("size", F.when(F.col("n_chars") < 1000, "short").otherwise("long"))
    return metrics.subgroups(df, ["lang", "size"])


@query(
    f"""{_S}, c AS (SELECT label AS y, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM s)
SELECT round(avg(-(CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END) * pow(1 - r, 2) * ln(r)), 6) AS focal, round(avg(-((y * 0.9 + 0.05) * ln(p) + (1 - (y * 0.9 + 0.05)) * ln(1 - p))), 6) AS smoothed_bce FROM (SELECT *, CASE WHEN y = 1 THEN p ELSE 1 - p END AS r FROM c)"""
)
def a69_losses(spark, sf_dir):
    return metrics.losses(scored(spark, sf_dir))


def halves(spark, sf_dir, columns):
    p = panel(spark, sf_dir)
    return p.filter(F.col(HOUR) < 36).select(*columns), p.filter(F.col(HOUR) >= 36).select(*columns)


_HALF = {0: "hour_from_admission < 36", 1: "hour_from_admission >= 36"}


@query(
    with_panel(
        "SELECT CAST(b AS INTEGER) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n, round(greatest(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 1e-8), 6) AS share FROM range(10) r(b) LEFT JOIN (SELECT least(floor((hr_dense - lo) / ((hi - lo) / 10)), 9) AS k, count(*) AS n FROM panel, (SELECT min(hr_dense) AS lo, max(hr_dense) AS hi FROM panel) GROUP BY 1) ON k = b"
    )
)
def a48_histogram(spark, sf_dir):
    out = drift.histogram(panel(spark, sf_dir), "hr_dense")
    return out.select("bin", F.col("n").cast("long").alias("n"), F.round("share", 6).alias("share"))


_PSI_COLUMNS = ["hr_dense", "sbp_dense", "lactate"]


def _psi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round(CASE WHEN max(ln) < 50 THEN 0 ELSE sum((l - r) * ln(l / r)) END, 6) AS psi FROM (
  SELECT b, greatest(coalesce(rn, 0) / sum(coalesce(rn, 0)) OVER (), 1e-8) AS r, greatest(coalesce(lv, 0) / sum(coalesce(lv, 0)) OVER (), 1e-8) AS l, sum(coalesce(lv, 0)) OVER () AS ln FROM range(10) x(b) LEFT JOIN (
    SELECT least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS k, count_if({_HALF[0]}) AS rn, count_if({_HALF[1]}) AS lv FROM panel, (SELECT min({c}) AS lo, max({c}) AS hi FROM panel WHERE {_HALF[0]}) WHERE {c} BETWEEN lo AND hi GROUP BY 1) ON k = b)"""


_PSI = " UNION ALL ".join(map(_psi_sql, _PSI_COLUMNS))


@query(with_panel(_PSI))
def a50_psi(spark, sf_dir):
    return drift.psi(*halves(spark, sf_dir, _PSI_COLUMNS), _PSI_COLUMNS)


@query(with_panel(f"SELECT round(max(abs(a - b)), 6) AS ks FROM (SELECT sum(count_if({_HALF[0]})) OVER (ORDER BY hr_dense) / sum(count_if({_HALF[0]})) OVER () AS a, sum(count_if({_HALF[1]})) OVER (ORDER BY hr_dense) / sum(count_if({_HALF[1]})) OVER () AS b FROM panel WHERE hr_dense IS NOT NULL GROUP BY hr_dense)"))
def a51_ks_stat(spark, sf_dir):
    return drift.ks_statistic(*halves(spark, sf_dir, ["hr_dense"]), "hr_dense")


@query(
    with_panel(
        """SELECT feature, psi, CASE WHEN psi > 0.25 THEN 'significant' WHEN psi > 0.2 THEN 'high' WHEN psi > 0.1 THEN 'moderate' ELSE 'none' END AS severity, round(avg(psi) OVER (), 6) AS mean_psi,
  CASE WHEN avg(CAST(psi > 0.2 AS INTEGER)) OVER () > 0.3 THEN 'RETRAIN_RECOMMENDED' WHEN max(psi) OVER () > 0.2 THEN 'MONITOR' ELSE 'STABLE' END AS advice FROM psis""",
        f", psis AS ({_PSI})",
    )
)
def a53_drift_report(spark, sf_dir):
    return drift.report(drift.psi(*halves(spark, sf_dir, _PSI_COLUMNS), _PSI_COLUMNS))


@query(with_panel(f"SELECT round(abs(b - a) / greatest(abs(a), 1e-8), 6) AS shift, n >= 50 AND abs(b - a) / greatest(abs(a), 1e-8) > 0.2 AS drifted FROM (SELECT avg(CASE WHEN {_HALF[0]} THEN lactate END) AS a, avg(CASE WHEN {_HALF[1]} THEN lactate END) AS b, count(CASE WHEN {_HALF[1]} THEN lactate END) AS n FROM panel)"))
def a52_prediction_drift(spark, sf_dir):
    return drift.prediction_drift(*halves(spark, sf_dir, ["lactate"]), "lactate")


#: A probability for each panel row, exact in both engines.
_P = "round((hr_dense - 60) / 60 * 0.5 + coalesce(lactate, 0.5) / 8, 9)"


def with_probability(spark, sf_dir) -> DataFrame:
    p = panel(spark, sf_dir)
    return p.withColumn("probability", F.least(F.greatest(F.round((F.col("hr_dense") - 60) / 60 * 0.5 + F.coalesce("lactate", F.lit(0.5)) / 8, 9), F.lit(0.0)), F.lit(1.0)))


_PROB = f", pr AS (SELECT *, least(greatest({_P}, 0.0), 1.0) AS probability FROM full_panel)"
_BAND = "CASE WHEN probability >= 0.75 THEN 'CRITICAL' WHEN probability >= 0.5 THEN 'HIGH' WHEN probability >= 0.25 THEN 'MODERATE' ELSE 'LOW' END"


@query(with_panel(f"SELECT {KEYS}, probability, {_BAND} AS level, CAST(trunc(probability * 100) AS INTEGER) AS score, CAST(round_even(probability * 100, 0) AS INTEGER) AS rounded_score FROM pr", _PROB))
def p17_risk_band(spark, sf_dir):
    p = F.col("probability")
    return with_probability(spark, sf_dir).select(*KEY_COLUMNS, "probability", risk.band(p).alias("level"), risk.truncated_score(p).alias("score"), risk.rounded_score(p).alias("rounded_score"))


def _if(condition: str, points: float, other: str = "0.0") -> str:
    return f"CASE WHEN {condition} THEN CAST({points} AS DOUBLE) ELSE {other} END"


#: The four rule sets in plain SQL; the panel has no white cells, sepsis risk or oxygen flow.
_OUTCOMES = f""", d1 AS (SELECT *, least(greatest(CAST(0.05 AS DOUBLE) + {_if("heart_rate > 105 OR heart_rate < 50", 0.2)} + {_if("respiratory_rate > 24 OR respiratory_rate < 10", 0.2)} + {_if("spo2_pct < 92", 0.25)}
  + {_if("systolic_bp < 95 OR systolic_bp > 170", 0.15)} + {_if("lactate > 2", 0.15)}, 0.01), 0.99) AS det FROM full_panel),
oc AS (SELECT patient_id, hour_from_admission, CAST(det AS DOUBLE) AS deterioration_next_12h,
  CAST(least(greatest(CAST(0.05 AS DOUBLE) + 0.15 * ({_if("respiratory_rate >= 22", 1)} + {_if("systolic_bp <= 100", 1)} + {_if("mobility_score <= 1", 1)}) / 3.0 + {_if("lactate > 2", 0.15)} + {_if("temperature_c >= 38.3 OR temperature_c <= 36", 0.1)} + {_if("det > 0.6", 0.1)}, 0.01), 0.99) AS DOUBLE) AS sepsis_next_6h,
  CAST(least(greatest(CAST(0.02 AS DOUBLE) + {_if("heart_rate < 40 OR heart_rate > 150", 0.45, _if("heart_rate < 50 OR heart_rate > 130", 0.15))} + {_if("systolic_bp < 75", 0.35, _if("systolic_bp < 90", 0.15))} + {_if("heart_rate / greatest(systolic_bp, 1.0) > 1.2 AND systolic_bp IS NOT NULL", 0.15)} + {_if("det > 0.7", 0.1)}, 0.005), 0.98) AS DOUBLE) AS cardiac_arrest_next_12h,
  CAST(least(greatest(CAST(0.04 AS DOUBLE) + {_if("spo2_pct < 88", 0.5, _if("spo2_pct < 92", 0.25))} + {_if("respiratory_rate >= 28", 0.25, _if("respiratory_rate >= 24", 0.1))}, 0.01), 0.99) AS DOUBLE) AS respiratory_failure_next_12h FROM d1)"""


@query(with_panel(f"SELECT {KEYS}, {', '.join(f'round({n}, 6) AS {n}' for n in risk.OUTCOMES)} FROM oc", _OUTCOMES))
def p19_multi_outcome(spark, sf_dir):
    return tidy(risk.outcome_scores(panel(spark, sf_dir)), list(risk.OUTCOMES))


_POINTS = "round_even(round({0} * 100, 6), 0)"


@query(
    with_panel(
        f"""SELECT {KEYS}, CASE WHEN d >= greatest(s * 1.1, c * 1.2, r) THEN 'deterioration_next_12h' WHEN s * 1.1 >= greatest(c * 1.2, r) THEN 'sepsis_next_6h' WHEN c * 1.2 >= r THEN 'cardiac_arrest_next_12h' ELSE 'respiratory_failure_next_12h' END AS primary_concern
  FROM (SELECT {KEYS}, {_POINTS.format("deterioration_next_12h")} AS d, {_POINTS.format("sepsis_next_6h")} AS s, {_POINTS.format("cardiac_arrest_next_12h")} AS c, {_POINTS.format("respiratory_failure_next_12h")} AS r FROM oc)""",
        _OUTCOMES,
    )
)
def p20_primary_concern(spark, sf_dir):
    scores = risk.outcome_scores(panel(spark, sf_dir))
    scores = scores.withColumns({n: F.round(n, 8) for n in risk.OUTCOMES})  # so that both engines round the same numbers to points
    return risk.primary_concern(scores).select(*KEY_COLUMNS, "primary_concern")


@query(
    with_panel(
        f"""SELECT {KEYS}, CAST((cardiac_arrest_next_12h >= 0.5)::INT + (sepsis_next_6h >= 0.5)::INT + (respiratory_failure_next_12h >= 0.5)::INT + (deterioration_next_12h >= 0.5)::INT AS INTEGER) AS n_alerts,
  CASE WHEN cardiac_arrest_next_12h >= 0.5 THEN 'CARDIAC' WHEN sepsis_next_6h >= 0.5 THEN 'SEPSIS' WHEN respiratory_failure_next_12h >= 0.5 THEN 'RESPIRATORY' WHEN deterioration_next_12h >= 0.5 THEN 'DETERIORATION' ELSE 'All' END AS first_word FROM oc""",
        _OUTCOMES,
    )
)
def p21_alert_texts(spark, sf_dir):
    out = risk.alert_texts(risk.outcome_scores(panel(spark, sf_dir)))
    clear = F.col("alerts")[0] == risk.ALL_CLEAR
    return out.select(*KEY_COLUMNS, F.when(clear, 0).otherwise(F.size("alerts")).alias("n_alerts"), F.split(F.col("alerts")[0], " ")[1].alias("first_word"))


@query(
    with_panel(
        f"""SELECT {KEYS}, round(new_risk, 9) AS new_risk, new_risk - probability < -0.05 AS beneficial FROM (SELECT {KEYS}, probability, least(greatest(probability + coalesce((sbp - 120) * -0.003, 0) + coalesce((80 - heart_rate) * 0.002, 0) + coalesce((1 - lactate) * 0.06, 0) + coalesce((spo2_pct - 97) * 0.015, 0), 0.02), 0.98) AS new_risk
  FROM (SELECT *, systolic_bp AS sbp FROM pr))""",
        _PROB,
    )
)
def p24_what_if(spark, sf_dir):
    goals = {"systolic_bp_new": F.lit(120.0), "heart_rate_new": F.lit(80.0), "lactate_new": F.lit(1.0), "spo2_pct_new": F.lit(97.0)}
    return risk.what_if(with_probability(spark, sf_dir).withColumns(goals), "probability").select(*KEY_COLUMNS, "new_risk", "beneficial")


#: Values moved off the half points, which engines round differently.
_VALUES = ("lactate", "heart_rate", "spo2_pct", "systolic_bp", "respiratory_rate")
_SHIFTED = f", sh AS (SELECT {KEYS}, {', '.join(f'{c} + 0.00013 AS {c}' for c in _VALUES)} FROM panel)"


@query(
    with_panel(
        f"""SELECT {KEYS}, CAST(row_number() OVER (PARTITION BY patient_id, hour_from_admission ORDER BY abs(v) DESC, k) AS INTEGER) AS rank, feature, v AS contribution, direction, round(100 / (1 + exp(1.2 - sum(v) OVER (PARTITION BY patient_id, hour_from_admission))), 1) AS final_probability FROM (
  SELECT {KEYS}, 0 AS k, 'Serum Lactate' AS feature, round((lactate - 1.5) * 0.35, 3) AS v, 'risk' AS direction FROM sh WHERE lactate > 2
  UNION ALL SELECT {KEYS}, 1, 'Heart Rate', round((heart_rate - 80) * 0.012, 3), 'risk' FROM sh WHERE heart_rate > 100
  UNION ALL SELECT {KEYS}, 2, 'SpO₂', round((95 - spo2_pct) * 0.08, 3), 'risk' FROM sh WHERE spo2_pct < 95
  UNION ALL SELECT {KEYS}, 3, 'Systolic BP', round((110 - systolic_bp) * 0.025, 3), 'risk' FROM sh WHERE systolic_bp < 100
  UNION ALL SELECT {KEYS}, 4, 'Respiratory Rate', round((respiratory_rate - 16) * 0.04, 3), 'risk' FROM sh WHERE respiratory_rate > 22
  UNION ALL SELECT {KEYS}, 5, 'SpO₂ (normal)', CAST(-0.15 AS DOUBLE), 'protective' FROM sh WHERE spo2_pct >= 96
  UNION ALL SELECT {KEYS}, 6, 'Systolic BP (stable)', CAST(-0.12 AS DOUBLE), 'protective' FROM sh WHERE systolic_bp >= 110
  UNION ALL SELECT {KEYS}, 7, 'Lactate (normal)', CAST(-0.2 AS DOUBLE), 'protective' FROM sh WHERE lactate <= 1.5)""",
        _SHIFTED,
    )
)
def p25_waterfall(spark, sf_dir):
    shifted = panel(spark, sf_dir).withColumns({c: F.col(c) + 0.00013 for c in _VALUES})
    return risk.waterfall(shifted, KEY_COLUMNS).drop("value")


@query(with_panel("SELECT patient_id, arg_max(probability, hour_from_admission) AS probability FROM pr GROUP BY patient_id HAVING arg_max(probability, hour_from_admission) >= 0.4", _PROB))
def o03_watchlist(spark, sf_dir):
    last = with_probability(spark, sf_dir).groupBy(ENTITY).agg(F.max_by("probability", HOUR).alias("probability"))
    return risk.watchlist(last, "probability", 0.4)


@query(with_panel(f"SELECT level, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MODERATE'), ('LOW')) v(level) LEFT JOIN (SELECT {_BAND} AS level, count(*) AS n FROM pr GROUP BY 1) USING (level)", _PROB))
def a64_risk_distribution(spark, sf_dir):
    return risk.risk_distribution(with_probability(spark, sf_dir), "probability")


_FEATURES = ["f_hr", "f_sbp", "f_lactate"]
_CONTRIB = ", co AS (SELECT patient_id, hour_from_admission, (hr_dense - 90) / 10 AS f_hr, (110 - sbp_dense) / 15 AS f_sbp, lactate - 1 AS f_lactate FROM panel)"


def contributions(spark, sf_dir) -> DataFrame:
    return panel(spark, sf_dir).select(*KEY_COLUMNS, ((F.col("hr_dense") - 90) / 10).alias("f_hr"), ((110 - F.col("sbp_dense")) / 15).alias("f_sbp"), (F.col("lactate") - 1).alias("f_lactate"))


@query(
    with_panel(
        "SELECT feature, round(v, 6) AS importance, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INTEGER) AS rank, round(sum(v) OVER (ORDER BY v DESC, feature) / sum(v) OVER (), 6) AS cumulative_share FROM ("
        + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(abs({f})) AS v FROM co" for f in _FEATURES)
        + ")",
        _CONTRIB,
    )
)
def a67_importance(spark, sf_dir):
    return risk.importance(contributions(spark, sf_dir), _FEATURES)


@query(
    with_panel(
        "SELECT patient_id, hour_from_admission, CAST(rank AS INTEGER) AS rank, feature, round(v, 6) AS contribution, CASE WHEN v > 0 THEN 'up' ELSE 'down' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, hour_from_admission ORDER BY abs(v) DESC, feature) AS rank FROM ("
        + " UNION ALL ".join(f"SELECT patient_id, hour_from_admission, '{f}' AS feature, {f} AS v FROM co" for f in _FEATURES)
        + ") WHERE v IS NOT NULL) WHERE rank <= 2",
        _CONTRIB,
    )
)
def w15_topn_contrib(spark, sf_dir):
    rows = contributions(spark, sf_dir).withColumn("key", F.struct(*KEY_COLUMNS))
    return risk.top_contributions(rows, "key", _FEATURES, 2).select("key.*", "rank", "feature", "contribution", "direction")


def alert_rows(spark, sf_dir) -> DataFrame:
    p = with_probability(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col(HOUR) * 3600))
    return alerts.with_previous(p.select(*KEY_COLUMNS, "ts", "probability"))


_FIRED = f"""{_PROB}, lagged AS (SELECT {KEYS}, probability, lag(probability) OVER (PARTITION BY patient_id ORDER BY hour_from_admission) AS previous FROM pr),
fired AS (SELECT {KEYS}, 'critical_risk' AS rule, 'CRITICAL' AS severity, 60 AS cooldown FROM lagged WHERE probability >= 0.75 UNION ALL SELECT {KEYS}, 'high_risk', 'WARNING', 300 FROM lagged WHERE probability >= 0.5 AND probability < 0.75
  UNION ALL SELECT {KEYS}, 'rapid_increase', 'CRITICAL', 120 FROM lagged WHERE probability - previous > 0.2)"""


@query(with_panel(f"SELECT {KEYS}, probability, previous FROM lagged WHERE probability - previous > 0.2", _FIRED))
def w17_rapid_increase(spark, sf_dir):
    return alert_rows(spark, sf_dir).filter("probability - previous > 0.2").select(*KEY_COLUMNS, "probability", "previous")


@query(with_panel(f"SELECT {KEYS}, rule, severity FROM fired", _FIRED))
def j12_rules(spark, sf_dir):
    return alerts.fired(alert_rows(spark, sf_dir)).select(*KEY_COLUMNS, "rule", "severity")


@query(with_panel("SELECT severity, count(*) AS n FROM fired GROUP BY severity", _FIRED))
def a63_alert_stats(spark, sf_dir):
    return alerts.by_severity(alerts.fired(alert_rows(spark, sf_dir)))


@query(with_panel("SELECT patient_id, hour_from_admission, rule, severity FROM (SELECT * FROM fired ORDER BY hour_from_admission DESC, patient_id, rule LIMIT 40) WHERE severity = 'WARNING'", _FIRED))
def o05_recent_alerts(spark, sf_dir):
    return alerts.recent(alerts.fired(alert_rows(spark, sf_dir)), 40, "WARNING").select(*KEY_COLUMNS, "rule", "severity")


@query(
    f"""WITH RECURSIVE {with_panel("", _FIRED)[5:]}, one AS (SELECT rule, hour_from_admission * 3600 AS t, min(patient_id) AS patient_id FROM fired GROUP BY ALL),
r AS (SELECT rule, min(t) AS t FROM one GROUP BY rule UNION ALL SELECT r.rule, (SELECT min(o.t) FROM one o WHERE o.rule = r.rule AND o.t >= r.t + 7200) FROM r WHERE r.t IS NOT NULL)
SELECT r.rule, o.patient_id, CAST(r.t // 3600 AS BIGINT) AS hour FROM r JOIN one o ON o.rule = r.rule AND o.t = r.t"""
)
def w19_cooldown(spark, sf_dir):
    rows = alerts.fired(alert_rows(spark, sf_dir)).withColumn("cooldown", F.lit(7200))
    return alerts.cool_down(rows).select("rule", ENTITY, F.floor(F.unix_timestamp("ts") / 3600).alias("hour"))


_MESSAGE_FIELDS = [c for c in VITALS]
_CODES = {v: k for k, v in LOINC.items()}


def messages(spark, sf_dir) -> DataFrame:
    """An observation message for each panel row; a signal without value is sent as text."""
    p = panel(spark, sf_dir)
    obx = [F.concat_ws("|", F.lit("OBX"), F.lit(str(k)), F.lit("NM"), F.concat(F.lit(_CODES[c]), F.lit(f"^{c}^LN")), F.lit(""), F.coalesce(F.round(c, 3).cast("string"), F.lit("pending"))) for k, c in enumerate(_MESSAGE_FIELDS, 1)]
    control = F.concat_ws("-", ENTITY, HOUR)
    head = F.concat(F.lit(r"MSH|^~\&|MON|ICU|EHR|HOSP|20240101||ORU^R01|"), control, F.lit("|P|2.5"))
    pid = F.concat(F.lit("PID|1||"), ENTITY, F.lit("^^^H||DOE^J||19700515|"), "gender")
    return p.select(F.concat_ws("\r", head, pid, *obx).alias("message"))


@query(with_panel(f"SELECT concat_ws('-', patient_id, hour_from_admission) AS control_id, 'ORU^R01' AS message_type, CAST(patient_id AS VARCHAR) AS mrn, gender, '1970-05-15' AS birth_date, 6 AS n_obx, CAST({' + '.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in _MESSAGE_FIELDS)} AS INTEGER) AS n_numeric, 'AA' AS ack FROM full_panel"))
def x01_hl7_parse(spark, sf_dir):
    parsed = clinical_docs.acknowledgement(clinical_docs.parse_hl7(messages(spark, sf_dir)))
    return parsed.select("control_id", "message_type", "mrn", "gender", F.col("birth_date").cast("string").alias("birth_date"), F.size("obx").alias("n_obx"), F.size(F.filter("obx", lambda o: o["number"].isNotNull())).alias("n_numeric"), "ack")


@query(with_panel(f"SELECT concat_ws('-', patient_id, hour_from_admission) AS control_id, {', '.join(f'round({c}, 3) AS {c}' for c in _MESSAGE_FIELDS)} FROM full_panel WHERE {' OR '.join(f'{c} IS NOT NULL' for c in _MESSAGE_FIELDS)}"))
def x03_hl7_pivot(spark, sf_dir):
    return clinical_docs.pivot_hl7(clinical_docs.parse_hl7(messages(spark, sf_dir)), complete=False)


@query(with_panel("SELECT CAST(patient_id AS VARCHAR) AS patient_id, round(arg_max(heart_rate, hour_from_admission), 3) AS heart_rate, round(arg_max(systolic_bp, hour_from_admission), 3) AS systolic_bp, round(arg_max(diastolic_bp, hour_from_admission), 3) AS diastolic_bp FROM full_panel WHERE heart_rate IS NOT NULL OR systolic_bp IS NOT NULL GROUP BY patient_id"))
def x04_fhir_pivot(spark, sf_dir):
    p = panel(spark, sf_dir)
    coding = lambda c: F.struct(F.array(F.struct(F.lit("http://loinc.org").alias("system"), F.lit(_CODES.get(c, c)).alias("code"))).alias("coding"))
    value = lambda c: F.struct(F.round(c, 3).alias("value"))
    order = F.lpad(F.col(HOUR).cast("string"), 3, "0")
    subject = F.struct(F.concat(F.lit("Patient/"), ENTITY).alias("reference"))
    hr = F.struct(F.lit("Observation").alias("resourceType"), F.concat(F.lit("h"), order).alias("id"), subject.alias("subject"), coding("heart_rate").alias("code"), value("heart_rate").alias("valueQuantity"))
    parts = F.array(*[F.struct(coding(c).alias("code"), value(c).alias("valueQuantity")) for c in ("systolic_bp", "diastolic_bp")])
    bp = F.struct(F.lit("Observation").alias("resourceType"), F.concat(F.lit("b"), order).alias("id"), subject.alias("subject"), coding("85354-9").alias("code"), parts.alias("component"))
    other = F.struct(F.lit("Patient").alias("resourceType"), F.lit("x").alias("id"))
    text = lambda r: F.concat(F.lit('{"resource":'), F.to_json(r), F.lit("}"))
    bundles = p.select(F.concat(F.lit('{"resourceType":"Bundle","entry":['), F.concat_ws(",", text(hr), text(bp), text(other)), F.lit("]}")).alias("bundle"))
    return clinical_docs.pivot_fhir(clinical_docs.observations(bundles), ["heart_rate", "systolic_bp", "diastolic_bp"]).filter("heart_rate is not null or systolic_bp is not null")


@query("SELECT user_id, event_id, CAST(CASE WHEN strftime(ts, '%m%d') < strftime(b, '%m%d') THEN year(ts) - year(b) - 1 ELSE year(ts) - year(b) END AS INTEGER) AS age FROM (SELECT user_id, event_id, ts, CAST(DATE '1950-01-10' + CAST(event_id * 7 % 25000 AS INTEGER) AS DATE) AS b FROM events)")
def x07_age_years(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("b", F.date_add(F.lit("1950-01-10").cast("date"), (F.col("event_id") * 7 % 25000).cast("int")))
    return e.select("user_id", "event_id", clinical_docs.age_years(F.col("b"), F.col("ts")).alias("age"))


_CELLS = """cells AS (SELECT vec_id % 10 AS site, CASE WHEN label % 3 = 0 THEN 'bn_' ELSE 'w_' END || label AS param, unnest(range(len(embedding))) AS idx, CAST(unnest(embedding) AS DOUBLE) AS value, CAST(vec_id % 10 + 1 AS DOUBLE) AS weight FROM embeddings)"""


def cells(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("site"), F.concat(F.when(F.col("label") % 3 == 0, "bn_").otherwise("w_"), F.col("label")).alias("param"), F.col("embedding").cast("array<double>").alias("v"))
    return federated.long_table(v, "site", "param", "v", (F.col("site") + 1).cast("double"))


@query(f"WITH {_CELLS} SELECT param, CAST(idx AS INTEGER) AS idx, round(sum(weight * value) / sum(weight), 6) + 0.0 AS value FROM cells GROUP BY ALL")
def a57_fedavg(spark, sf_dir):
    return federated.fed_avg(cells(spark, sf_dir)).select("param", "idx", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query(f"WITH {_CELLS}, o AS (SELECT param, idx, site, avg(value) AS value, avg(weight) AS weight FROM cells GROUP BY ALL) SELECT param, CAST(idx AS INTEGER) AS idx, round(CASE WHEN param LIKE 'bn%' THEN arg_min(value, site) ELSE sum(weight * value) / sum(weight) END, 6) + 0.0 AS value FROM o GROUP BY param, idx")
def a59_fedbn(spark, sf_dir):
    one = cells(spark, sf_dir).groupBy("param", "idx", "site").agg(F.avg("value").alias("value"), F.avg("weight").alias("weight"))
    return federated.fed_bn(one).select("param", "idx", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))) * least(1.0, 0.5 / sqrt(list_sum(list_transform(v, lambda x: x * x)))), 6) AS norm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def m11_clip_norm(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return federated.clip_norm(v, "v", 0.5).select("vec_id", F.round(norm, 6).alias("norm"))


@query(
    """WITH o AS (SELECT 1 + j / 10 AS alpha FROM range(1, 100) x(j) UNION ALL SELECT j FROM range(12, 64) x(j)),
m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS k, count(DISTINCT o_custkey) / (SELECT count(*) FROM customer) AS q, count(*) AS steps FROM orders GROUP BY 1),
a AS (SELECT k - (SELECT min(k) FROM m) + 1 AS round, alpha, CASE WHEN q >= 1 THEN 1 ELSE q * q END * alpha / (2 * 40.0 * 40.0) * steps AS s FROM m, o)
SELECT round, round(min(e), 6) AS epsilon FROM (SELECT round, CAST(sum(s) OVER (PARTITION BY alpha ORDER BY round) AS DOUBLE) + ln(1e5) / (alpha - 1) AS e FROM a) GROUP BY round"""
)
def a61_rdp_epsilon(spark, sf_dir):
    """A round for each month of orders: who takes part is drawn from all customers, an order is a step."""
    orders, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    months = orders.groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("k")).agg(F.countDistinct("o_custkey").alias("some"), F.count("*").alias("steps"))
    first = months.agg(F.min("k").alias("first"))
    rounds = months.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(n))  # one row each
    return federated.rdp_epsilon(rounds.select((F.col("k") - F.col("first") + 1).alias("round"), (F.col("some") / F.col("n")).alias("q"), F.lit(40.0).alias("sigma"), "steps"))


@query("SELECT CAST(i AS INTEGER) AS idx, 0.0 AS total, CAST((SELECT count(DISTINCT c_nationkey) FROM customer) AS INTEGER) AS sites FROM range(4) r(i)")
def a62_masks_cancel(spark, sf_dir):
    sites = table(spark, sf_dir, "customer").select(F.concat(F.lit("nation"), "c_nationkey").alias("site")).distinct()
    return federated.pair_masks(sites, 4).groupBy("idx").agg((F.round(F.sum("mask"), 9) + F.lit(0.0)).alias("total"), F.count("*").cast("int").alias("sites"))


@query(
    """SELECT c_custkey, CASE WHEN n < 1000 THEN 'INSUFFICIENT_DATA' WHEN g >= 0.005 AND h >= 0 THEN 'PROMOTE' ELSE 'REJECT' END AS decision FROM (SELECT c_custkey, c_custkey * 37 % 2000 AS n, round(0.9 + c_custkey % 13 / 1000.0 - 0.9, 9) AS g, round(0.7 + c_custkey % 7 / 1000.0 - 0.702, 9) AS h FROM customer)"""
)
def a56_promotion(spark, sf_dir):
    c = F.col("c_custkey")
    pairs = table(spark, sf_dir, "customer").select(c, (c * 37 % 2000).alias("n"), F.lit(0.9).alias("champion_auroc"), (0.9 + c % 13 / 1000.0).alias("challenger_auroc"), F.lit(0.702).alias("champion_auprc"), (0.7 + c % 7 / 1000.0).alias("challenger_auprc"))
    return lifecycle.decide_promotion(pairs).select("c_custkey", "decision")


@query(
    """WITH v AS (SELECT n_nationkey AS version_id, n_nationkey % 3 <> 0 AS retired, n_nationkey * 7 % 25 AS created_at FROM nation), x AS (SELECT *, row_number() OVER (PARTITION BY retired ORDER BY created_at, version_id) AS a, greatest(count(*) OVER () - 10, 0) AS e FROM v)
SELECT version_id, retired FROM x WHERE NOT retired OR a > e"""
)
def o09_prune_versions(spark, sf_dir):
    n = F.col("n_nationkey")
    registry = table(spark, sf_dir, "nation").select(n.alias("version_id"), (n % 3 != 0).alias("retired"), (n * 7 % 25).alias("created_at"))
    return lifecycle.prune(registry).select("version_id", "retired")


@query("SELECT o_orderkey, o_custkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 1 END, CASE WHEN c_custkey IS NOT NULL THEN CAST(c_nationkey % 2 AS INTEGER) END) AS actual_outcome FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def j10_outcome_backfill(spark, sf_dir):
    open_rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, 1).alias("actual_outcome"))
    outcomes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 2).cast("int").alias("outcome"))
    return lifecycle.backfill_outcomes(open_rows, outcomes, "o_custkey")


@query("SELECT o_custkey, o_orderkey, round(avg(o_totalprice) OVER w, 6) AS mean_12, round(max(o_totalprice) OVER w, 2) AS max_12, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def w01_order_windows(spark, sf_dir):
    """The trailing frame on a larger table: one shuffle by customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    f = w.rowsBetween(-11, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.avg("o_totalprice").over(f), 6).alias("mean_12"), F.round(F.max("o_totalprice").over(f), 2).alias("max_12"), F.row_number().over(w).cast("long").alias("n"))



