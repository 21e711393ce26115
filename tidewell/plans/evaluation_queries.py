"""Queries over padded windows, row checks, grouped evaluation and summaries, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import evaluation, features, labels, quality
from tidewell.plans.model_queries import _PROB, scored, with_probability
from tidewell.plans.oracle_text import KEYS, SCORED, W12, with_panel
from tidewell.plans.panel_queries import _LABEL, panel, tidy
from tidewell.schemas import ENTITY, HOUR
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


# padded windows over a panel without gaps

_FILL = {"heart_rate": "hr_dense", "systolic_bp": "sbp_dense", "respiratory_rate": "18.0", "spo2_pct": "96.0", "temperature_c": "37.0", "diastolic_bp": "75.0", "lactate": "1.5"}


def dense(spark, sf_dir) -> DataFrame:
    return panel(spark, sf_dir).withColumns({c: F.expr(f"coalesce({c}, {x})") for c, x in _FILL.items()})


def _padded(*columns: str) -> str:
    """Lists of twelve values, filled up on the left with the first."""
    lists = ", ".join(f"list(CAST({c} AS DOUBLE)) OVER {W12} AS l_{c}" for c in columns)
    filled = ", ".join(f"list_concat(list_transform(range(12 - len(l_{c})), lambda i: l_{c}[1]), l_{c}) AS {c}" for c in columns)
    fill = ", ".join(f"coalesce({c}, {x}) AS {c}" for c, x in _FILL.items())
    return f", dn AS (SELECT * REPLACE ({fill}) FROM full_panel), pl AS (SELECT {KEYS}, {lists} FROM dn), pw AS (SELECT {KEYS}, {filled} FROM pl)"


_DIFF = "list_transform(range(2, 13), lambda i: heart_rate[i] - heart_rate[i - 1])"


@query(
    with_panel(
        f"""SELECT {KEYS}, round(list_sum(list_transform(range(1, 13), lambda i: (i - 6.5) * heart_rate[i])) / (143.0 + 1e-8), 5) + 0.0 AS heart_rate_slope, round(heart_rate[12] - heart_rate[1], 5) + 0.0 AS heart_rate_delta,
  round((heart_rate[12] - heart_rate[1]) / 11, 5) + 0.0 AS heart_rate_roc, round(((heart_rate[12] - heart_rate[11]) - (heart_rate[2] - heart_rate[1])) / 10, 5) + 0.0 AS heart_rate_accel FROM pw""",
        _padded("heart_rate"),
    )
)
def a09_a13_padded_trend(spark, sf_dir):
    return tidy(features.padded_trends(dense(spark, sf_dir), ["heart_rate"]), [f"heart_rate_{k}" for k in ("slope", "delta", "roc", "accel")], digits=5)


_MAP = "list_transform(range(1, 13), lambda i: diastolic_bp[i] + (systolic_bp[i] - diastolic_bp[i]) / 3)"
_SHOCK = "list_transform(range(1, 13), lambda i: heart_rate[i] / greatest(systolic_bp[i], 1.0))"
_SIGNS = "list_transform(range(1, 13), lambda i: CAST(respiratory_rate[i] >= 22 AS INTEGER) + CAST(systolic_bp[i] <= 100 AS INTEGER))"
_REACH = "list_max({0}) - list_min({0})"
_CLINICAL = {
    "hrv_sdnn": "list_stddev_samp(heart_rate)", "hrv_rmssd": f"sqrt(list_avg(list_transform({_DIFF}, lambda x: x * x)) + 1e-8)", "hrv_range": _REACH.format("heart_rate"),
    "hrv_cv": "list_stddev_samp(heart_rate) / greatest(list_avg(heart_rate), 1e-8)", "bpv_sbp_std": "list_stddev_samp(systolic_bp)", "bpv_sbp_cv": "list_stddev_samp(systolic_bp) / greatest(list_avg(systolic_bp), 1e-8)",
    "bpv_sbp_range": _REACH.format("systolic_bp"), "bpv_dbp_std": "list_stddev_samp(diastolic_bp)", "bpv_dbp_range": _REACH.format("diastolic_bp"), "spo2_var_std": "list_stddev_samp(spo2_pct)",
    "spo2_var_range": _REACH.format("spo2_pct"), "spo2_below_90_ratio": "list_avg(list_transform(spo2_pct, lambda x: CAST(x < 90 AS DOUBLE)))", "temp_var_std": "list_stddev_samp(temperature_c)",
    "temp_var_range": _REACH.format("temperature_c"), "temp_above_38": "list_avg(list_transform(temperature_c, lambda x: CAST(x > 38 AS DOUBLE)))", "map_current": f"{_MAP}[12]", "map_mean": f"list_avg({_MAP})",
    "map_min": f"list_min({_MAP})", "shock_index_current": f"{_SHOCK}[12]", "shock_index_mean": f"list_avg({_SHOCK})", "shock_index_max": f"list_max({_SHOCK})", "qsofa_score": f"{_SIGNS}[12]",
    "qsofa_ge2": f"CAST({_SIGNS}[12] >= 2 AS INTEGER)", "qsofa_ge2_hours": f"len(list_filter({_SIGNS}, lambda x: x >= 2))", "lactate_elevated": "CAST(lactate[12] > 2 AS INTEGER)", "lactate_max_window": "list_max(lactate)",
    "nurse_alert_count": "list_sum(nurse_alert)", "nurse_alert_ratio": "list_avg(nurse_alert)",
}


@query(with_panel(f"SELECT {KEYS}, {', '.join(f'round(CAST({x} AS DOUBLE), 7) + 0.0 AS {n}' for n, x in _CLINICAL.items())} FROM pw", _padded("heart_rate", "respiratory_rate", "spo2_pct", "temperature_c", "systolic_bp", "diastolic_bp", "lactate", "nurse_alert")))
def a14_a21_padded_clinical(spark, sf_dir):
    out = features.padded_clinical(dense(spark, sf_dir))
    return tidy(out.select(*KEY_COLUMNS, *[F.col(c).cast("double").alias(c) for c in _CLINICAL]), list(_CLINICAL), digits=7)


_EXPANDED = ["heart_rate_mean", "heart_rate_std", "lactate_latest", "map_current", "shock_index_max", "qsofa_score", "lactate_elevated", "map_mean"]


@query(
    with_panel(
        f"""SELECT {KEYS}, round(coalesce(heart_rate, 0), 5) AS heart_rate_mean, 0.0 AS heart_rate_std, round(coalesce(lactate, 0), 5) AS lactate_latest, round((coalesce(systolic_bp, 0) + 2 * coalesce(diastolic_bp, 0)) / 3, 5) AS map_current,
  0.0 AS map_mean, CAST(coalesce(lactate > 2, false) AS INTEGER) AS lactate_elevated, CAST(coalesce(respiratory_rate, 0) >= 22 AS INTEGER) + CAST(coalesce(systolic_bp, 0) <= 100 AS INTEGER) AS qsofa_score, 0.0 AS shock_index_max FROM full_panel"""
    )
)
def p22_expand_single(spark, sf_dir):
    return tidy(features.expand_single(panel(spark, sf_dir), _EXPANDED, ["heart_rate", "lactate"]), _EXPANDED, digits=5)


# checks of rows


@query("SELECT 'heart_rate' AS column_name, count_if(event_type IS NOT NULL AND try_cast(event_type AS DOUBLE) IS NULL) AS errors FROM events UNION ALL SELECT 'lactate', count_if(CAST(value AS VARCHAR) IS NOT NULL AND try_cast(CAST(value AS VARCHAR) AS DOUBLE) IS NULL) FROM events")
def p03_type_errors(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.col("event_type").alias("heart_rate"), F.col("value").cast("string").alias("lactate"))
    return quality.type_errors(raw)


_STRICT = {"heart_rate": (20, 300), "respiratory_rate": (4, 60), "spo2_pct": (50, 100), "temperature_c": (30, 45), "systolic_bp": (40, 300), "diastolic_bp": (20, 200)}


@query(
    with_panel(
        f"""SELECT {KEYS}, array_to_string(list_filter([CASE WHEN patient_id < 1 THEN 'patient_id' END, CASE WHEN NOT hour_from_admission BETWEEN 0 AND 72 THEN 'hour_from_admission' END, {", ".join(f"CASE WHEN coalesce(NOT {c} BETWEEN {a} AND {z}, true) THEN '{c}' END" for c, (a, z) in _STRICT.items())},
  CASE WHEN NOT mobility_score BETWEEN 0 AND 4 THEN 'mobility_score' END, CASE WHEN NOT nurse_alert BETWEEN 0 AND 1 THEN 'nurse_alert' END], lambda x: x IS NOT NULL), ',') AS reasons FROM full_panel"""
    )
)
def p08_strict_rejects(spark, sf_dir):
    return quality.strict_rejects(panel(spark, sf_dir)).select(*KEY_COLUMNS, F.array_join("reject_reasons", ",").alias("reasons"))


@query(with_panel(f"SELECT {KEYS}, CAST(heart_rate AS INTEGER) AS target FROM (SELECT {KEYS}, floor(heart_rate) AS heart_rate FROM panel) WHERE heart_rate IS NOT NULL"))
def p10_with_target(spark, sf_dir):
    return quality.with_target(panel(spark, sf_dir).select(*KEY_COLUMNS, F.floor("heart_rate").alias("target")), "target")


@query(with_panel("""SELECT concat('{"patient_id":', patient_id, CASE WHEN hour IS NOT NULL THEN concat(',"hour":', hour) ELSE '' END, ',"gender":"', gender, '"}') AS record FROM (SELECT *, CASE WHEN hour_from_admission % 2 = 0 THEN hour_from_admission END AS hour FROM full_panel)"""))
def p16_records(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("hour", F.when(F.col(HOUR) % 2 == 0, F.col(HOUR)))
    return rows.select(quality.as_record(ENTITY, "hour", "gender").alias("record"))


# evaluation

_PAIRS = {"quality": ("score", "label"), "toxic": ("other", "toxic")}


def two_outcomes(spark, sf_dir) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    return scored(spark, sf_dir).join(marks, "doc_id").withColumn("other", F.round(F.col("doc_id") % 97 / 97.0, 3))


_TWO = f"""WITH {SCORED}, t AS (SELECT s.*, CAST(l.toxic AS BIGINT) AS toxic, round(s.doc_id % 97 / 97.0, 3) AS other FROM s JOIN labels l USING (doc_id)),
u AS (SELECT 'quality' AS outcome, CAST(score AS DOUBLE) AS score, label FROM t WHERE score IS NOT NULL UNION ALL SELECT 'toxic', CAST(other AS DOUBLE), toxic FROM t WHERE toxic IS NOT NULL)"""
_GROUPED = """, g AS (SELECT {k}, score, sum(label) AS pos, sum(1 - label) AS neg FROM u GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER (PARTITION BY {k} ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY {k} ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY {k}) AS p, sum(neg) OVER (PARTITION BY {k}) AS n FROM g),
m AS (SELECT {k}, CAST(max(p + n) AS BIGINT) AS n, CAST(max(p) AS BIGINT) AS positives, coalesce(sum(pos * (n - fp + neg / 2)) / nullif(max(p) * max(n), 0), 0) AS auroc, sum(pos / p * tp / (tp + fp)) AS auprc,
  coalesce(sum(CASE WHEN score >= 0.5 THEN pos ELSE 0 END) / nullif(max(p), 0), 0) AS recall, coalesce(sum(CASE WHEN score < 0.5 THEN neg ELSE 0 END) / nullif(max(n), 0), 0) AS specificity FROM w GROUP BY {k} HAVING max(p) > 0)"""


@query(f"{_TWO}{_GROUPED.format(k='outcome')} SELECT outcome, n, positives, {', '.join(f'round({c}, 6) AS {c}' for c in ('auroc', 'auprc', 'recall', 'specificity'))} FROM m")
def a71_per_outcome(spark, sf_dir):
    return evaluation.by_group(evaluation.stacked(two_outcomes(spark, sf_dir), _PAIRS), "outcome")


@query(
    f"""WITH {SCORED}, u AS (SELECT 'champion' AS outcome, CAST(score AS DOUBLE) AS score, label FROM s UNION ALL SELECT 'challenger', CAST(round(doc_id % 97 / 97.0, 3) AS DOUBLE), label FROM s){_GROUPED.format(k='outcome')}
SELECT a.n AS labelled, round(a.auroc, 6) AS champion_auroc, round(a.auprc, 6) AS champion_auprc, round(b.auroc, 6) AS challenger_auroc, round(b.auprc, 6) AS challenger_auprc, round(b.auroc - a.auroc, 5) + 0.0 AS auroc_delta, round(b.auprc - a.auprc, 5) + 0.0 AS auprc_delta FROM m a JOIN m b ON a.outcome = 'champion' AND b.outcome = 'challenger'"""
)
def a55_shadow_metrics(spark, sf_dir):
    pairs = evaluation.paired_predictions(scored(spark, sf_dir), F.col("score"), F.round(F.col("doc_id") % 97 / 97.0, 3))
    out = evaluation.shadow_metrics(pairs, "champion_prob", "challenger_prob", "label")
    names = [f"{m}_{c}" for m in ("champion", "challenger") for c in ("auroc", "auprc")]
    return out.select("labelled", *[F.round(c, 6).alias(c) for c in names], *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("auroc_delta", "auprc_delta")])


@query(
    f"""{_TWO}, x AS (SELECT outcome, score * 4 - 2 AS x, label FROM u), y AS (SELECT outcome, greatest(count(*) - greatest(sum(label), 1), 1) / greatest(sum(label), 1) AS w FROM x GROUP BY outcome)
SELECT outcome, round(least(max(w), 20), 6) AS pos_weight, round(max(CASE WHEN outcome = 'toxic' THEN 0.5 ELSE 1.0 END) * avg(CASE WHEN label = 1 THEN least(w, 20) * ln(1 + exp(-x)) ELSE ln(1 + exp(x)) END), 6) AS loss FROM x JOIN y USING (outcome) GROUP BY outcome"""
)
def a70_multi_task_loss(spark, sf_dir):
    rows = evaluation.stacked(two_outcomes(spark, sf_dir), _PAIRS).withColumn("score", F.col("score") * 4 - 2)
    return evaluation.multi_task_loss(rows, {"quality": 1.0, "toxic": 0.5})


@query(with_panel(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.75), 6) AS q75 FROM panel" for c in ("hr_dense", "lactate"))))
def a49_reference_stats(spark, sf_dir):
    return evaluation.reference_stats(panel(spark, sf_dir), ["hr_dense", "lactate"])


@query("SELECT event_type, round(sum(value * (user_id % 7)) / sum(user_id % 7), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY event_type")
def a60_weighted_metric(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value", (F.col("user_id") % 7).alias("size"))
    return evaluation.weighted_metric(rows, "event_type", "value", "size")


@query(with_panel("SELECT count_if(probability >= 0.75) AS critical, count_if(probability >= 0.5 AND probability < 0.75) AS high, count(*) AS total FROM pr", _PROB))
def a65_watchlist_counts(spark, sf_dir):
    return evaluation.watchlist_counts(with_probability(spark, sf_dir), "probability")


@query(with_panel("SELECT count(*) AS total, count_if(probability >= 0.5) AS high_risk, round(avg(hour_from_admission), 2) AS mean_ms FROM pr", _PROB))
def a66_batch_summary(spark, sf_dir):
    return evaluation.batch_summary(with_probability(spark, sf_dir), "probability", HOUR)


@query(with_panel("SELECT gender, le, count_if(probability <= le) AS n FROM pr, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, CAST('inf' AS DOUBLE)]) AS le) GROUP BY gender, le", _PROB))
def a74_bucket_counts(spark, sf_dir):
    return evaluation.bucket_counts(with_probability(spark, sf_dir), "probability", evaluation.CONFIDENCE_BUCKETS, "gender")


@query(with_panel(f"SELECT {KEYS}, hr_dense FROM (SELECT {KEYS}, round(hr_dense, 6) AS hr_dense FROM panel) ORDER BY hour_from_admission DESC, patient_id LIMIT 500"))
def w16_most_recent(spark, sf_dir):
    rows = panel(spark, sf_dir).select(*KEY_COLUMNS, F.round("hr_dense", 6).alias("hr_dense"))
    return evaluation.most_recent(rows, 500, HOUR, ENTITY)


@query(with_panel(f"SELECT {KEYS}, CASE WHEN d > 0.01 THEN '↑' WHEN d < -0.01 THEN '↓' ELSE '→' END AS trend FROM (SELECT {KEYS}, probability - lag(probability) OVER (PARTITION BY patient_id ORDER BY hour_from_admission) AS d FROM pr)", _PROB))
def w18_trend_symbol(spark, sf_dir):
    return evaluation.with_trend(with_probability(spark, sf_dir), "probability").select(*KEY_COLUMNS, "trend")


@query(with_panel(f"SELECT {KEYS}, probability FROM pr ORDER BY probability DESC, patient_id, hour_from_admission LIMIT 1", _PROB))
def o07_highest_risk(spark, sf_dir):
    return evaluation.highest(with_probability(spark, sf_dir).select(*KEY_COLUMNS, "probability"), "probability", *KEY_COLUMNS)


@query("SELECT user_id, round(avg(value), 6) AS auroc FROM events GROUP BY user_id ORDER BY auroc DESC, user_id LIMIT 1")
def o10_best_run(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("auroc"))
    return evaluation.best_run(runs, "auroc", True, "user_id")


@query(with_panel("SELECT patient_id, round(arg_min(heart_rate, hour_from_admission) FILTER (WHERE heart_rate IS NOT NULL), 6) AS heart_rate, arg_min(gender, hour_from_admission) AS gender FROM full_panel GROUP BY patient_id"))
def a36_first_statics(spark, sf_dir):
    out = evaluation.first_statics(panel(spark, sf_dir), ["heart_rate", "gender"])
    return out.select(ENTITY, F.round("heart_rate", 6).alias("heart_rate"), "gender")


@query(with_panel("SELECT DISTINCT p.patient_id, p.patient_id % 5 AS physician_id, d.device FROM (SELECT patient_id FROM full_panel WHERE deterioration_hour >= 0) p JOIN (SELECT DISTINCT user_id % 5 AS physician_id, event_type AS device FROM events) d ON d.physician_id = p.patient_id % 5 WHERE d.device <> 'error'"))
def j11_device_fan_out(spark, sf_dir):
    p = panel(spark, sf_dir)
    alerts = p.filter(F.col("deterioration_hour") >= 0).select(ENTITY).distinct()
    carers = p.select(ENTITY, (F.col(ENTITY) % 5).alias("physician_id")).distinct()
    events = table(spark, sf_dir, "events").select((F.col("user_id").cast("long") % 5).alias("physician_id"), F.col("event_type").alias("device")).distinct()
    return evaluation.to_devices(alerts, carers, events.withColumn("active", F.col("device") != "error")).select(ENTITY, "physician_id", "device")


@query("SELECT CAST(event_id AS BIGINT) AS id, event_type FROM events WHERE event_id % 10 = 0 UNION ALL SELECT CAST(event_id AS BIGINT), 'recent' FROM events WHERE event_id % 15 = 0 AND event_id % 10 <> 0")
def u04_with_context(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("id"), "event_type")
    recent = rows.filter("id % 15 = 0").select("id", F.lit("recent").alias("event_type"))
    return evaluation.with_context(rows.filter("id % 10 = 0"), recent)


@query(
    with_panel(
        f"SELECT {KEYS}, " + ", ".join(f'round(heart_rate[{12 - k}], 5) AS "hr_t-{k}"' for k in (2, 1)) + f", CAST(y AS INTEGER) AS target FROM pw JOIN (SELECT patient_id AS i, hour_from_admission AS h, {_LABEL.format(h=12)} AS y FROM full_panel) ON i = patient_id AND h = hour_from_admission",
        _padded("heart_rate"),
    )
)
def w05_tabular(spark, sf_dir):
    """Flattened padded windows with their target, rows without one left out: one shuffle by entity."""
    rows = labels.deterioration(dense(spark, sf_dir), (12,)).withColumnRenamed("deterioration_next_12h", "target")
    flat = features.flattened(quality.with_target(rows, "target"), ["heart_rate"], 3)
    return flat.select(*KEY_COLUMNS, *[F.round(f"`heart_rate_t-{k}`", 5).alias(f"hr_t-{k}") for k in (2, 1)], "target")
