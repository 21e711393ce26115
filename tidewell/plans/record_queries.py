"""Queries over feeds, registries, rounds, metrics tables and statistics of lead, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import evaluation, federated, metrics, protocols
from tidewell.plans.flow_queries import scratch
from tidewell.plans.model_queries import _BAND, _PROB, scored, with_probability
from tidewell.plans.oracle_text import KEYS, SCORED, with_panel
from tidewell.plans.panel_queries import panel
from tidewell.schemas import ENTITY, HOUR
from tidewell.schemas import KEYS as KEY_COLUMNS
from tidewell.sources import registry
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


_S = f"WITH {SCORED}"
_COUNTS = ", g AS (SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM s GROUP BY score), t AS (SELECT sum(pos) AS m, sum(neg) AS n FROM g)"


@query(
    f"""{_S}{_COUNTS}, below AS (SELECT a.score, a.pos, a.neg, sum(CASE WHEN b.score < a.score THEN b.neg WHEN b.score = a.score THEN b.neg / 2 ELSE 0 END) AS under, sum(CASE WHEN b.score > a.score THEN b.pos WHEN b.score = a.score THEN b.pos / 2 ELSE 0 END) AS over FROM g a, g b GROUP BY a.score, a.pos, a.neg),
    r AS (SELECT sum(pos * under) / max(m * n) AS auroc FROM below, t),
    v AS (SELECT max(auroc) AS auroc, sqrt(sum(pos * pow(under / n - auroc, 2)) / max((m - 1) * m) + sum(neg * pow(over / m - auroc, 2)) / max((n - 1) * n)) AS se FROM below, t, r)
    SELECT round(auroc, 6) AS auroc, round(se, 6) AS se, round(auroc - 1.96 * se, 6) AS low, round(auroc + 1.96 * se, 6) AS high FROM v"""
)
def a73_delong(spark, sf_dir) -> DataFrame:
    return metrics.delong(scored(spark, sf_dir))


@query(
    f"""{_S}{_COUNTS}, c AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC))
    SELECT score AS threshold, round((tp * n - fp * m) / (m * n), 6) AS j FROM c, t WHERE tp * n > fp * m ORDER BY tp * n - fp * m DESC, score DESC LIMIT 1"""
)
def a43_youden(spark, sf_dir) -> DataFrame:
    return metrics.youden(scored(spark, sf_dir))


_LEADS = f""", al AS (SELECT patient_id, min(hour_from_admission) AS first_alert FROM pr WHERE probability >= 0.5 GROUP BY patient_id),
ev AS (SELECT DISTINCT patient_id, deterioration_hour AS hour_from_admission FROM full_panel WHERE deterioration_hour >= 0)"""


def _leads(spark, sf_dir) -> DataFrame:
    p = with_probability(spark, sf_dir)
    events = panel(spark, sf_dir).filter("deterioration_hour >= 0").select(ENTITY, F.col("deterioration_hour").alias(HOUR)).distinct()
    return metrics.lead_times(p.withColumn("risk_level", F.when(F.col("probability") >= 0.5, "HIGH").otherwise("LOW")), events, ENTITY, HOUR)


@query(with_panel(f"SELECT {KEYS}, first_alert, hour_from_admission - first_alert AS lead FROM ev LEFT JOIN al USING (patient_id)", _PROB + _LEADS))
def a73_lead_times(spark, sf_dir) -> DataFrame:
    return _leads(spark, sf_dir)


@query(
    with_panel(
        """SELECT a.time, CAST(max(a.at_risk) AS BIGINT) AS at_risk, CAST(max(a.events) AS BIGINT) AS events, round(product(1 - b.events / b.at_risk), 6) AS survival FROM km a JOIN km b ON b.time <= a.time GROUP BY a.time""",
        _PROB
        + _LEADS
        + """, tm AS (SELECT coalesce(first_alert, hour_from_admission) AS time, first_alert IS NOT NULL AS seen FROM ev LEFT JOIN al USING (patient_id)),
        ct AS (SELECT time, count(*) AS n, count_if(seen) AS events FROM tm GROUP BY time), km AS (SELECT time, events, CAST(sum(n) OVER (ORDER BY time DESC) AS DOUBLE) AS at_risk FROM ct)""",
    )
)
def a73_kaplan_meier(spark, sf_dir) -> DataFrame:
    leads = _leads(spark, sf_dir).withColumns({"at": F.coalesce("first_alert", HOUR), "seen": F.col("first_alert").isNotNull()})
    return metrics.kaplan_meier(leads, "at", "seen")


@query(with_panel(f"SELECT {KEYS}, round(e / sum(e) OVER (PARTITION BY patient_id), 6) AS weight FROM (SELECT {KEYS}, exp(hr_dense / 10 - max(hr_dense / 10) OVER (PARTITION BY patient_id)) AS e FROM panel)"))
def w20_attention_weights(spark, sf_dir) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("s", F.col("hr_dense") / 10)
    return metrics.softmax(p, "s", ENTITY).select(*KEY_COLUMNS, F.round("weight", 6).alias("weight"))


_BUCKETS = " UNION ALL ".join(
    [
        *[f"SELECT 'latency_seconds_bucket', 'model=' || gender || ',le={e}', count_if(seconds <= {e}) FROM px GROUP BY gender" for e in (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)],
        *[f"SELECT 'confidence_bucket', 'model=' || gender || ',le={e}', count_if(probability <= {e}) FROM px GROUP BY gender" for e in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)],
        *[f"SELECT '{n}_bucket', 'model=' || gender || ',le=+Inf', count({c}) FROM px GROUP BY gender" for n, c in (("latency_seconds", "seconds"), ("confidence", "probability"))],
        *[f"SELECT '{n}_sum', 'model=' || gender, CAST(sum(CAST({c} AS DECIMAL(28, 9))) AS DOUBLE) FROM px GROUP BY gender" for n, c in (("latency_seconds", "seconds"), ("confidence", "probability"))],
    ]
)


@query(
    with_panel(
        f"SELECT name, labels, round(CAST(value AS DOUBLE), 6) AS value FROM (SELECT 'predictions_total' AS name, 'model=' || gender || ',level=' || {_BAND} AS labels, CAST(count(*) AS DOUBLE) AS value FROM px GROUP BY gender, {_BAND} UNION ALL {_BUCKETS})",
        f"{_PROB}, px AS (SELECT *, (patient_id % 97) / 40.0::DOUBLE AS seconds FROM pr)",
    )
)
def k14_metrics_table(spark, sf_dir) -> DataFrame:
    p = with_probability(spark, sf_dir).withColumn("seconds", (F.col(ENTITY) % 97) / 40.0)
    return evaluation.exposition(p, "probability", "seconds", "gender")


@query(with_panel(f"SELECT {KEYS}, probability FROM pr WHERE {_BAND} = 'HIGH' AND contains(CAST(patient_id AS VARCHAR), '1')", _PROB))
def p27_list_filter(spark, sf_dir) -> DataFrame:
    return evaluation.find(with_probability(spark, sf_dir), "probability", ENTITY, "HIGH", "1").select(*KEY_COLUMNS, "probability")


# The steps of the protocols, in order.
_STEPS = """
('sepsis', 1, 'Measure serum lactate level', 'immediate'),
('sepsis', 2, 'Obtain blood cultures before antibiotics', 'immediate'),
('sepsis', 3, 'Administer broad-spectrum antibiotics', 'immediate'),
('sepsis', 4, 'Begin rapid 30 mL/kg crystalloid if hypotension or lactate ≥ 4', 'immediate'),
('sepsis', 5, 'Apply vasopressors if hypotensive during/after fluid resuscitation (target MAP ≥ 65)', 'urgent'),
('sepsis', 6, 'Reassess volume status and tissue perfusion', '30min'),
('sepsis', 7, 'Re-measure lactate if initial was elevated', '2-4h'),
('respiratory', 1, 'Assess airway patency and breathing pattern', 'immediate'),
('respiratory', 2, 'Apply supplemental O₂ to maintain SpO₂ ≥ 94%', 'immediate'),
('respiratory', 3, 'Obtain ABG and chest X-ray', 'urgent'),
('respiratory', 4, 'Consider non-invasive ventilation (NIV/CPAP)', 'urgent'),
('respiratory', 5, 'Notify attending physician and prepare for intubation if needed', 'urgent'),
('cardiac', 1, 'Obtain 12-lead ECG immediately', 'immediate'),
('cardiac', 2, 'Establish IV access and fluid bolus if hypotensive', 'immediate'),
('cardiac', 3, 'Monitor continuous telemetry', 'urgent'),
('cardiac', 4, 'Administer aspirin + notify cardiology', 'urgent'),
('cardiac', 5, 'Prepare emergency resuscitation cart', 'standby'),
('general', 1, 'Call RRT: Ext. 7777', 'immediate'),
('general', 2, 'Perform ABCDE assessment', 'immediate'),
('general', 3, 'Obtain full set of vitals + labs', 'urgent'),
('general', 4, 'Review medication list for reversible causes', 'urgent'),
('general', 5, 'Prepare for transfer to higher level of care', 'standby')
"""


@query(
    f"""WITH p AS (SELECT * FROM (VALUES {_STEPS}) t(condition, step, action, priority)), e AS (SELECT DISTINCT CASE event_type WHEN 'view' THEN 'sepsis' WHEN 'click' THEN 'cardiac' WHEN 'error' THEN 'respiratory' ELSE event_type END AS asked FROM events)
    SELECT asked, step, action, priority FROM e JOIN p ON p.condition = CASE WHEN asked IN ('sepsis', 'cardiac', 'respiratory') THEN asked ELSE 'general' END"""
)
def p32_protocols(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    asked = F.when(kind == "view", "sepsis").when(kind == "click", "cardiac").when(kind == "error", "respiratory").otherwise(kind)
    return protocols.with_protocol(table(spark, sf_dir, "events").select(asked.alias("asked")).distinct(), "asked").select("asked", "step", "action", "priority")


@query("SELECT user_id % 20 AS run_id, arg_max(value, event_id) FILTER (event_type = 'view') AS view, arg_max(value, event_id) FILTER (event_type = 'click') AS click FROM events GROUP BY 1")
def m14_run_table(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return registry.run_table(e.select((F.col("user_id") % 20).alias("run_id"), F.col("event_type").alias("metric"), F.col("event_id").alias("step"), "value"), ["view", "click"])


_SITES = """WITH ev AS (SELECT user_id % 40 AS site_id, epoch(ts)::DOUBLE AS t, CASE event_type WHEN 'signup' THEN 'register' WHEN 'error' THEN 'unregister' WHEN 'purchase' THEN 'submit' ELSE 'heartbeat' END AS kind, event_id AS dataset_size FROM events),
hi AS (SELECT max(t) AS now FROM ev), st AS (SELECT site_id, max(t) FILTER (kind IN ('register', 'heartbeat')) AS last_heartbeat, max(t) FILTER (kind = 'register') AS i, max(t) FILTER (kind = 'unregister') AS o, count(*) FILTER (kind = 'submit') AS rounds FROM ev GROUP BY site_id)"""


@query(f"{_SITES} SELECT site_id, rounds, last_heartbeat >= now - 36000 AS active FROM st, hi WHERE i IS NOT NULL AND (o IS NULL OR o < i)")
def m13_site_states(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    kinds = F.when(kind == "signup", "register").when(kind == "error", "unregister").when(kind == "purchase", "submit").otherwise("heartbeat")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("site_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), kinds.alias("kind"), F.col("event_id").alias("dataset_size"))
    e = e.withColumn("at", F.col("us") / 1e6)
    now = e.agg(F.max("at")).first()[0] or 0.0
    return federated.site_states(e, now, 36000.0).select("site_id", "rounds", "active")


@query("SELECT CAST(o_orderkey % 50 AS BIGINT) AS idx, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 4) AS value FROM orders GROUP BY 1")
def k18_round_checkpoint(spark, sf_dir) -> DataFrame:
    """A round's averaged parameters, written twice as after a failure, and read back once."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).cast("long").alias("idx"), F.lit("w").alias("param"), F.col("o_totalprice").cast("double").alias("value"), F.col("o_custkey").cast("double").alias("weight"))
    path, cells = scratch(spark, "rounds"), federated.fed_avg(o)
    about = spark.createDataFrame([("weighted", 2)], "strategy string, sites int")
    for _ in range(2):
        registry.save_round(cells, about, path, 1)
    return registry.read_round(spark, path, "cells", 1).select("idx", F.round("value", 4).alias("value"))
