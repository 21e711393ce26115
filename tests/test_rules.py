"""Scores, alerts and checks on small fixtures with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.operators import alerts, drift, evaluation, features, federated, labels, quality, risk
from tidewell.schemas import ENTITY, HOUR

SEPTIC = {"heart_rate": 115.0, "respiratory_rate": 26.0, "spo2_pct": 91.0, "temperature_c": 38.6, "systolic_bp": 92.0, "diastolic_bp": 58.0, "lactate": 2.6, "wbc_count": 15.2, "sepsis_risk_score": 0.68, "oxygen_flow": 2.0, "mobility_score": 1}


def one(spark, **values):
    row = SEPTIC | values
    return spark.createDataFrame([tuple(row.values())], list(row))


def test_scores_of_a_septic_patient(spark):
    r = risk.primary_concern(risk.outcome_scores(one(spark))).first()
    assert r["deterioration_next_12h"] == 0.99
    assert r["sepsis_next_6h"] == pytest.approx(0.05 + 0.35 * 0.68 + 0.15 + 0.15 + 0.1 + 0.1 + 0.1)
    assert r["cardiac_arrest_next_12h"] == pytest.approx(0.02 + 0.15 + 0.1)
    assert r["respiratory_failure_next_12h"] == pytest.approx(0.04 + 0.25 + 0.1)
    assert r["primary_concern"] == "deterioration_next_12h"


def test_a_models_deterioration_score_is_used_and_limited(spark):
    r = risk.outcome_scores(one(spark, deterioration_next_12h=1.0)).first()
    assert r["deterioration_next_12h"] == 0.99
    r = risk.outcome_scores(one(spark, deterioration_next_12h=0.1).withColumn("systolic_bp", F.lit(None).cast("double"))).first()
    assert r["deterioration_next_12h"] == 0.1 and r["cardiac_arrest_next_12h"] == pytest.approx(0.02)


def test_texts_follow_their_priority(spark):
    df = spark.createDataFrame([(0.8, 0.6, 0.1, 0.5), (0.1, 0.1, 0.1, 0.1)], list(risk.OUTCOMES))
    first, second = [r["alerts"] for r in risk.alert_texts(df).collect()]
    assert [t.split()[1] for t in first] == ["SEPSIS", "RESPIRATORY", "DETERIORATION"] and second == [risk.ALL_CLEAR]


def test_what_if_has_the_fixed_effects(spark):
    df = spark.createDataFrame([(0.6, 140.0, 120.0, 4.0, 90.0, 120.0, 80.0, 1.0, 97.0)], ["p", "systolic_bp", "heart_rate", "lactate", "spo2_pct", "systolic_bp_new", "heart_rate_new", "lactate_new", "spo2_pct_new"])
    r = risk.what_if(df, "p").first()
    assert r["new_risk"] == pytest.approx(0.6 + 20 * -0.003 + -40 * 0.002 + -3 * 0.06 + -7 * 0.015) and r["beneficial"]


def test_waterfall_orders_by_size(spark):
    rows = risk.waterfall(one(spark, id=1), ["id"]).orderBy("rank").collect()
    assert [r["feature"] for r in rows] == ["Systolic BP", "Heart Rate", "Respiratory Rate", "Serum Lactate", "SpO₂"]
    assert [r["contribution"] for r in rows] == [0.45, 0.42, 0.4, 0.385, 0.32] and rows[0]["rank"] == 1


def test_all_eight_rules_and_their_severity(spark):
    df = spark.createDataFrame([(1, 0.8, 0.5, 95.0, 600.0, 0.06, 0.21, 0.3)], ["patient_id", "probability", "previous", "gpu_pct", "latency_ms", "error_rate", "psi", "relative_drift"])
    got = {r["rule"]: (r["severity"], r["cooldown"]) for r in alerts.fired(df, alerts.RULES | alerts.SYSTEM_RULES | alerts.DRIFT_RULES).collect()}
    assert got == {
        "critical_risk": ("CRITICAL", 60), "rapid_increase": ("CRITICAL", 120), "gpu_memory_high": ("WARNING", 600), "high_latency": ("WARNING", 300),
        "model_error_spike": ("CRITICAL", 120), "feature_drift": ("WARNING", 3600), "prediction_drift": ("CRITICAL", 1800),
    }
    assert [r["rule"] for r in alerts.fired(df.withColumn("probability", F.lit(0.6))).collect()] == ["high_risk"]


def test_second_alert_within_the_cooldown_is_silent(spark):
    df = spark.createDataFrame([(1, 0.85, None, 0), (1, 0.85, None, 30), (1, 0.85, None, 60)], f"{ENTITY} long, probability double, previous double, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r[0] for r in alerts.cool_down(alerts.fired(df)).select(F.unix_timestamp("ts")).orderBy(F.unix_timestamp("ts")).collect()] == [0, 60]


def test_orders_of_the_accountant():
    assert len(federated.ORDERS) == 151 and federated.ORDERS[0] == 1.1 and federated.ORDERS[98] == 10.9 and federated.ORDERS[99:] == tuple(map(float, range(12, 64)))


def test_soft_cardiac_signs_need_the_event_or_its_hour(spark):
    rows = [(1, 0, 100.0, 120.0, -1, 0), (1, 1, 39.0, 120.0, -1, 0), (2, 0, 100.0, 120.0, -1, 1), (2, 1, 39.0, 120.0, -1, 1)]
    df = spark.createDataFrame(rows, f"{ENTITY} long, {HOUR} long, heart_rate double, systolic_bp double, deterioration_hour long, deterioration_event int")
    df = df.withColumns({c: F.lit(None).cast("double") for c in ("respiratory_rate", "spo2_pct", "temperature_c", "lactate")})
    got = {(r[ENTITY], r[HOUR]): r["cardiac_arrest_next_12h"] for r in labels.look_ahead(df).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (2, 0): 1, (2, 1): 0}


def test_drift_needs_a_hundred_rows(spark):
    ref = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    assert drift.psi(ref, ref.limit(99).withColumn("x", F.lit(1.0)), ["x"]).first()["psi"] == 0
    assert drift.psi(ref, ref.limit(120).withColumn("x", F.lit(1.0)), ["x"]).first()["psi"] > 0.2


def test_checks_of_columns_names_and_records(spark):
    df = spark.createDataFrame([(0, 5, 500.0, "7"), (1, 6, None, "x")], f"{ENTITY} long, {HOUR} long, heart_rate double, lactate string")
    assert quality.missing_columns(df, "labs") == ["wbc_count", "creatinine", "crp_level", "hemoglobin", "sepsis_risk_score"]
    assert {r["column_name"]: r["errors"] for r in quality.type_errors(df).collect()} == {HOUR: 0, "heart_rate": 0, "lactate": 1}
    assert [r["reject_reasons"] for r in quality.strict_rejects(df).collect()] == [[ENTITY, "heart_rate"], ["heart_rate"]]
    assert quality.distinct_names(["a", "b"], ["b", "c", "a"]) == ["a", "b", "c"]
    assert df.select(quality.as_record(ENTITY, "heart_rate").alias("r")).collect()[1]["r"] == '{"patient_id":1}'
    flow = spark.createDataFrame([("none", 0.0), ("none", 2.0), ("mask", 0.0), ("mask", 4.0)], "oxygen_device string, oxygen_flow double")
    assert [r[0] for r in flow.select(quality.oxygen_flow_consistent()).collect()] == [True, False, False, True]


def test_groups_without_positives_are_left_out_and_shadows_are_zero(spark):
    rows = spark.createDataFrame([("a", 0.9, 1), ("a", 0.1, 0), ("b", 0.5, 0)], "outcome string, score double, label long")
    assert [r["outcome"] for r in evaluation.by_group(rows, "outcome").collect()] == ["a"]
    empty = spark.createDataFrame([], "c double, d double, y long")
    got = evaluation.shadow_metrics(empty, "c", "d", "y").first()
    assert got["labelled"] == 0 and got["auroc_delta"] == 0


def test_padded_families_of_a_short_stay(spark):
    df = spark.createDataFrame([(1, h, v) for h, v in enumerate((70.0, 72.0, 77.0))], f"{ENTITY} long, {HOUR} long, heart_rate double")
    rows = features.padded_trends(df, ["heart_rate"], 4).orderBy(HOUR).collect()
    assert [r["heart_rate_delta"] for r in rows] == [0, 2, 7] and rows[2]["heart_rate_accel"] == pytest.approx((5 - 0) / 2)
    single = features.expand_single(df, ["heart_rate_mean", "heart_rate_cv", "age", "other"], ["heart_rate"]).orderBy(HOUR).first()
    assert tuple(single)[3:] == (70.0, 0.0, 65.0, 0.0)


def test_running_sums_by_ranges_equal_those_of_one_task(spark):
    from tidewell.operators.prefix import running_sums

    df = spark.range(500).select((F.pmod(F.xxhash64("id"), F.lit(10**6))).alias("x"), (F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"))
    for down in (False, True):
        one, many = (sorted(map(str, running_sums(df, "x", ["a", "b"], down, n).select("x", "a_upto", "b_upto", "a_all").collect())) for n in (1000, 10))
        assert one == many


@pytest.mark.parametrize("zone", ["Etc/UTC", "Asia/Kolkata", "America/New_York"])
def test_cooldowns_in_any_time_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.range(10).select(F.lit("r").alias("rule"), F.col("id").alias("patient_id"), F.timestamp_seconds(F.col("id") * 40 + 1_700_000_000).alias("ts"), F.lit(100).alias("cooldown"))
        rows = rows.unionByName(rows.limit(1).withColumn("ts", F.lit(None).cast("timestamp")))
        got = alerts.cool_down(rows).select("patient_id", F.unix_seconds("ts").alias("s")).collect()
        assert sorted(((r["patient_id"], r["s"]) for r in got), key=str) == sorted([(k, 1_700_000_000 + 40 * k) for k in (0, 3, 6, 9)] + [(0, None)], key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
