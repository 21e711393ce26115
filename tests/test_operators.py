from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import alerts, clinical_docs, drift, features, grid, impute, labels, quality, split
from tidewell.schemas import ENTITY, HOUR


def series(spark, values, name="heart_rate"):
    return spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], f"{ENTITY} long, {HOUR} long, {name} double")


def column(df, name="heart_rate"):
    return [r[0] for r in df.orderBy(ENTITY, HOUR).select(name).collect()]


def test_out_of_range_is_quarantined(spark):
    df = series(spark, [72.0, 500.0, None])
    assert quality.valid_rows(df).count() == 2
    assert quality.quarantined(df).first()["reject_reasons"] == ["heart_rate"]


def test_null_category_fails_and_bad_types_become_null(spark):
    df = spark.createDataFrame([("F", "1.5"), (None, "7"), ("x", "a")], "gender string, age string")
    assert quality.valid_rows(quality.coerce(df)).count() == 1
    assert sorted(map(str, column_values(quality.coerce(df), "age"))) == ["7", "None", "None"]


def column_values(df, name):
    return [r[0] for r in df.select(name).collect()]


def test_carry_forward_and_interpolation(spark):
    assert column(impute.carry_forward(series(spark, [72.0, None, 78.0]), ["heart_rate"])) == [72.0, 72.0, 78.0]
    gaps = [1.0, None, None, None, None, None, 7.0, None, None, None, None, None]
    assert column(impute.interpolate(series(spark, gaps), ["heart_rate"])) == [1, 2, 3, 4, None, None, 7, 7, 7, 7, None, None]


def test_cascade_matches_pandas_on_random_gaps(spark):
    rng = random.Random(5)
    rows = [(e, h, None if rng.random() < 0.4 else float(rng.randint(50, 120))) for e in range(40) for h in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, f"{ENTITY} long, {HOUR} long, heart_rate double")
    frame = pd.DataFrame(rows, columns=[ENTITY, HOUR, "v"])
    median = frame.v.median()
    want = frame.groupby(ENTITY).v.transform(lambda s: s.interpolate(limit=3).ffill().bfill()).fillna(median)
    got = column(impute.cascade(df, impute.fit_statistics(df, ["heart_rate"]), ["heart_rate"]))
    assert got == pytest.approx(want.tolist())


def test_grid_fills_hours_and_caps(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 2, 2.0), (1, 4, 3.0), (2, 80, 9.0)], f"{ENTITY} long, {HOUR} long, x double")
    assert column(grid.continuous_grid(df), "x") == [1.0, None, 2.0, None, 3.0]
    assert grid.clip_stay(series(spark, [1.0] * 100)).count() == 72


def test_look_ahead_excludes_the_present(spark):
    rows = [(1, h, 200.0 if h == 5 else 80.0) for h in range(20)]
    df = spark.createDataFrame(rows, f"{ENTITY} long, {HOUR} long, heart_rate double")
    for c in ("systolic_bp", "respiratory_rate", "lactate", "temperature_c", "spo2_pct"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    assert column(labels.look_ahead(df), "cardiac_arrest_next_12h") == [1] * 5 + [0] * 15


def test_padded_window_repeats_the_first_row(spark):
    out = features.padded_windows(series(spark, [70.0, 72.0, 74.0]), ["heart_rate"], 4).orderBy(HOUR).collect()
    assert [x["heart_rate"] for x in out[0]["window"]] == [70.0] * 4
    assert [x["heart_rate"] for x in out[2]["window"]] == [70.0, 70.0, 72.0, 74.0]


def test_features_take_one_shuffle_and_no_python(spark):
    df = series(spark, [70.0, 72.0, None])
    plan = features.trends(features.statistics(df, ["heart_rate"]), ["heart_rate"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Cartesian" not in plan


def test_split_keeps_entities_whole(spark):
    df = spark.range(100).select(F.col("id").alias(ENTITY))
    got = {r["split"]: r["count"] for r in split.assign(df).groupBy("split").count().collect()}
    assert got == {"train": 70, "val": 15, "test": 15}


def test_cooldown_is_sequential(spark):
    rows = [("r", "w", 600, 1, t) for t in (0, 300, 600, 900, 1300)]
    df = spark.createDataFrame(rows, "rule string, severity string, cooldown int, patient_id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r["ts"].timestamp() for r in alerts.cool_down(df).collect()) == [0, 600, 1300]


def test_cooldown_of_one_clock_is_spread_and_equals_a_plain_fold(spark, monkeypatch):
    monkeypatch.setattr(alerts, "BLOCK_COOLDOWNS", 3)
    monkeypatch.setattr(alerts, "BLOCK_SECONDS", 1)
    rng = random.Random(4)
    rows = [(r, c, rng.randint(1, 30), 1_000_000 + rng.randint(0, 900) * step) for r, c, step in (("dense", 20, 1), ("sparse", 7, 50), ("none", 0, 1), (None, 9, 3)) for _ in range(800)]
    df = spark.createDataFrame(rows, "rule string, cooldown int, patient_id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = alerts.cool_down(df)
    want, last = [], {}
    for r, c, p, t in sorted(rows, key=lambda x: (str(x[0]), x[3], x[2])):
        if r not in last or t - last[r] >= c:
            last[r] = t
            want.append((str(r), p, t))
    assert sorted((str(r["rule"]), r["patient_id"], int(r["ts"].timestamp())) for r in got.collect()) == sorted(want)
    own = alerts.cool_down(df, ("rule", "patient_id"))
    assert own.columns == ["rule", "patient_id", "ts"] and own.count() > len(want)
    assert "collect_list" not in got._jdf.queryExecution().toString() and got.rdd.getNumPartitions() > 1


def test_ks_is_exact_and_its_running_sums_are_not_in_one_task(spark):
    rng = random.Random(6)
    a, b = ([rng.choice([round(rng.gauss(m, 1), 1), rng.gauss(m, 1)]) for _ in range(700)] for m in (0, 0.3))
    frames = [spark.createDataFrame([(v,) for v in [*x, None]], "x double") for x in (a, b)]
    df = drift.ks_statistic(*frames, "x")
    values = sorted({*a, *b})
    assert df.first()["ks"] == round(max(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in values), 6)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(x#" not in plan and "windowspecdefinition(part#" in plan


def test_hl7_frames_and_broken_messages(spark):
    text = "\x0bMSH|^~\\&|A|B|C|D|20240101||ORU^R01|MSG001|P|2.5\nPID|1||12345^^^H||X||19850322|F\nOBX|1|NM|8867-4^heart_rate^LN||88\nOBX|2|NM|9279-1^rr^LN||n/a\x1c\r"
    out = clinical_docs.acknowledgement(clinical_docs.parse_hl7(spark.createDataFrame([(text,), ("junk",)], "message string")))
    good, bad = out.collect()
    assert (good["control_id"], good["mrn"], str(good["birth_date"]), good["ack"]) == ("MSG001", "12345", "1985-03-22", "AA")
    assert [o["number"] for o in good["obx"]] == [88.0, None] and bad["ack"] == "AE"
