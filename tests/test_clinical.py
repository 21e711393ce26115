"""Strict mapping of observations, point scores at their cuts, and intervals at their edges."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewell.operators import clinical_docs, early_warning, metrics


def test_strict_mapping_drops_panels_of_unknown_codes(spark):
    code = lambda c: {"coding": [{"system": "http://loinc.org", "code": c}]}
    subject = {"reference": "Patient/7"}
    by_column = {v: k for k, v in clinical_docs.LOINC.items()}
    parts = [{"code": code(by_column["systolic_bp"]), "valueQuantity": {"value": 120.0}}]
    found = [
        {"resourceType": "Observation", "id": "a", "subject": subject, "code": code("85354-9"), "component": parts},
        {"resourceType": "Observation", "id": "b", "subject": subject, "code": code(by_column["heart_rate"]), "valueQuantity": {"value": 80.0}},
    ]
    bundles = spark.createDataFrame([(json.dumps({"entry": [{"resource": r} for r in found]}),)], "bundle string")
    obs = clinical_docs.observations(bundles)
    fields = ["heart_rate", "systolic_bp"]
    assert [tuple(r) for r in clinical_docs.pivot_fhir(obs, fields).collect()] == [("7", 80.0, 120.0)]
    assert [tuple(r) for r in clinical_docs.pivot_fhir(obs, fields, strict=True).collect()] == [("7", 80.0, None)]


def test_points_at_the_cuts(spark):
    rows = [
        (12.0, 96.0, 111.0, 51.0, 36.1, 0.0, "A", 0, 0),
        (25.0, 91.0, 90.0, 131.0, 35.0, 2.0, "U", 20, 12),
        (None, None, None, None, None, None, None, 0, 0),
        (21.0, 94.0, 220.0, 110.0, 39.1, None, "V", 12, 8),
    ]
    df = spark.createDataFrame(rows, "respiratory_rate double, spo2_pct double, systolic_bp double, heart_rate double, temperature_c double, oxygen_flow double, avpu string, n int, m int")
    got = early_warning.early_warning(df).collect()
    assert [r["news2"] for r in got] == [r["n"] for r in got]
    assert [r["mews"] for r in got] == [r["m"] for r in got]


def test_intervals_and_reclassification_at_the_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10)], "k int, n int").select(metrics.wilson(F.col("k"), F.col("n")).alias("w")).select("w.*")
    none, low, high = [tuple(r) for r in df.collect()]
    assert none == (None, None)
    assert abs(low[0]) < 1e-12 and abs(low[1] - (1 - high[0])) < 1e-12
    same = spark.createDataFrame([(0.1, 0.9, 1), (0.9, 0.1, 0), (None, 0.5, 1)], "a double, b double, label int")
    row = metrics.reclassification(same, "a", "b").first()
    assert row["nri"] == 2.0 and abs(row["idi"] - 1.6) < 1e-12
    assert tuple(metrics.reclassification(same.limit(0), "a", "b").first()) == (None, None)


def test_pivot_takes_the_last_of_a_field_and_whole_rows_only_if_asked(spark):
    head = "MSH|^~\\&|A|B|C|D|2024||ORU^R01|{}|P|2.5"
    hr, o2, t = "OBX|1|NM|8867-4^x^LN||{}", "OBX|1|NM|2708-6^x^LN||{}", "OBX|1|NM|8310-5^x^LN||{}"
    texts = [
        "\r".join([head.format("last"), hr.format(80), o2.format(97), hr.format(90), hr.format("none"), hr.format("")]),
        "\r".join([head.format("same"), t.format(37.5)]),
        "\r".join([head.format("same"), t.format(37.5)]),
        "\r".join([head.format("words"), hr.format("fast")]),
        head.format("bare"),
        "",
        None,
    ]
    parsed = clinical_docs.parse_hl7(spark.createDataFrame([(x, 1) for x in texts], "message string, heart_rate int"))
    got = clinical_docs.pivot_hl7(parsed, complete=False).collect()
    assert sorted((r["control_id"], r["heart_rate"], r["spo2_pct"], r["temperature_c"]) for r in got) == [("last", 90.0, 97.0, None)] + [("same", None, None, 37.5)] * 2
    two = clinical_docs.pivot_hl7(parsed, fields=["heart_rate", "spo2_pct"]).collect()
    assert [tuple(r) for r in two] == [("last", 90.0, 97.0)]
