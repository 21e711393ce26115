"""Feeds, registries, rounds, checklists and lists against small known answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators import clinical_docs, evaluation, federated, metrics, ml, protocols
from tidewell.schemas import ENTITY, HOUR
from tidewell.sources import feeds, lake, registry


def test_frames_of_landed_connections(spark, tmp_path):
    first, second = "MSH|^~\\&|a\rPID|1\r", "MSH|^~\\&|b\r"
    (tmp_path / "one").write_bytes(f"noise\x0b{first}\x1c\r\x0b{second}\x1c\r\x0bc\x0bd\x1c\rtail".encode())
    (tmp_path / "two").write_bytes(b"")
    assert sorted(r[0] for r in feeds.read_frames(spark, str(tmp_path)).collect()) == sorted([first, second, "c\x0bd"])


def observation(key, patient, date, category="vital-signs", code="8867-4", system="http://loinc.org"):
    coding = [{"system": system, "code": code}]
    kinds = [{"coding": [{"system": "c", "code": category}]}] if category else None
    return {"resource": {"resourceType": "Observation", "id": key, "effectiveDateTime": date, "category": kinds, "subject": {"reference": f"Patient/{patient}"}, "code": {"coding": coding}, "valueQuantity": {"value": 1.0}}}


def test_search_takes_each_patients_newest(spark):
    entries = [observation("a", 1, "2024-01-01T00:00:00Z"), observation("b", 1, "2024-01-03T00:00:00Z"), observation("c", 1, "2024-01-02T00:00:00Z", "laboratory", "2524-7"), observation("d", 1, None), observation("e", 2, "2024-01-01T00:00:00Z", None, "2524-7", "local")]
    obs = clinical_docs.observations(spark.createDataFrame([(json.dumps({"entry": entries}),)], "bundle string"))
    ids = lambda **by: [r["id"] for r in feeds.search(obs, **by).orderBy("patient_id", "rank").collect()]
    assert ids() == ["b", "c", "a", "d", "e"]
    assert ids(count=2) == ["b", "c", "e"] and ids(category="laboratory") == ["c"] and ids(category="vital-signs", count=1) == ["b"]
    assert ids(code="2524-7") == ["c"] and ids(patient="2") == ["e"] and ids(patient="3") == []


def test_topic_rows_keep_the_entity_as_key(spark):
    rows = spark.createDataFrame([(7, 1.5), (None, 2.5)], f"{ENTITY} long, x double")
    assert sorted((r["key"], r["value"]) for r in feeds.topic_rows(rows).collect()) == [("7", '{"patient_id":7,"x":1.5}'), ("unknown", '{"x":2.5}')]


def test_registry_snapshots(spark, tmp_path):
    folder, schema = str(tmp_path / "r"), "version_id string, retired boolean"
    assert registry.load(spark, folder, schema).count() == 0
    for k in range(5):
        assert registry.save(spark.createDataFrame([(f"v{j}", j < k) for j in range(k + 1)], schema), folder, 2) == k + 1
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["snapshot-000004", "snapshot-000005"]
    (tmp_path / "r" / "snapshot-000006").mkdir()  # a writer that was lost
    assert registry.load(spark, folder, schema).count() == 5
    assert registry.save(registry.load(spark, folder, schema), folder, 2) == 6


def test_keyed_records_and_artifacts(spark, tmp_path):
    (tmp_path / "devices.json").write_text('{"d1": {"physician_id": "p", "active": true}, "d2": {"physician_id": "q"}}')
    got = registry.read_keyed(spark, str(tmp_path / "devices.json"), "physician_id string, active boolean", "device_id")
    assert sorted(tuple(r) for r in got.collect()) == [("d1", "p", True), ("d2", "q", None)]
    for v in "abc":
        (tmp_path / "models" / v).mkdir(parents=True)
    before, after = (spark.createDataFrame([(v,) for v in vs], "version_id string") for vs in ("abcx", "b"))
    assert sorted(r[0] for r in registry.drop_artifacts(before, after, str(tmp_path / "models")).collect()) == ["a", "c"]
    assert [p.name for p in (tmp_path / "models").iterdir()] == ["b"]


def test_explanations_and_profiles_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5)], "feature string, contribution double")
    registry.write_explanations(rows, str(tmp_path / "e"))
    registry.write_profile(rows, ["a", "b"], str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "e"), header=True).collect()[0]["feature"] == "a"
    assert spark.read.json(str(tmp_path / "p")).collect()[0]["features"] == ["a", "b"]


def test_admissions_go_to_the_lake_by_type(spark, tmp_path):
    rows = spark.createDataFrame([("1", 50)], f"{ENTITY} string, age int")
    lake.write_lake(lake.envelope(rows, "icu-adt", F.timestamp_seconds(F.lit(0))), str(tmp_path / "l"))
    assert lake.read_partition(spark, str(tmp_path / "l"), "icu-adt", "1970-01-01").select("payload.age").first()[0] == 50


def test_rounds(spark):
    kinds = [("a", "register", 0.0, 10), ("b", "register", 0.0, 20), ("c", "register", 0.0, 30), ("c", "unregister", 5.0, None), ("a", "heartbeat", 900.0, None), ("d", "heartbeat", 900.0, None), ("a", "submit", 950.0, None)]
    sites = federated.site_states(spark.createDataFrame(kinds, "site_id string, kind string, at double, dataset_size long"), 1000.0)
    assert {r["site_id"]: (r["active"], r["dataset_size"], r["rounds"]) for r in sites.collect()} == {"a": (True, 10, 1), "b": (False, 20, 0)}
    allowed = lambda **k: federated.can_start(sites, **k).first()["can_start"]
    assert not allowed(spent=0.0, budget=1.0) and allowed(spent=0.0, budget=1.0, least=1) and not allowed(spent=1.0, budget=1.0, least=1)
    rounds = spark.createDataFrame([(1, True), (2, False), (3, False)], "round_number int, aggregated boolean")
    updates = spark.createDataFrame([(2, "a"), (2, "a"), (3, "b"), (3, "z")], "round_number int, site_id string")
    got = {r["round_number"]: (r["received"], r["state"]) for r in federated.round_states(rounds, updates, sites).collect()}
    assert got == {1: (0, "COMPLETED"), 2: (1, "READY"), 3: (1, "TRAINING")}


def test_unknown_conditions_have_the_general_checklist(spark):
    rows = spark.createDataFrame([("cardiac",), ("other",), (None,)], "c string")
    got = protocols.with_protocol(rows, "c").groupBy("c").agg(F.first("protocol").alias("p"), F.count("*").alias("n")).collect()
    assert {r["c"]: r["n"] for r in got} == {"cardiac": 5, "other": 5, None: 5}
    assert {r["p"] for r in got if r["c"] != "cardiac"} == {"Rapid Response Team (RRT) Activation"}


def test_lists_go_by_level_then_probability(spark):
    rows = spark.createDataFrame([("Ann", 0.3), ("bea", 0.9), ("Cy", 0.6), ("dAn", 0.6), ("e", None)], "name string, p double")
    names = lambda **by: [r["name"] for r in evaluation.find(rows, "p", "name", **by).collect()]
    assert names(text="AN") == ["dAn", "Ann"] and names(level="HIGH") == ["Cy", "dAn"] and names(most=2) == ["bea", "Cy"]


def test_delong_youden_and_survival_on_small_tables(spark):
    of = lambda rows: spark.createDataFrame(rows, "score double, label int")
    # placements of 0.8, 0.4 over {0.6, 0.2}: 1, 1/2; of 0.6, 0.2: 1/2, 1; variances 1/8 each, over 2
    got = metrics.delong(of([(0.8, 1), (0.4, 1), (0.6, 0), (0.2, 0)])).first()
    assert (got["auroc"], got["se"]) == (0.75, pytest.approx(0.353553, abs=1e-6))
    assert metrics.delong(of([(0.8, 1), (0.4, 0)])).first()["se"] is None
    assert [tuple(r) for r in metrics.youden(of([(0.8, 1), (0.4, 1), (0.6, 0), (0.2, 0)])).collect()] == [(0.8, 0.5)]
    assert metrics.youden(of([(0.1, 1), (0.4, 0)])).count() == 0
    times = spark.createDataFrame([(1, True), (1, False), (2, True), (3, True), (3, True), (None, True)], "t int, e boolean")
    assert [tuple(r) for r in metrics.kaplan_meier(times, "t", "e").orderBy("time").collect()] == [(1, 5, 1, 0.8), (2, 3, 1, pytest.approx(0.533333)), (3, 2, 2, 0.0)]


def test_a_search_finds_a_model_that_tells_the_classes(spark):
    rows = spark.range(400).select((F.col("id") % 40).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"), F.when(F.col("id") % 40 > 20, 1.0).otherwise(0.0).alias("y"), F.col("id").alias(ENTITY), F.lit("s").alias("text"), F.lit(1).alias("sepsis_next_6h"))
    assert ml.feature_columns(rows, "y") == ["x", "z"]
    best, tried = ml.search(ml.assemble(rows, ["x", "z"]), "y", trials=2, trees=3)
    assert len(tried) == 2 and max(m for _, m in tried) > 0.95 and set(tried[0][0]) == {"maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode"}
    assert best.getNumTrees == 3
