"""Files in and out: panel files, audit logs, the retraining buffer, sequences, envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import features
from tidewell.schemas import ENTITY, HOUR
from tidewell.sources import lake, panel


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_three_files_stand_in_for_the_joined_one(spark, tmp_path):
    write(tmp_path / "vitals.csv", "patient_id,hour_from_admission,systolic_bp,heart_rate\n1,0,120,72\n1,1,x,80\n2,0,110,75\n")
    write(tmp_path / "labs.csv", "patient_id,hour_from_admission,lactate\n1,0,1.5\n3,4,2.5\n")
    write(tmp_path / "patients.csv", "patient_id,age,gender,deterioration_hour\n1,60,F,8\n2,50,M,-1\n")
    got = {(r[ENTITY], r[HOUR]): r for r in panel.load(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (3, 4)}
    assert (got[1, 0]["heart_rate"], got[1, 0]["lactate"], got[1, 0]["age"], got[1, 0]["deterioration_hour"]) == (72.0, 1.5, 60, 8)
    assert got[1, 1]["systolic_bp"] is None and got[3, 4]["lactate"] == 2.5 and got[3, 4]["age"] is None
    write(tmp_path / "hourly_panel.csv", "patient_id,hour_from_admission,heart_rate\n9,0,60\n")
    assert [r[ENTITY] for r in panel.load(spark, str(tmp_path)).collect()] == [9]


def test_audit_log_filters(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 86_400)
    events = spark.range(3).select(at.alias("timestamp"), F.when(F.col("id") < 2, "ingest").otherwise("export").alias("event_type"), F.lit("hl7").alias("source"), F.col("id").cast("string").alias("patient_id"), F.lit(5).cast("long").alias("record_count"), F.lit("ok").alias("status"), F.lit(None).cast("map<string,string>").alias("metadata"))
    lake.append_audit(events, str(tmp_path / "audit"))
    lake.append_audit(events.limit(0), str(tmp_path / "audit"))
    read = lambda **f: lake.read_audit(spark, str(tmp_path / "audit"), **f).count()
    assert (read(), read(event_type="ingest"), read(patient_id="2"), read(date="2024-01-02"), read(event_type="none")) == (3, 2, 1, 1, 0)


def test_buffer_keeps_its_bookkeeping_and_can_be_cleared(spark, tmp_path):
    path = str(tmp_path / "buffer")
    rows = spark.createDataFrame([(1, 0.4, 1, 2.0), (2, 0.6, None, 3.0)], "patient_id long, prediction double, actual_outcome int, lactate double")
    lake.append_buffer(rows, path, F.timestamp_seconds(F.lit(1_704_067_200)))
    got = lake.read_buffer(spark, path)
    assert {"_prediction", "_actual_outcome", "_patient_id", "_timestamp", "_ingested_at", "lactate"} <= set(got.columns)
    assert lake.buffer_size(spark, path) == 2 and lake.clear_buffer(spark, path) >= 1 and lake.clear_buffer(spark, path) == 0


def test_envelopes_are_the_same_when_written_again_and_lines_that_are_no_messages_are_told_apart(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1.0), (7, 2.0)], "patient_id long, x double")
    ids = lambda: sorted((r["ingestion_id"], r["patient_id"]) for r in lake.envelope(rows, "vitals", F.timestamp_seconds(F.lit(0))).collect())
    assert ids() == ids() and {p for _, p in ids()} == {"unknown", "7"}
    write(tmp_path / "q" / "topic=t" / "date=2024-01-01" / "a.jsonl", '{"key":"1","timestamp":"2024-01-01T00:00:00Z","value":"{}"}\n\nbroken\n')
    good, bad = lake.read_queue(spark, str(tmp_path / "q"))
    assert good.count() == 1 and [r["value"] for r in bad.collect()] == ["broken"]


def test_sequences_by_split(spark, tmp_path):
    rows = spark.createDataFrame([(1, h, float(h), float(-h), "train") for h in range(3)], f"{ENTITY} long, {HOUR} long, a double, b double, split string")
    lake.write_sequences(features.padded_windows(rows, ["a", "b"], 2).select(ENTITY, HOUR, "window", "split"), str(tmp_path / "s"), ["a", "b"])
    got = {r[HOUR]: list(r["values"]) for r in spark.read.parquet(str(tmp_path / "s" / "sequences")).collect()}
    assert got == {0: [0, 0, 0, 0], 1: [0, 0, 1, -1], 2: [1, -1, 2, -2]}
    assert sorted(r["feature"] for r in spark.read.json(str(tmp_path / "s" / "features")).collect()) == ["a", "b"]
