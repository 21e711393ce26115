from __future__ import annotations

import time

from pyspark.sql import functions as F

from tidewell.plans import catalogue
from tidewell.streaming import jobs

DAY = 1_704_067_200


def test_ingest_separates_valid_and_rejected(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 80.0), (1, 1, 999.0)], "patient_id long, hour_from_admission long, heart_rate double")
    rows.write.json(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), rows.schema)
    jobs.ingest(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).first()["reject_reasons"] == ["heart_rate"]


def test_duplicates_and_cooldown_state(spark, tmp_path):
    rows = spark.createDataFrame([("r", 600, t) for t in (DAY, DAY, DAY + 300, DAY + 700)], "rule string, cooldown int, t long").withColumn("ts", F.timestamp_seconds("t"))
    rows.drop("t").write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, "parquet")
    once = jobs.run_to_table(jobs.once_each(stream, ["rule", "ts"], "ts"), str(tmp_path), "once", "append")
    assert once.count() == 3
    passed = jobs.run_to_table(jobs.cool_down(stream, ["rule"]), str(tmp_path), "passed", "append")
    assert sorted(r["ts"].timestamp() for r in passed.collect()) == [DAY, DAY + 700]


def test_hourly_windows_read_a_folder_of_parts_and_keep_the_driver_out(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    query = catalogue.queries()["st01_hourly_windows"]
    got = query(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, query(spark, sf).collect())) and got.count() > 0
    assert "parquet" in got._jdf.queryExecution().executedPlan().toString().lower()
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(str(tmp_path / "none" / "events.parquet"))
    assert query(spark, str(tmp_path / "none")).count() == 0


def streamed(spark, tmp_path, name, *batches):
    """A stream that brings each of the frames in a batch of its own."""
    for k, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        time.sleep(1.1 if k + 1 < len(batches) else 0)  # files are read in the order of their times
    return jobs.file_stream(spark, str(tmp_path / name), batches[0].schema, "parquet", 1)


def at(spark, rows, names):
    return spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_state_goes_when_its_cooldown_is_over(spark, tmp_path):
    names = "rule string, cooldown int, t long"
    stream = streamed(spark, tmp_path, "in", at(spark, [("r", 600, DAY), ("r", 600, DAY + 100)], names), at(spark, [("q", 600, DAY + 90_000)], names), at(spark, [("r", 600, DAY + 90_100), ("r", 600, DAY)], names))
    got = jobs.run_to_files(jobs.cool_down(stream, ["rule"]), str(tmp_path / "out"), "append").collect()
    assert sorted((r["rule"], r["ts"].timestamp()) for r in got) == [("q", DAY + 90_000), ("r", DAY), ("r", DAY + 90_100)]


def test_previous_values_and_bounded_buffers_run_on_over_batches(spark, tmp_path):
    names = "patient_id long, p double, t long"
    batches = [at(spark, [(1, 0.2, DAY), (1, 0.5, DAY + 60), (2, 0.1, DAY)], names), at(spark, [(1, 0.4, DAY + 120)], names)]
    stream = streamed(spark, tmp_path, "in", *batches)
    got = jobs.run_to_files(jobs.with_previous(stream, "patient_id", "ts", "p"), str(tmp_path / "out"), "append").collect()
    assert sorted((r["patient_id"], r["p"], r["previous"]) for r in got if r["previous"] is not None) == [(1, 0.4, 0.5), (1, 0.5, 0.2)] and len(got) == 4
    kept = jobs.run_to_files(jobs.recent_buffer(stream, "patient_id", "ts", "p", 2), str(tmp_path / "kept"), "append").collect()
    assert sorted((r["patient_id"], r["n"], round(r["mean"], 6)) for r in kept) == [(1, 2, 0.35), (1, 2, 0.45), (2, 1, 0.1)]


def test_late_outcomes_meet_their_predictions(spark, tmp_path):
    p = streamed(spark, tmp_path, "p", at(spark, [(1, DAY), (2, DAY)], "patient_id long, t long")).withColumnRenamed("ts", "predicted_at")
    o = streamed(spark, tmp_path, "o", at(spark, [(1, DAY + 3600), (2, DAY + 50_000), (1, DAY)], "patient_id long, t long")).withColumnRenamed("ts", "happened_at")
    got = jobs.run_to_files(jobs.late_outcomes(p, o, "patient_id"), str(tmp_path / "out"), "append").collect()
    assert [(r["patient_id"], r["happened_at"].timestamp()) for r in got] == [(1, DAY + 3600)]


def test_silent_sites_and_dead_letters(spark, tmp_path):
    beats = [at(spark, [("a", DAY), ("a", DAY + 60), ("b", DAY)], "site string, t long"), at(spark, [("b", DAY + 600)], "site string, t long")]
    got = jobs.run_to_files(jobs.silent(streamed(spark, tmp_path, "beats", *beats), "site", "ts"), str(tmp_path / "out"), "append").collect()
    assert sorted((r["site"], r["since"].timestamp(), r["beats"]) for r in got) == [("a", DAY + 150, 2), ("b", DAY + 90, 1)]
    spark.createDataFrame([('{"k": 1}',), ("no json",)], "value string").write.json(str(tmp_path / "raw"))
    messages = jobs.parse_messages(jobs.file_stream(spark, str(tmp_path / "raw"), "value string"), "k long")
    jobs.route(messages, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).first()["k"] == 1
    assert [tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == [("no json", "unreadable")]


def test_silent_keys_leave_the_state(spark, tmp_path):
    names = "patient_id long, p double, t long"
    batches = [
        at(spark, [(1, 0.2, DAY), (1, 0.5, DAY + 60), (2, 0.1, DAY)], names),
        at(spark, [(3, 0.9, DAY + 40_000)], names),
        at(spark, [(3, 0.8, DAY + 40_060)], names),
        at(spark, [(1, 0.7, DAY + 40_070), (3, 0.6, DAY + 40_120)], names),
    ]
    stream = streamed(spark, tmp_path, "in", *batches)

    def run(rows, folder):
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / folder)).option("checkpointLocation", str(tmp_path / f"{folder}_cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return spark.read.parquet(str(tmp_path / folder)).collect(), held

    got, held = run(jobs.with_previous(stream, "patient_id", "ts", "p", "1 minute", idle=3600), "previous")
    assert {(r["patient_id"], r["p"]): r["previous"] for r in got} == {(1, 0.2): None, (1, 0.5): 0.2, (2, 0.1): None, (3, 0.9): None, (3, 0.8): 0.9, (1, 0.7): None, (3, 0.6): 0.8}
    assert min(held[1:]) < max(held)  # two of three keys went
    got, held = run(jobs.recent_buffer(stream, "patient_id", "ts", "p", 2, "1 minute", idle=3600), "recent")
    assert sorted((r["patient_id"], r["n"], round(r["mean"], 6)) for r in got) == [(1, 1, 0.7), (1, 2, 0.35), (2, 1, 0.1), (3, 1, 0.9), (3, 2, 0.7), (3, 2, 0.85)]
    assert min(held[1:]) < max(held)
