"""The hour grid of three files, splits and sequences read again, flat rows, request vectors, noise, batches, loops and handlers."""

from __future__ import annotations

import itertools
import time
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import write
from tests.test_streaming import DAY, at, streamed
from tidewell.operators import clinical_docs, drift, features, federated, grid, lifecycle, message_function, ml
from tidewell.plans.model_queries import messages
from tidewell.schemas import ENTITY, HOUR
from tidewell.sources import lake, minibatches, panel, registry
from tidewell.streaming import jobs


def test_three_files_on_the_hour_grid(spark, tmp_path):
    write(tmp_path / "vitals.csv", "patient_id,hour_from_admission,heart_rate\n1,0,72\n1,3,80\n2,70,75\n2,90,76\n")
    write(tmp_path / "labs.csv", "patient_id,hour_from_admission,lactate\n1,1,1.5\n")
    write(tmp_path / "patients.csv", "patient_id,age,gender,deterioration_hour\n1,60,F,8\n")
    got = {(r[ENTITY], r[HOUR]): (r["heart_rate"], r["lactate"], r["age"]) for r in panel.load(spark, str(tmp_path), aligned=True).collect()}
    assert got == {(1, 0): (72.0, None, 60), (1, 1): (None, 1.5, 60), (1, 2): (None, None, 60), (1, 3): (80.0, None, 60), (2, 70): (75.0, None, None)}


def test_splits_and_sequences_are_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, h, float(h), "train" if h < 2 else "test") for h in range(3)], f"{ENTITY} long, {HOUR} long, a double, split string")
    lake.write_splits(rows, str(tmp_path / "s"))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got = panel.read_splits(spark, str(tmp_path / "s"))
    assert {n: d.count() for n, d in got.items()} == {"train": 2, "test": 1} and ["no split val" in str(w.message) for w in said] == [True]
    assert panel.read_splits(spark, str(tmp_path / "none"), ()) == {}
    lake.write_sequences(features.padded_windows(rows, ["a"], 2).select(ENTITY, HOUR, "window", "split"), str(tmp_path / "q"), ["a"])
    sequences, names = lake.read_sequences(spark, str(tmp_path / "q"), "train")
    assert names == ["a"] and sorted(list(r["values"]) for r in sequences.collect()) == [[0.0, 0.0], [0.0, 1.0]]
    assert "PartitionFilters: [isnotnull(split" in sequences._jdf.queryExecution().toString()


def test_widths_of_one_and_steps(spark):
    df = spark.createDataFrame([(1, h, float(h)) for h in range(7)], f"{ENTITY} long, {HOUR} long, a double")
    same = grid.resample(df, 1, ["a"])
    assert dict(same.dtypes)[HOUR] == "int" and same.count() == 7
    assert sorted(r[HOUR] for r in features.padded_windows(df, ["a"], 3, step=3).collect()) == [0, 3, 6]


def test_flat_rows_and_default_score(spark):
    vitals = spark.createDataFrame([(1, 0, *[1.0] * 6, "none", 0.0, 1, 0), (2, 0, *[2.0] * 6, "none", 0.0, 1, 0)], "patient_id long, hour_from_admission long, " + ", ".join(f"{c} double" for c in clinical_docs.FLAT_VITALS[:6]) + ", oxygen_device string, oxygen_flow double, mobility_score int, nurse_alert int")
    labs = spark.createDataFrame([(1, 0, 5.0, 1.0, 1.0, 1.0, 1.0), (2, 0, None, 1.0, 1.0, 1.0, 1.0)], "patient_id long, hour_from_admission long, " + ", ".join(f"{c} double" for c in clinical_docs.FLAT_LABS[:5]))
    people = spark.createDataFrame([(1, 60, "F", 0, "ED")], "patient_id long, age int, gender string, comorbidity_index int, admission_type string")
    rows = clinical_docs.flat_rows(vitals, labs, people).collect()
    assert [(r["patient_id"], r["sepsis_risk_score"], r["age"]) for r in rows] == [(1, 0.0, 60)] and len(rows[0]) == 22
    assert clinical_docs.complete_labs(labs.withColumn("sepsis_risk_score", F.lit(0.4))).first()["sepsis_risk_score"] == 0.4
    full = clinical_docs.flat_rows(vitals, labs)
    vector = ml.request_vector(full).first()["vector"]
    assert len(vector) == 15 and vector[6] == 0.0 and vector[9] == 5.0 and vector[14] == 0.0
    assert dict(ml.request_vector(full).dtypes)["vector"] == "array<float>"


def test_identifier_stands_in_for_an_unknown_code(spark):
    text = "MSH|^~\\&|A|B|C|D|2024||ORU^R01|id1|P|2.5\rOBX|1|NM|LOCAL1^heart_rate^L||88\rOBX|2|NM|LOCAL2^8867-4^L||90\rOBX|3|NM|LOCAL3^what^L||91"
    parsed = clinical_docs.parse_hl7(spark.createDataFrame([(text,)], "message string"))
    row = clinical_docs.pivot_hl7(parsed, complete=False).first()
    assert row["heart_rate"] == 90.0  # the identifier's code is known, its plain name and the third aren't


def test_noise_is_normal_and_the_same_however_rows_are_spread(spark):
    df = spark.range(400).select(F.col("id"), F.array(*[F.lit(0.0)] * 20).alias("v"))
    one, two = (federated.noised(d, "v", 1.5, 2.0, "id").orderBy("id").collect() for d in (df, df.repartition(7)))
    assert one == two
    drawn = np.array([r["v"] for r in one])
    assert abs(drawn.mean()) < 0.1 and abs(drawn.std() - 3.0) < 0.1


def test_batches_cover_each_epoch_once_and_go_on_at_a_step(spark, tmp_path):
    df = spark.createDataFrame([(k, float(k), None if k % 5 else 1.0, k % 2) for k in range(103)], "k long, a double, b double, label int").repartition(4)
    for epoch in (0, 1):
        minibatches.write(minibatches.numbered(df, ["k"], 10, epoch), str(tmp_path / "b"))
    read = lambda epoch, step=0: list(minibatches.batches(minibatches.read(spark, str(tmp_path / "b"), epoch, step), ["a", "b"], "label"))
    epochs = [read(e) for e in (0, 1)]
    for got in epochs:
        assert [n for n, _, _ in got] == list(range(11)) and [len(y) for _, _, y in got] == [10] * 10 + [3]
        assert sorted(x for _, xs, _ in got for x in xs[:, 0]) == list(range(103))
        assert all(y[i] == x[i, 0] % 2 and np.isnan(x[i, 1]) == bool(x[i, 0] % 5) for _, x, y in got for i in range(len(y)))
    assert [x[:, 0].tolist() for _, x, _ in epochs[0]] != [x[:, 0].tolist() for _, x, _ in epochs[1]]
    rest = read(1, 7)
    assert [(n, x[:, 0].tolist()) for n, x, _ in rest] == [(n, x[:, 0].tolist()) for n, x, _ in epochs[1][7:]]
    assert minibatches.numbered(df, ["k"], 10, drop_last=True).count() == 100 and read(2) == []


def test_message_function_equals_the_parser(spark, sf):
    message_function.register(spark)
    odd = spark.createDataFrame([(None,), ("",), ("OBX|1|NM|8867-4||1.5e1\rOBX|2|ST|x^y||-\r\nOBX|3||||.5d\rOBX|4|NM|a||1_0",), ("\x0bMSH|^~\\&|||||||ADT|7\x1c\r",)], "message string")
    all_messages = messages(spark, sf).limit(200).unionByName(odd)
    all_messages.createOrReplaceTempView("feed")
    parsed = clinical_docs.parse_hl7(all_messages)
    wanted = parsed.select("control_id", "mrn", F.posexplode("obx").alias("k", "o")).select("control_id", "mrn", F.col("k") + 1, "o.code", "o.text", "o.value", "o.number")
    got = spark.sql("SELECT o.* FROM feed f, LATERAL parse_message(f.message) o")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r) for r in wanted.collect())))
    heads = spark.sql("SELECT h.* FROM feed f, LATERAL parse_message(f.message, 'header') h")
    wanted = parsed.filter("message is not null").select("message_type", "control_id", "mrn", "gender", F.size("obx"))
    assert sorted(map(str, (tuple(r) for r in heads.collect()))) == sorted(map(str, (tuple(r) for r in wanted.collect())))
    with pytest.raises(Exception, match="knows"):
        spark.sql("SELECT h.* FROM feed f, LATERAL parse_message(f.message, 'other') h")


def test_message_function_sends_rows_in_batches(spark, sf):
    message_function.register(spark)
    feed = messages(spark, sf).limit(20).unionByName(spark.createDataFrame([("OBX|1|NM|a^b||1|\r\n \nOBX\nMSH|^~\\&|\r\x1c\r",)], "message string"))
    feed.createOrReplaceTempView("batched")
    got = spark.sql("SELECT o.code, o.number FROM batched f, LATERAL parse_message(f.message) o")
    assert "BatchEvalPythonUDTF" in got._jdf.queryExecution().executedPlan().toString()  # an Arrow one makes a table for each message
    assert got.count() == 20 * 6 + 1 and got.filter("code = 'a'").first()["number"] == 1.0


def test_gate_and_next_action(spark):
    cases = list(itertools.product([True, False], [4999, 5000], [True, False], [True, False]))
    state = spark.createDataFrame(cases, "drifted boolean, samples int, busy boolean, shadow_running boolean")
    assert [tuple(r)[:4] for r in drift.should_retrain(state).filter("retrain").collect()] == [(True, 5000, False, False)]
    more = state.withColumns({"shadow_rows": F.lit(1000), "least_rows": F.lit(1000), "decision": F.lit("PROMOTE")})
    got = {tuple(r)[:4]: r["action"] for r in lifecycle.next_action(more).collect()}
    assert got[True, 5000, False, False] == "RETRAIN" and got[True, 4999, False, False] == "COLLECT" and got[False, 5000, False, False] == "NONE" and got[True, 5000, False, True] == "PROMOTE"
    waiting = lifecycle.next_action(more.withColumn("shadow_rows", F.lit(9)).filter("shadow_running")).select("action").distinct().collect()
    assert [r[0] for r in waiting] == ["WAIT"]


def test_latest_rows_are_merged_over_batches(spark, tmp_path):
    names = "patient_id long, p double, t long"
    stream = streamed(spark, tmp_path, "in", at(spark, [(1, 0.2, DAY), (2, 0.9, DAY + 50)], names), at(spark, [(1, 0.5, DAY + 60), (2, 0.1, DAY)], names))
    jobs.upsert_latest(stream, "patient_id", "ts", str(tmp_path / "latest"), str(tmp_path / "cp")).awaitTermination()
    got = registry.load(spark, str(tmp_path / "latest"), "patient_id long, p double, ts timestamp").collect()
    assert sorted((r["patient_id"], r["p"]) for r in got) == [(1, 0.5), (2, 0.9)]


def test_stays_end_after_a_gap(spark, tmp_path):
    names = "patient_id long, t long"
    stream = streamed(spark, tmp_path, "in", at(spark, [(1, DAY), (1, DAY + 3600), (1, DAY + 40_000)], names), at(spark, [(2, DAY + 400_000)], names))
    got = jobs.run_to_files(jobs.stays(stream, "ts", "patient_id"), str(tmp_path / "out"), "append").collect()
    assert sorted((r["patient_id"], r["start"].timestamp() - DAY, r["end"].timestamp() - DAY, r["n"]) for r in got) == [(1, 0, 3600 + 21_600, 2), (1, 40_000, 40_000 + 21_600, 1)]


def test_handlers_get_their_alerts_and_loops_their_rounds(spark, tmp_path):
    names = "severity string, t long"
    stream = streamed(spark, tmp_path, "in", at(spark, [("CRITICAL", DAY), ("WARNING", DAY + 1), ("WARNING", DAY + 2)], names))
    seen = {}
    take = lambda name: lambda rows: seen.update({name: rows.count()})
    jobs.notify(stream, {"CRITICAL": take("c"), "*": take("all"), "INFO": take("i")}, str(tmp_path / "cp")).awaitTermination()
    assert seen == {"c": 1, "all": 3}
    rounds = []

    def run(until):
        query = jobs.control_loop(spark, rounds.append, str(tmp_path / "loop"), 0.2)
        for _ in range(150):
            if len(rounds) >= until:
                break
            time.sleep(0.2)
        query.stop()

    run(2)
    before = len(rounds)
    run(before + 2)
    assert len(rounds) >= before + 2 and sorted(set(rounds)) == list(range(max(rounds) + 1))
