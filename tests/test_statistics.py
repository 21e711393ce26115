"""Paired tests, bootstrap intervals, percentiles and numbers by ranges, drift of constant columns, against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import drift, evaluation, features, impute, metrics, prefix, risk
from tidewell.plans import catalogue


def scored(spark, n=300, ties=20, seed=2):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = int(rng.random() < 0.35)
        rows.append((round(min(0.99, max(0.01, 0.3 * y + 0.6 * rng.random())) * ties) / ties, round(rng.random(), 2), y))
    return spark.createDataFrame(rows, "a double, b double, label int"), rows


def placements(rows, k):
    pos, neg = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    above = lambda x, y: 1.0 if x > y else 0.5 if x == y else 0.0
    return np.array([np.mean([above(p[k], n[k]) for n in neg]) for p in pos]), np.array([np.mean([above(p[k], n[k]) for p in pos]) for n in neg])


def test_paired_delong(spark):
    df, rows = scored(spark)
    (va, wa), (vb, wb) = placements(rows, 0), placements(rows, 1)
    se = np.sqrt(np.var(va - vb, ddof=1) / len(va) + np.var(wa - wb, ddof=1) / len(wa))
    got = metrics.paired_delong(df.unionByName(spark.createDataFrame([(None, 0.5, 1)], df.schema)), "a", "b").first()
    assert got["auroc_one"] == pytest.approx(va.mean(), abs=1e-6) and got["se"] == pytest.approx(se, abs=1e-6)
    assert got["z"] == pytest.approx((va.mean() - vb.mean()) / se, abs=1e-5) and 0 <= got["p_value"] < 0.01
    same = metrics.paired_delong(df.withColumn("c", F.col("a") * 2), "a", "c").first()
    assert (same["difference"], same["z"], same["p_value"]) == (0.0, None, None)
    few = metrics.paired_delong(df.filter("label = 0"), "a", "b").first()
    assert (few["auroc_one"], few["se"]) == (None, None)


def test_p_values_of_far_apart_scores_are_small(spark):
    zs = [0.0, 1.96, 3.5, 5.0, 8.0, 8.3, 13.0, 15.0, 20.0, 27.4, 60.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", F.round(2 * (1 - drift.normal_share(F.col("z"))), 6).alias("p"))
    assert {r["z"]: r["p"] for r in df.collect()} == {z: round(math.erfc(z / math.sqrt(2)), 6) for z in zs}
    rows = spark.range(9000).select((F.col("id") * 7919 % 1000 / 1000.0).alias("a"), (F.col("id") % 3 == 0).cast("int").alias("label")).withColumn("b", F.round(F.col("a") + F.col("label") * 0.3, 3))
    got = metrics.paired_delong(rows, "a", "b").first()
    assert got["z"] < -20 and got["p_value"] == 0.0


def test_bootstrap_of_average_precision_equals_a_plain_version(spark):
    df, rows = scored(spark)
    got = metrics.bootstrap_auprc(df.repartition(3), "a", replicates=60, seed=5).first()
    counts = {}
    for a, _, y in rows:
        counts.setdefault(a, [0, 0])[1 - y] += 1
    curves = []
    drawn = {s: (metrics.replicate_weights(s, True, p, 60, 5), metrics.replicate_weights(s, False, n, 60, 5)) for s, (p, n) in counts.items()}
    for k in range(60):
        tp = fp = area = 0.0
        total = sum(p[k] for p, _ in drawn.values())
        for s in sorted(drawn, reverse=True):
            p, n = drawn[s][0][k], drawn[s][1][k]
            tp, fp = tp + p, fp + n
            area += p / total * tp / max(tp + fp, 1)
        curves.append(area)
    assert (got["low"], got["high"]) == tuple(round(float(x), 6) for x in np.percentile(curves, [2.5, 97.5]))
    assert got["low"] < got["auprc"] < got["high"]


def test_percentiles_numbers_and_tiles_by_ranges(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, float("nan"), rng.randint(0, 5) * 1.0, rng.random()]), 7.0 if k % 3 else None) for k in range(501)]
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(5)
    points = {"p10": 0.1, "median": 0.5, "p99": 0.99}
    got = {r["feature"]: r for r in prefix.exact_percentiles(df, ["x", "y"], points).collect()}
    values = [r[1] for r in rows if r[1] is not None and r[1] == r[1]]
    assert all(got["x"][n] == pytest.approx(np.percentile(values, 100 * p), abs=1e-12) for n, p in points.items()) and got["y"]["p99"] == 7.0
    numbers = {r["k"]: (r["row"], r["rows"]) for r in prefix.row_numbers(df, ["k"]).collect()}
    assert numbers == {k: (k, 501) for k in range(501)}
    parts = [r["tile"] for r in prefix.tiles(df, ["k"], 4).orderBy("k").collect()]
    assert parts == [1] * 126 + [2] * 125 + [3] * 125 + [4] * 125
    assert [r["tile"] for r in prefix.tiles(df.limit(2), ["k"], 4).collect()] == [1, 2]
    both = df.filter("x is not null and not isnan(x)").groupBy(F.col("k") % 2, "x").agg(F.count("*").alias("n")).toDF("g", "x", "n")
    sums = prefix.running_sums_by(both, "g", "x", ["n"], descending=True).collect()
    for r in sums:
        own = [s["n"] for s in sums if s["g"] == r["g"] and s["x"] >= r["x"]]
        assert r["n_upto"] == sum(own) and r["n_all"] == sum(s["n"] for s in sums if s["g"] == r["g"])


def test_constant_and_empty_columns(spark):
    one = spark.createDataFrame([(5.0, None)] * 60, "x double, y double")
    assert [r["n"] for r in drift.histogram(one, "x").orderBy("bin").collect()] == [0] * 5 + [60] + [0] * 4
    live = spark.createDataFrame([(5.0, 1.0)] * 60 + [(5.3, None)] * 60, "x double, y double")
    got = {r["feature"]: r["psi"] for r in drift.psi(one, live, ["x", "y"]).collect()}
    assert got["x"] > 1 and got.get("y", 0.0) == 0.0
    assert drift.report(drift.psi(one, live, ["x"])).count() == 1 and sum(r["n"] for r in drift.histogram(one, "y").collect()) == 0
    none = risk.importance(spark.createDataFrame([(0.0, 0.0)], "a double, b double"), ["a", "b"]).collect()
    assert [(r["feature"], r["importance"], r["cumulative_share"]) for r in none] == [("a", 0.0, 0.0), ("b", 0.0, 0.0)]


def test_kolmogorov_verdict(spark):
    rng = np.random.default_rng(3)
    sample = lambda shift: spark.createDataFrame([(float(v),) for v in rng.normal(shift, 2.0, 400)], "x double")
    same, moved = drift.ks_against_normal(sample(10), "x", 10, 2).first(), drift.ks_against_normal(sample(11), "x", 10, 2).first()
    assert not same["drifted"] and same["p_value"] > 0.01 and moved["drifted"] and moved["p_value"] < 1e-4
    few = drift.ks_against_normal(sample(50).limit(60), "x", 10, 2).first()
    assert (few["statistic"], few["p_value"], few["drifted"]) == (0.0, 1.0, False)
    df = spark.createDataFrame([(-1.96,), (0.0,), (1.0,), (9.0,)], "z double").select(drift.normal_share(F.col("z")).alias("p"))
    assert [round(r["p"], 6) for r in df.collect()] == [0.024998, 0.5, 0.841345, 1.0]
    tail = spark.createDataFrame([(1.36, 1)], "d double, n int").select(drift.kolmogorov_tail(F.col("d"), F.col("n")).alias("p")).first()[0]
    assert tail == pytest.approx(0.0494859, abs=1e-6)


def test_no_task_holds_a_whole_column_or_group(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_tax").cast("double").alias("t"))
    plan = lambda d: d._jdf.queryExecution().toString()
    for out in (impute.fit_statistics(df, ["q", "t"]), evaluation.reference_stats(df, ["q"])):
        assert "percentile(" not in plan(out)
    rows = df.select(F.lit("m").alias("model"), F.col("t").alias("score"), (F.col("q") > 20).cast("long").alias("label"))
    window = [line for line in plan(evaluation.by_group(rows, "model")).split("\n") if "Window " in line and "windowspecdefinition(model#" in line]
    assert window and all("_spans" in line or "_before_" in line for line in window)  # over a row for each range, not for each score
    framed = plan(features.statistics(catalogue.panel_queries.panel(spark, sf), ["heart_rate"]))
    assert framed.split("== Physical Plan ==")[1].count("percentile(") <= 2  # one call in its window, once more where plans are listed


def test_sentinel_only_where_nulls_are(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    assert impute.fill_sentinel(df, ["a", "b"], only_with_nulls=True).columns == ["a", "b", "b_missing"]
    assert impute.fill_sentinel(df, ["a", "b"]).columns == ["a", "b", "a_missing", "b_missing"]
