from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewell.operators import features, lifecycle, metrics, ml
from tidewell.plans.oracle_text import SIGNALS
from tidewell.plans.panel_queries import panel


def scores(spark, n=400):
    rng = random.Random(3)
    rows = []
    for _ in range(n):
        y = int(rng.random() < 0.3)
        rows.append((min(0.99, max(0.01, 0.35 * y + rng.random() * 0.6)), rng.random() + y, y))
    return spark.createDataFrame(rows, "score double, x double, label int")


def test_calibration_lowers_the_error(spark):
    df = scores(spark)
    before = metrics.brier(df).first()[0]
    slope, intercept = ml.fit_platt(df, "score", "label")
    assert metrics.brier(ml.apply_platt(df, "score", slope, intercept), "calibrated").first()[0] < before
    assert metrics.brier(ml.apply_isotonic(df, ml.fit_isotonic(df, "score", "label"), "score"), "calibrated").first()[0] < before


def test_trees_and_stacking_separate(spark):
    df = ml.assemble(scores(spark), ["score", "x"])
    trees = ml.probability(ml.fit_trees(df, "label", trees=5, depth=3).transform(df), "tree_score")
    logistic = ml.fit_logistic(df, "label")
    assert metrics.auroc(trees, "tree_score").first()[0] > 0.8
    both = ml.ensemble(ml.probability(logistic.transform(trees), "lr_score"), ["tree_score", "lr_score"], [2, 1], "mean_score")
    assert metrics.auroc(both, "mean_score").first()[0] > 0.8
    means = df.agg(F.avg("score").alias("score"), F.avg("x").alias("x")).first().asDict()
    shown = ml.linear_attributions(df, ["score", "x"], list(logistic.coefficients), means)
    assert abs(shown.agg(F.avg("x_contribution")).first()[0]) < 1e-9


def test_version_lifecycle(spark):
    empty = spark.createDataFrame([], "version_id string, model_type string, created_at double, champion boolean, challenger boolean, retired boolean")
    r = lifecycle.create_version(lifecycle.create_version(empty, "a", "gbt", 1.0), "b", "gbt", 2.0)
    r = lifecycle.promote(r, "a")
    r = lifecycle.set_challenger(r, "b")
    assert lifecycle.pair(r).first().asDict() == {"champion_id": "a", "challenger_id": "b"}
    r = lifecycle.promote(r, "b")
    assert {x["version_id"]: (x["champion"], x["retired"]) for x in r.collect()} == {"a": (False, True), "b": (True, False)}
    r = lifecycle.roll_back(r)
    assert {x["version_id"]: (x["champion"], x["retired"]) for x in r.collect()} == {"a": (True, False), "b": (False, True)}
    assert lifecycle.discard_challenger(lifecycle.set_challenger(lifecycle.create_version(r, "c", "gbt", 3.0), "c")).filter("retired").count() == 2


def test_full_feature_set_takes_one_more_shuffle_than_the_panel(spark, sf):
    p = panel(spark, sf)
    out = features.full_set(p, SIGNALS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan
    assert out.count() == p.count() and len(out.columns) > 100
