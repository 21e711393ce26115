"""Shapley values against enumeration over subsets, boosting that goes on, and a search that stops trials."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidewell.operators import attributions, boosting, metrics, ml

FEATURES = [f"f{k}" for k in range(6)]


def rows(spark, n=240, seed=8):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = [round(rng.gauss(0, 1), 2) for _ in FEATURES]
        out.append((*x, int(x[0] + 0.8 * x[1] * x[2] + 0.5 * x[3] + rng.gauss(0, 0.4) > 0)))
    return ml.assemble(spark.createDataFrame(out, ", ".join(f"{f} double" for f in FEATURES) + ", label int"), FEATURES)


def known(tree, k, x, s):
    """What the tree says where only the features in ``s`` are known."""
    node = tree[k]
    if node["left"] < 0:
        return node["value"]
    if node["feature"] in s:
        return known(tree, node["left"] if x[node["feature"]] <= node["threshold"] else node["right"], x, s)
    return sum(tree[c]["cover"] / node["cover"] * known(tree, c, x, s) for c in (node["left"], node["right"]))


def test_shapley_values_equal_enumeration(spark):
    df = rows(spark).limit(240)
    model = ml.fit_trees(df, "label", trees=4, depth=4)
    nodes = attributions.node_table(model)
    table = nodes.collect()
    trees = [{r["id"]: r for r in table if r["tree"] == t} for t in {r["tree"] for r in table}]
    found = attributions.leaves(nodes)
    shown = attributions.attribute(df, found, F.col("features")).select(*FEATURES, "attributions").limit(12).collect()
    everything = [s for n in range(7) for s in itertools.combinations(range(6), n)]
    for r in shown:
        x = [r[f] for f in FEATURES]
        worth = {s: sum(known(t, 0, x, s) for t in trees) for s in everything}
        for j in range(6):
            want = sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / 720 * (worth[tuple(sorted((*s, j)))] - worth[s]) for s in everything if j not in s)
            assert abs(r["attributions"][j] - want) < 1e-9
        assert abs(sum(r["attributions"]) - (worth[tuple(range(6))] - worth[()])) < 1e-9
    assert abs(attributions.mean_score(found) - sum(known(t, 0, [0] * 6, ()) for t in trees)) < 1e-9
    margins = {tuple(r[f] for f in FEATURES): r["rawPrediction"][1] / 2 for r in model.transform(df).collect()}
    x = np.array(list(margins))
    assert np.allclose(attributions.scores(found, x), list(margins.values())) or np.allclose(attributions.scores(found, x), 2 * np.array(list(margins.values())))
    ranked = {r["feature"]: r["mean_abs"] for r in attributions.importance(attributions.attribute(df, found, F.col("features")), FEATURES).collect()}
    assert max(ranked, key=ranked.get) == "f0" and len(ranked) == 6


def test_attributions_of_columns_with_nulls_and_of_a_stump(spark):
    nodes = spark.createDataFrame([(0, 0, 1, 5.0, 1, 2, 10.0, 0.0), (0, 1, -1, None, -1, -1, 6.0, 1.0), (0, 2, -1, None, -1, -1, 4.0, 2.0), (1, 0, -1, None, -1, -1, 10.0, 7.0)], attributions.NODES)
    df = spark.createDataFrame([(1.0, None), (1.0, float("nan")), (None, 6.0)], "a double, b double")
    got = [r["attributions"] for r in attributions.attribute(df.repartition(2), attributions.leaves(nodes), ["a", "b"]).orderBy("b").collect()]
    assert sorted(round(g[1], 9) for g in got) == [-0.4, -0.4, 0.6] and all(g[0] == 0 for g in got)
    assert attributions.attribute(df.limit(0), attributions.leaves(nodes), ["a", "b"]).count() == 0


def test_boosting_goes_on_from_a_saved_model(spark, tmp_path):
    df = rows(spark).repartition(2).cache()
    start = boosting.begin(df, "label", 0.3)
    at_once, _ = boosting.grow(start, start.margins(df), "label", 4, depth=3)
    first, _ = boosting.grow(start, start.margins(df), "label", 2, depth=3)
    first.save(str(tmp_path / "m"))
    again = boosting.Boosted.load(str(tmp_path / "m"))
    more, scored = boosting.grow(again, again.margins(df), "label", 2, depth=3)
    more.save(str(tmp_path / "m"))
    both = boosting.Boosted.load(str(tmp_path / "m"))
    assert len(both.trees) == 4
    a, b = (m.score(df.select("f0", "features", "label"), n) for m, n in ((at_once, "x"), (both, "y")))
    apart = both.score(a, "y").agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0]
    assert apart < 1e-12 and metrics.auroc(b, "y").first()[0] > 0.9


def test_trials_below_the_median_stop_and_the_best_stays(spark, tmp_path):
    df = rows(spark, 400).repartition(2).cache()
    tried = [{"depth": d, "step": s, "part": 1.0, "least": n} for d, s, n in ((3, 0.3, 1), (2, 0.2, 5), (1, 0.01, 90), (4, 0.3, 2), (1, 0.01, 120))]
    run = lambda name, prune: boosting.search(df, "label", str(tmp_path / name), tried, [1, 2, 4], startup=2, warmup=1, prune=prune)
    model, trials = run("pruned", True)
    _, whole = run("whole", False)
    best = lambda ts: max((t for t in ts if not t.pruned), key=lambda t: t.values[-1]).number
    assert [t.pruned for t in trials][:2] == [False, False] and any(t.pruned for t in trials)
    assert all(t.trees == 2 for t in trials if t.pruned) and sum(t.trees for t in trials) < sum(t.trees for t in whole)
    assert best(trials) == best(whole) and len(model.trees) == 4
    again = boosting.search(df, "label", str(tmp_path / "pruned"), tried, [1, 2, 4], startup=2, warmup=1)[1]
    assert [t.values for t in again] == [t.values for t in trials]  # nothing was fitted anew
    assert boosting.below_median(1.0, []) is False and boosting.below_median(1.0, [1.0, 2.0]) is True
    assert len(boosting.settings(3, 1)) == 3
