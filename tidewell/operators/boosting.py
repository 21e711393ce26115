"""Boosting in stages, and a search that stops trials below the median.

A model is a start value and a list of regression trees; each tree is fitted to the gradient of the logistic loss at the margins so far,
which travel with the rows. So fitting can go on from a model that was saved, tree by tree, and a search pays for the trees it
looks at: trials are judged at rungs, and one that is below the median of the earlier trials at the same rung stops there.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass, field

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.checkpoints import cut
from tidewell.operators import metrics

MARGIN = "_margin"


@dataclass
class Boosted:
    """Trees for the margin, half the log odds."""

    start: float
    step: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)

    def margins(self, df: DataFrame, after: int = 0) -> DataFrame:
        """``df`` with the margin; ``after`` trees are in its margin column already."""
        out = df if after else df.withColumn(MARGIN, F.lit(self.start))
        for tree in self.trees[after:]:
            out = tree.transform(out).withColumn(MARGIN, F.col(MARGIN) + self.step * F.col("prediction")).drop("prediction")
        return out

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        return self.margins(df).withColumn(name, probability()).drop(MARGIN)

    def save(self, path: str) -> None:
        """Trees that are there already stay as they are, so a model that has grown adds what is new."""
        spark = _session()
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for k, tree in enumerate(self.trees):
            if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tree={k}/metadata/_SUCCESS")):
                tree.write().overwrite().save(f"{path}/tree={k}")
        spark.createDataFrame([(self.start, self.step, len(self.trees))], "start double, step double, trees int").coalesce(1).write.mode("overwrite").json(f"{path}/model")

    @staticmethod
    def load(path: str) -> Boosted:
        head = _session().read.schema("start double, step double, trees int").json(f"{path}/model").first()
        return Boosted(head["start"], head["step"], [DecisionTreeRegressionModel.load(f"{path}/tree={k}") for k in range(head["trees"])])


def _session() -> SparkSession:
    return SparkSession.getActiveSession()


def probability() -> Column:
    return 1 / (1 + F.exp(-2 * F.col(MARGIN)))


def begin(df: DataFrame, label: str, step: float) -> Boosted:
    """A model without trees: half the log odds of the label."""
    row = df.agg(F.sum(F.col(label).cast("double")), F.count(label)).first()
    rate = min(max((row[0] or 0.0) / max(row[1], 1), 1e-6), 1 - 1e-6)
    return Boosted(0.5 * math.log(rate / (1 - rate)), step)


def grow(model: Boosted, rows: DataFrame, label: str, trees: int, depth: int = 5, least: int = 1, part: float = 1.0, seed: int = 42, train: Column | None = None) -> tuple[Boosted, DataFrame]:
    """The model with ``trees`` more, and ``rows`` with its margin. ``rows`` have the margin of the model as it is, and ``features``.

    Only rows that meet ``train`` are fitted, each tree on a ``part`` of them; all get margins.
    """
    model = Boosted(model.start, model.step, list(model.trees))
    sign = 2.0 * F.col(label).cast("double") - 1.0
    for _ in range(trees):
        k = len(model.trees)
        gradient = 2 * sign / (1 + F.exp(2 * sign * F.col(MARGIN)))
        fitted = rows.filter(train) if train is not None else rows
        fitted = fitted.sample(part, seed + k) if part < 1 else fitted
        tree = DecisionTreeRegressor(labelCol="_gradient", maxDepth=depth, minInstancesPerNode=least, seed=seed + k)
        model.trees.append(tree.fit(fitted.select("features", gradient.alias("_gradient"))))
        rows = cut(model.margins(rows, k))
    return model, rows


def settings(trials: int, seed: int) -> list[dict]:
    """Settings drawn from the ranges of the search."""
    rng = random.Random(seed)
    return [{"depth": rng.randint(3, 10), "step": 0.01 * 30 ** rng.random(), "part": rng.uniform(0.6, 1.0), "least": rng.randint(1, 10)} for _ in range(trials)]


@dataclass
class Trial:
    number: int
    setting: dict
    values: list[float] = field(default_factory=list)
    pruned: bool = False
    trees: int = 0


def below_median(value: float, earlier: list[float]) -> bool:
    """Whether a value is below the median of the earlier trials' values; without any it isn't."""
    ordered, n = sorted(earlier), len(earlier)
    return bool(n) and value < (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def search(df: DataFrame, label: str, folder: str, tried: list[dict], rungs: list[int], ratio: float = 0.75, startup: int = 5, warmup: int = 1, prune: bool = True, seed: int = 42) -> tuple[Boosted, list[Trial]]:
    """The best trial's model, and all trials with their areas under the ROC curve at each rung (numbers of trees, rising).

    The first ``startup`` trials and a trial's first ``warmup`` rungs are never stopped. Each rung's model and value are saved in
    ``folder``; a search that was cut off and is started again goes on from there.
    """
    fold = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(1000)) < int(1000 * ratio)
    rows = cut(df.filter(F.col(label).isNotNull()).withColumn("_train", fold))
    trials: list[Trial] = []
    for number, setting in enumerate(tried):
        trial, model, state = Trial(number, setting), None, None
        for k, size in enumerate(rungs):
            path = f"{folder}/trial={number}"
            value = _saved(f"{path}/rung={k}")
            if value is None:
                if model is None:
                    model = Boosted.load(path) if k else begin(rows.filter("_train"), label, setting["step"])
                    model.trees = model.trees[: rungs[k - 1] if k else 0]
                    state = cut(model.margins(rows))
                model, state = grow(model, state, label, size - len(model.trees), setting["depth"], setting["least"], setting["part"], seed, F.col("_train"))
                model.save(path)
                judged = state.filter("not _train").withColumn("score", probability())
                value = metrics.auroc(judged, "score", label).first()[0] or 0.0
                _session().createDataFrame([(float(value), json.dumps(setting))], "value double, setting string").coalesce(1).write.mode("overwrite").json(f"{path}/rung={k}")
            trial.values.append(value)
            trial.trees = size
            earlier = [t.values[k] for t in trials if len(t.values) > k]
            if prune and number >= startup and k >= warmup and k + 1 < len(rungs) and below_median(value, earlier):
                trial.pruned = True
                break
        trials.append(trial)
    best = max((t for t in trials if not t.pruned), key=lambda t: t.values[-1])
    return Boosted.load(f"{folder}/trial={best.number}"), trials


def _saved(path: str) -> float | None:
    spark = _session()
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("value double").json(path).first()["value"]
