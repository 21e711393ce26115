"""Exact Shapley values of tree ensembles, path-dependent: what a path doesn't know is averaged by the training rows that went each way.

A leaf's share in a prediction is its value times a product over the features on its path: 1 or 0 for a known feature (the row meets
all of the path's tests of it or not), the part of the training rows that met them for an unknown one. In such a product game a
feature's Shapley value is the integral over t from 0 to 1 of the others' product, each at ``known * t + part * (1 - t)``, times the
difference its own knowledge makes. The integrand is a polynomial, so a Gauss-Legendre rule of half its degree is exact.

The model is a table of nodes. Its leaves, no more than the ensemble has, are broadcast as arrays; rows go through in Arrow batches.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.checkpoints import shared_folder

NODES = "tree int, id int, feature int, threshold double, left int, right int, cover double, value double"
#: Numbers of a batch's working array that are in memory at once.
NUMBERS = 1 << 21


def node_table(model) -> DataFrame:
    """``NODES`` of a fitted tree model (one tree or an ensemble of regression trees), values by their trees' weights; saved and read again."""
    spark = SparkSession.getActiveSession()
    path = f"{shared_folder(spark)}/models/{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "_m", "weight").select("tree", "weight")
        rows = data.select(F.col("treeID").alias("tree"), "nodeData.*").join(F.broadcast(weights), "tree")
    else:
        rows = data.select(F.lit(0).alias("tree"), "*", F.lit(1.0).alias("weight"))
    if rows.filter("split.numCategories > 0").limit(1).count():
        raise ValueError("categorical splits aren't read")
    threshold = F.get("split.leftCategoriesOrThreshold", F.lit(0))
    return rows.select("tree", "id", F.col("split.featureIndex").alias("feature"), threshold.alias("threshold"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("rawCount").cast("double").alias("cover"), (F.col("prediction") * F.col("weight")).alias("value"))


@dataclass
class Leaves:
    """Leaves whose paths test ``d`` features: their numbers, bounds (low, high] and parts of the rows, of shape (leaves, d)."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    part: np.ndarray
    value: np.ndarray


def leaves(nodes: DataFrame) -> list[Leaves]:
    """The model's leaves by the number of features on their paths. Tests of one feature are one interval."""
    trees: dict[int, dict[int, object]] = defaultdict(dict)
    for r in nodes.collect():  # the model, not data
        trees[r["tree"]][r["id"]] = r
    found = defaultdict(list)
    for tree in trees.values():
        children = {c for r in tree.values() if r["left"] >= 0 for c in (r["left"], r["right"])}
        stack = [(next(k for k in tree if k not in children), {})]
        while stack:
            k, bounds = stack.pop()
            node = tree[k]
            if node["left"] < 0:
                found[len(bounds)].append((bounds, node["value"]))
                continue
            f, at = node["feature"], node["threshold"]
            low, high, part = bounds.get(f, (-np.inf, np.inf, 1.0))
            for child, interval in ((node["left"], (low, min(high, at))), (node["right"], (max(low, at), high))):
                share = tree[child]["cover"] / node["cover"] if node["cover"] else 0.0
                stack.append((child, bounds | {f: (*interval, part * share)}))
    out = []
    for d, group in sorted(found.items()):
        of = np.array([[(f, *b) for f, b in sorted(bounds.items())] for bounds, _ in group], float).reshape(len(group), d, 4)
        out.append(Leaves(of[..., 0].astype(int), of[..., 1], of[..., 2], of[..., 3], np.array([v for _, v in group])))
    return out


def mean_score(model: list[Leaves]) -> float:
    """What the model says where nothing is known."""
    return float(sum((g.value * g.part.prod(axis=1)).sum() for g in model))


def scores(model: list[Leaves], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for g in model:
        step = max(1, NUMBERS // max(1, g.feature.size))
        for a in range(0, len(x), step):
            v = x[a : a + step][:, g.feature]
            out[a : a + step] += ((v > g.low) & (v <= g.high)).all(axis=2) @ g.value
    return out


def shapley(model: list[Leaves], x: np.ndarray) -> np.ndarray:
    """A value for each row and feature; a row's values add up to its score less the mean."""
    out = np.zeros(x.shape)
    for g in model:
        d = g.feature.shape[1]
        if not d:
            continue
        at, weight = np.polynomial.legendre.leggauss((d + 1) // 2)
        at, weight = (at + 1) / 2, weight / 2
        step = max(1, NUMBERS // (len(g.value) * d * len(at)))
        to = np.zeros((len(g.value) * d, x.shape[1]))
        to[np.arange(to.shape[0]), g.feature.ravel()] = 1
        for a in range(0, len(x), step):
            v = x[a : a + step][:, g.feature]
            known = ((v > g.low) & (v <= g.high)).astype(float)
            factor = known[..., None] * at + g.part[..., None] * (1 - at)
            others = np.ones_like(factor)  # the product of all features but one, from both sides
            for j in range(1, d):
                others[:, :, j] = others[:, :, j - 1] * factor[:, :, j - 1]
            behind = np.ones_like(factor[:, :, 0])
            for j in range(d - 2, -1, -1):
                behind = behind * factor[:, :, j + 1]
                others[:, :, j] *= behind
            share = (known - g.part) * (others @ weight) * g.value[:, None]
            out[a : a + step] += share.reshape(len(share), -1) @ to
    return out


def _vector(df: DataFrame, features: Column | list[str]) -> Column:
    """The features as an array; batches of them are bounded in bytes where the session sets no bound of its own."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(bound, None) is None:
        df.sparkSession.conf.set(bound, str(4 << 20))
    if isinstance(features, list):
        return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features])
    return vector_to_array(features)


def score(df: DataFrame, model: list[Leaves], features: Column | list[str], output: str = "margin") -> DataFrame:
    """``df`` with the model's score of each row: an iterator function, to which the model comes once for each worker."""
    vector = _vector(df, features)
    spread = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        leaves_of = spread.value
        for rows in batches:
            yield pd.Series(scores(leaves_of, np.stack(rows.to_numpy())) if len(rows) else [], index=rows.index, dtype=float)

    return df.withColumn(output, values(vector))


def attribute(df: DataFrame, model: list[Leaves], features: Column | list[str], output: str = "attributions") -> DataFrame:
    """``df`` with an array of each row's Shapley values. ``features`` is a vector column or names of columns; null and NaN count as 0."""
    vector = _vector(df, features)
    spread = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        leaves_of = spread.value
        for rows in batches:
            yield pd.Series(list(shapley(leaves_of, np.stack(rows.to_numpy()))) if len(rows) else [], index=rows.index, dtype=object)

    return df.withColumn(output, values(vector))


def importance(attributed: DataFrame, names: list[str], column: str = "attributions") -> DataFrame:
    """``feature, mean_abs``: each feature's mean absolute Shapley value, one partial aggregate of as many numbers as features."""
    means = attributed.agg(*[F.avg(F.abs(F.element_at(column, k + 1))).alias(f"f{k}") for k in range(len(names))])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"f{k}").alias("mean_abs")) for k, n in enumerate(names)])
    return means.select(F.inline(pairs))
