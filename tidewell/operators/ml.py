"""Adapters to MLlib: boosted trees, stacking, calibration and linear attributions."""

from __future__ import annotations

import random

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    """A feature vector in fixed order; nulls count as 0."""
    return VectorAssembler(inputCols=features, outputCol=output).transform(df.fillna(0.0, features))


#: The elements of a request's vector, in order.
REQUEST_ORDER = ("heart_rate", "respiratory_rate", "spo2_pct", "temperature_c", "systolic_bp", "diastolic_bp", "oxygen_flow", "mobility_score", "nurse_alert", "wbc_count", "lactate", "creatinine", "crp_level", "hemoglobin", "sepsis_risk_score")


def request_vector(df: DataFrame, output: str = "vector") -> DataFrame:
    """``df`` with its fifteen elements as single-precision numbers; null stays null."""
    return df.withColumn(output, F.array(*[F.col(c).cast("float") for c in REQUEST_ORDER]))


def probability(scored: DataFrame, name: str = "score") -> DataFrame:
    return scored.withColumn(name, F.element_at(vector_to_array("probability"), 2)).drop("probability", "rawPrediction", "prediction")


def fit_trees(df: DataFrame, label: str, weight: str | None = None, trees: int = 50, depth: int = 5):
    """Gradient-boosted trees on assembled ``features``."""
    model = GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.05, seed=42)
    return (model.setWeightCol(weight) if weight else model).fit(df)


def fit_logistic(df: DataFrame, label: str, c: float = 1.0):
    """L2-penalised logistic regression; MLlib averages the loss over the rows, so the penalty is divided by their number."""
    n = df.count()
    return LogisticRegression(labelCol=label, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=100).fit(df)


def log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.ln(q / (1 - q))


def fit_platt(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """Slope and intercept of the calibrated log odds."""
    rows = assemble(df.select(log_odds(F.col(score)).alias("_z"), F.col(label).cast("double").alias(label)), ["_z"])
    model = LogisticRegression(labelCol=label, maxIter=100).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def apply_platt(df: DataFrame, score: str, slope: float, intercept: float, output: str = "calibrated") -> DataFrame:
    return df.withColumn(output, 1 / (1 + F.exp(-(slope * log_odds(F.col(score)) + intercept))))


def fit_isotonic(df: DataFrame, score: str, label: str):
    rows = df.select(F.col(score).alias("features"), F.col(label).cast("double").alias("label"))
    return IsotonicRegression(featuresCol="features", labelCol="label").fit(rows)


def apply_isotonic(df: DataFrame, model, score: str, output: str = "calibrated") -> DataFrame:
    out = model.setFeaturesCol(score).setPredictionCol(output).transform(df)
    return out.withColumn(output, F.least(F.greatest(output, F.lit(0.0)), F.lit(1.0)))


def linear_attributions(df: DataFrame, features: list[str], coefficients: list[float], means: dict[str, float]) -> DataFrame:
    """Exact contributions of a linear model: coefficient times distance from the mean."""
    return df.withColumns({f"{c}_contribution": F.lit(float(w)) * (F.coalesce(F.col(c), F.lit(0.0)) - float(means[c])) for c, w in zip(features, coefficients)})


def ensemble(df: DataFrame, scores: list[str], weights: list[float] | None = None, output: str = "score") -> DataFrame:
    """Weighted mean of score columns; equal weights by default (pass AUROCs to weight by rank quality)."""
    w = weights or [1.0] * len(scores)
    return df.withColumn(output, sum((F.col(c) * float(k) for c, k in zip(scores, w)), F.lit(0.0)) / float(sum(w)))


def feature_columns(df: DataFrame, label: str, leave_out: tuple[str, ...] = ("patient_id", "hour_from_admission", "split")) -> list[str]:
    """Numeric columns that aren't the label, another outcome, or an id, in the table's order."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, kind in df.dtypes if kind in numeric and c != label and c not in leave_out and "_next_" not in c]


def search(df: DataFrame, label: str, trials: int = 20, seed: int = 42, trees: int = 20, ratio: float = 0.75):
    """``(best model, [(setting, area under the ROC curve)])`` of boosted trees on assembled ``features``.

    Settings are drawn at random from fixed ranges, as a search without a model of its own does; each is fitted on the same part of
    the rows and judged on the rest. Nothing is pruned; :mod:`tidewell.operators.boosting` has a search that stops trials early.
    """
    rng = random.Random(seed)
    trees_of = GBTClassifier(labelCol=label, maxIter=trees, seed=seed)
    settings = [
        {trees_of.maxDepth: rng.randint(3, 10), trees_of.stepSize: 0.01 * 30 ** rng.random(), trees_of.subsamplingRate: rng.uniform(0.6, 1.0), trees_of.minInstancesPerNode: rng.randint(1, 10)}
        for _ in range(trials)
    ]
    judge = BinaryClassificationEvaluator(labelCol=label)
    fitted = TrainValidationSplit(estimator=trees_of, estimatorParamMaps=settings, evaluator=judge, trainRatio=ratio, parallelism=2, seed=seed).fit(df)
    return fitted.bestModel, [({p.name: v for p, v in s.items()}, m) for s, m in zip(settings, fitted.validationMetrics)]
