"""Champion and challenger: promotion, versions and pruning, as functions of a registry table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import drift


def decide_promotion(pairs: DataFrame, least_gain: float = 0.005, least_rows: int = 1000) -> DataFrame:
    """``pairs``: champion_auroc, challenger_auroc, champion_auprc, challenger_auprc, n."""
    gain = F.round(F.col("challenger_auroc") - F.col("champion_auroc"), 9)
    other = F.round(F.col("challenger_auprc") - F.col("champion_auprc"), 9)
    decision = F.when(F.col("n") < least_rows, "INSUFFICIENT_DATA").when((gain >= least_gain) & (other >= 0), "PROMOTE").otherwise("REJECT")
    return pairs.withColumns({"auroc_gain": gain, "auprc_gain": other, "decision": decision})


def promote(registry: DataFrame, version: str) -> DataFrame:
    """``version`` becomes the champion; the old champion is retired."""
    new = F.col("version_id") == version
    return registry.withColumns({"retired": F.col("retired") | (F.col("champion") & ~new), "champion": new, "challenger": F.col("challenger") & ~new})


def prune(registry: DataFrame, most: int = 10) -> DataFrame:
    """The registry without the oldest retired versions beyond ``most`` in all."""
    age = F.row_number().over(Window.partitionBy("retired").orderBy("created_at", "version_id"))
    excess = F.greatest(F.count("*").over(Window.partitionBy()) - most, F.lit(0))
    ranked = registry.withColumns({"_age": age, "_excess": excess})
    return ranked.filter(~F.col("retired") | (F.col("_age") > F.col("_excess"))).drop("_age", "_excess")


def backfill_outcomes(predictions: DataFrame, outcomes: DataFrame, key: str = "patient_id") -> DataFrame:
    """Open predictions take their entity's outcome."""
    joined = predictions.join(outcomes.select(key, F.col("outcome").alias("_o")), key, "left")
    return joined.withColumn("actual_outcome", F.coalesce("actual_outcome", "_o")).drop("_o")


def next_action(state: DataFrame, least: int = 5000) -> DataFrame:
    """``state`` with ``action``, what a round of the control loop does: a finished shadow run is decided on, and only without one is
    retraining looked at. ``state``: drifted, samples, busy, shadow_running, shadow_rows, least_rows, decision.
    """
    done = F.col("shadow_rows") >= F.col("least_rows")
    shadow = F.when(~done, "WAIT").when(F.col("decision") == "PROMOTE", "PROMOTE").otherwise("DISCARD")
    retrain = F.when(F.col("retrain"), "RETRAIN").when(F.col("drifted") & (F.col("samples") < least), "COLLECT").otherwise("NONE")
    return drift.should_retrain(state, least).withColumn("action", F.when(F.col("shadow_running"), shadow).otherwise(retrain)).drop("retrain")


def create_version(registry: DataFrame, version: str, model_type: str, created_at: float) -> DataFrame:
    """``registry`` and a new version without a role."""
    new = registry.sparkSession.createDataFrame([(version, model_type, created_at, False, False, False)], "version_id string, model_type string, created_at double, champion boolean, challenger boolean, retired boolean")
    return registry.unionByName(new, allowMissingColumns=True)


def set_challenger(registry: DataFrame, version: str) -> DataFrame:
    return registry.withColumn("challenger", (F.col("version_id") == version) & ~F.col("champion") & ~F.col("retired"))


def discard_challenger(registry: DataFrame) -> DataFrame:
    return registry.withColumns({"retired": F.col("retired") | F.col("challenger"), "challenger": F.lit(False)})


def roll_back(registry: DataFrame) -> DataFrame:
    """The newest retired version becomes the champion again; the present one is retired. Without one nothing changes."""
    newest = registry.filter("retired").agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("_back"))
    joined = registry.crossJoin(F.broadcast(newest))  # one row
    back, some = F.col("version_id") == F.col("_back"), F.col("_back").isNotNull()
    changed = {"retired": F.when(some & F.col("champion"), True).when(some & back, False).otherwise(F.col("retired")), "champion": F.when(some, F.coalesce(back, F.lit(False))).otherwise(F.col("champion"))}
    return joined.withColumns(changed).drop("_back")


def pair(registry: DataFrame) -> DataFrame:
    """Champion and challenger side by side."""
    live = registry.filter("not retired")
    champion = live.filter("champion").select(F.col("version_id").alias("champion_id")).limit(1)
    return champion.crossJoin(live.filter("challenger").select(F.col("version_id").alias("challenger_id")).limit(1))
