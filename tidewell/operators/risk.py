"""Risk bands, rule-based outcome scores, watch-lists and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ["CRITICAL", "HIGH", "MODERATE", "LOW"]


def band(p: Column) -> Column:
    return F.when(p >= 0.75, "CRITICAL").when(p >= 0.5, "HIGH").when(p >= 0.25, "MODERATE").otherwise("LOW")


def truncated_score(p: Column) -> Column:
    return (p * 100).cast("int")


def rounded_score(p: Column) -> Column:
    return F.bround(p * 100, 0).cast("int")


#: Outcomes in the order that settles equal scores.
OUTCOMES = ("deterioration_next_12h", "sepsis_next_6h", "cardiac_arrest_next_12h", "respiratory_failure_next_12h")

# Steps of the rule-based scores. A base, the least and largest score, and steps of (condition, points); of a
# tuple of conditions the first that is met counts. ``shock_index`` is the heart rate over the systolic pressure, 1 at least.
STEPS = {
    "deterioration_next_12h": (
        0.05, 0.01, 0.99,
        ((("heart_rate > 105 OR heart_rate < 50", 0.20),), (("respiratory_rate > 24 OR respiratory_rate < 10", 0.20),), (("spo2_pct < 92", 0.25),), (("systolic_bp < 95 OR systolic_bp > 170", 0.15),), (("lactate > 2.0", 0.15),)),
    ),
    "sepsis_next_6h": (
        0.05, 0.01, 0.99,
        ((("lactate > 2.0", 0.15),), (("temperature_c >= 38.3 OR temperature_c <= 36.0", 0.10),), (("wbc_count > 12.0 OR wbc_count < 4.0", 0.10),), (("deterioration_next_12h > 0.60", 0.10),)),
    ),
    "cardiac_arrest_next_12h": (
        0.02, 0.005, 0.98,
        ((("heart_rate < 40 OR heart_rate > 150", 0.45), ("heart_rate < 50 OR heart_rate > 130", 0.15)), (("systolic_bp < 75", 0.35), ("systolic_bp < 90", 0.15)), (("shock_index > 1.2", 0.15),), (("deterioration_next_12h > 0.70", 0.10),)),
    ),
    "respiratory_failure_next_12h": (
        0.04, 0.01, 0.99,
        ((("spo2_pct < 88.0", 0.50), ("spo2_pct < 92.0", 0.25)), (("respiratory_rate >= 28.0", 0.25), ("respiratory_rate >= 24.0", 0.10)), (("oxygen_flow >= 6.0", 0.20),)),
    ),
}
#: Points of sepsis for the full sepsis risk score and for all three qSOFA signs.
SEPSIS_RISK, SEPSIS_QSOFA = 0.35, 0.15
QSOFA = ("respiratory_rate >= 22", "systolic_bp <= 100", "mobility_score <= 1")


def _met(condition: str) -> Column:
    return F.coalesce(F.expr(condition), F.lit(False))


def outcome_scores(df: DataFrame) -> DataFrame:
    """``df`` with a rule-based probability for each of four outcomes.

    A model's ``deterioration_next_12h`` is used if the column is there, within its limits; else its rules stand in. Signals
    that are missing, and comparisons with null, count as not met; a null sepsis risk counts as 0.
    """
    given = "deterioration_next_12h" in df.columns
    needed = ("heart_rate", "respiratory_rate", "spo2_pct", "systolic_bp", "temperature_c", "lactate", "wbc_count", "oxygen_flow", "mobility_score", "sepsis_risk_score")
    out = df.withColumns({c: F.lit(None).cast("double") for c in needed if c not in df.columns})
    out = out.withColumn("shock_index", F.when(F.col("systolic_bp").isNotNull(), F.col("heart_rate") / F.greatest("systolic_bp", F.lit(1.0))))
    for name, (base, low, high, steps) in STEPS.items():
        score = F.lit(base)
        if name == "sepsis_next_6h":
            signs = sum((_met(q).cast("int") for q in QSOFA), F.lit(0))
            score = score + SEPSIS_RISK * F.coalesce("sepsis_risk_score", F.lit(0.0)) + SEPSIS_QSOFA * (signs / 3.0)
        for step in steps:
            points = F.lit(0.0)
            for condition, value in reversed(step):
                points = F.when(_met(condition), value).otherwise(points)
            score = score + points
        if name == "deterioration_next_12h" and given:
            score = F.col(name)
        out = out.withColumn(name, F.greatest(F.least(score, F.lit(high)), F.lit(low)))
    return out.select(*[c for c in df.columns if c not in OUTCOMES], *OUTCOMES)


#: Outcome weights for the primary concern; of equals the earlier wins.
WEIGHTS = {"deterioration_next_12h": 1.0, "sepsis_next_6h": 1.1, "cardiac_arrest_next_12h": 1.2, "respiratory_failure_next_12h": 1.0}


def primary_concern(df: DataFrame) -> DataFrame:
    """``df`` with the outcome of the largest weighted score; scores are rounded to whole points first."""
    pairs = F.array(*[F.struct((rounded_score(F.col(n)) * F.lit(WEIGHTS[n])).alias("w"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(OUTCOMES)])
    return df.withColumn("primary_concern", F.array_max(pairs)["n"])


# Alert texts by outcome, in the order they are told, and the text without any.
ALERT_TEXTS = {
    "cardiac_arrest_next_12h": "\U0001f6a8 CARDIAC ALERT: Severe hemodynamic collapse / arrhythmia risk — verify telemetry & crash cart",
    "sepsis_next_6h": "⚠️ SEPSIS ALERT: High 6-hour sepsis risk — execute SEP-1 bundle (blood cultures, lactate, antibiotics)",
    "respiratory_failure_next_12h": "\U0001fac1 RESPIRATORY ALERT: Acute decompensation risk — assess airway & consider escalation of O2/NIV support",
    "deterioration_next_12h": "\U0001f534 DETERIORATION ALERT: High deterioration probability within 12h — intensify monitoring to q15min",
}
ALL_CLEAR = "\U0001f7e2 All predicted clinical outcomes within acceptable risk thresholds"


def alert_texts(df: DataFrame) -> DataFrame:
    """``df`` with ``alerts``: a text for each outcome whose level is high or critical."""
    told = F.array_compact(F.array(*[F.when(F.col(n) >= 0.5, F.lit(t)) for n, t in ALERT_TEXTS.items()]))
    return df.withColumn("alerts", F.when(F.size(told) > 0, told).otherwise(F.array(F.lit(ALL_CLEAR))))


#: Change of risk for each unit that a vital rises.
EFFECTS = {"systolic_bp": 0.003, "heart_rate": 0.002, "lactate": 0.06, "spo2_pct": -0.015}


def what_if(df: DataFrame, base: str, effects: dict[str, float] = EFFECTS) -> DataFrame:
    """The base risk moved by linear effects of changed vitals (``{vital}_new``, null: unchanged), within [.02, .98].

    ``beneficial`` if it falls by more than .05.
    """
    moved = F.col(base)
    for c, effect in effects.items():
        if f"{c}_new" in df.columns:
            moved = moved + F.coalesce((F.col(f"{c}_new") - F.col(c)) * effect, F.lit(0.0))
    new = F.least(F.greatest(moved, F.lit(0.02)), F.lit(0.98))
    change = new - F.col(base)
    return df.withColumns({"new_risk": F.round(new, 9), "risk_change": F.round(change * 100, 1), "beneficial": change < -0.05})


# The waterfall's base in log-odds, and contributions: name, vital, condition, amount, direction.
WATERFALL_BASE = -1.2
WATERFALL = (
    ("Serum Lactate", "lactate", "lactate > 2", "(lactate - 1.5) * 0.35", "risk"),
    ("Heart Rate", "heart_rate", "heart_rate > 100", "(heart_rate - 80) * 0.012", "risk"),
    ("SpO₂", "spo2_pct", "spo2_pct < 95", "(95 - spo2_pct) * 0.08", "risk"),
    ("Systolic BP", "systolic_bp", "systolic_bp < 100", "(110 - systolic_bp) * 0.025", "risk"),
    ("Respiratory Rate", "respiratory_rate", "respiratory_rate > 22", "(respiratory_rate - 16) * 0.04", "risk"),
    ("SpO₂ (normal)", "spo2_pct", "spo2_pct >= 96", "-0.15D", "protective"),
    ("Systolic BP (stable)", "systolic_bp", "systolic_bp >= 110", "-0.12D", "protective"),
    ("Lactate (normal)", "lactate", "lactate <= 1.5", "-0.2D", "protective"),
)


def waterfall(df: DataFrame, key: list[str], most: int = 10) -> DataFrame:
    """``key, rank, feature, value, contribution, direction, final_probability``: rule-based contributions, largest first.

    Of equal sizes the earlier rule comes first. Inside the row: no shuffle.
    """
    found = F.array_compact(
        F.array(*[
            F.when(_met(cond), F.struct((-F.abs(F.round(F.expr(amount), 3))).alias("size"), F.lit(k).alias("k"), F.lit(name).alias("feature"), F.col(vital).cast("double").alias("value"), F.round(F.expr(amount), 3).cast("double").alias("contribution"), F.lit(direction).alias("direction")))
            for k, (name, vital, cond, amount, direction) in enumerate(WATERFALL)
        ])
    )
    out = df.withColumn("_f", F.array_sort(found))
    total = F.aggregate("_f", F.lit(WATERFALL_BASE), lambda s, x: s + x["contribution"])
    out = out.withColumn("_p", F.round(100 / (1 + F.exp(-total)), 1)).select(*key, "_p", F.posexplode(F.slice("_f", 1, most)).alias("pos", "f"))
    return out.select(*key, (F.col("pos") + 1).alias("rank"), "f.feature", "f.value", "f.contribution", "f.direction", F.col("_p").alias("final_probability"))


def watchlist(df: DataFrame, score: str, least: float = 0.5) -> DataFrame:
    return df.filter(F.col(score) >= least).orderBy(F.desc(score), "patient_id")


def risk_distribution(df: DataFrame, p: str) -> DataFrame:
    """Counts of all four levels, zero where a level is empty."""
    counts = df.groupBy(band(F.col(p)).alias("level")).count()
    levels = df.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    return levels.join(counts, "level", "left").select("level", F.coalesce("count", F.lit(0)).alias("n"))


def importance(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean absolute contribution of each feature with rank and cumulative share; shares are 0 where nothing contributes."""
    means = df.agg(*[F.avg(F.abs(c)).alias(c) for c in features])
    rows = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in features])).alias("r")).select("r.*")
    w = Window.orderBy(F.desc("v"), "feature")
    whole = F.sum("v").over(Window.partitionBy())
    upto = F.coalesce(F.try_divide(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), whole), F.lit(0.0))
    return rows.select("feature", F.round("v", 6).alias("importance"), F.row_number().over(w).alias("rank"), F.round(upto, 6).alias("cumulative_share"))


def top_contributions(df: DataFrame, key: str, features: list[str], n: int = 3) -> DataFrame:
    """The ``n`` largest contributions by size of each entity's row, inside the row: no shuffle."""
    pairs = F.array(*[F.struct((-F.abs(F.col(c))).alias("k"), F.lit(c).alias("feature"), F.col(c).alias("v")) for c in features])
    best = F.slice(F.array_sort(F.filter(pairs, lambda r: r["v"].isNotNull())), 1, n)
    out = df.select(key, F.posexplode(best).alias("pos", "r"))
    return out.select(key, (F.col("pos") + 1).alias("rank"), F.col("r.feature").alias("feature"), F.round("r.v", 6).alias("contribution"), F.when(F.col("r.v") > 0, "up").otherwise("down").alias("direction"))
