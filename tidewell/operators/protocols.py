"""Checklists of clinical protocols, looked up by condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Protocol names and the steps' actions and priorities by condition.
PROTOCOLS = {
    "sepsis": (
        "Sepsis Resuscitation Bundle (Hour-1)",
        (
            ("Measure serum lactate level", "immediate"),
            ("Obtain blood cultures before antibiotics", "immediate"),
            ("Administer broad-spectrum antibiotics", "immediate"),
            ("Begin rapid 30 mL/kg crystalloid if hypotension or lactate ≥ 4", "immediate"),
            ("Apply vasopressors if hypotensive during/after fluid resuscitation (target MAP ≥ 65)", "urgent"),
            ("Reassess volume status and tissue perfusion", "30min"),
            ("Re-measure lactate if initial was elevated", "2-4h"),
        ),
    ),
    "respiratory": (
        "Respiratory Deterioration Protocol",
        (
            ("Assess airway patency and breathing pattern", "immediate"),
            ("Apply supplemental O₂ to maintain SpO₂ ≥ 94%", "immediate"),
            ("Obtain ABG and chest X-ray", "urgent"),
            ("Consider non-invasive ventilation (NIV/CPAP)", "urgent"),
            ("Notify attending physician and prepare for intubation if needed", "urgent"),
        ),
    ),
    "cardiac": (
        "Cardiac Deterioration Protocol",
        (
            ("Obtain 12-lead ECG immediately", "immediate"),
            ("Establish IV access and fluid bolus if hypotensive", "immediate"),
            ("Monitor continuous telemetry", "urgent"),
            ("Administer aspirin + notify cardiology", "urgent"),
            ("Prepare emergency resuscitation cart", "standby"),
        ),
    ),
    "general": (
        "Rapid Response Team (RRT) Activation",
        (
            ("Call RRT: Ext. 7777", "immediate"),
            ("Perform ABCDE assessment", "immediate"),
            ("Obtain full set of vitals + labs", "urgent"),
            ("Review medication list for reversible causes", "urgent"),
            ("Prepare for transfer to higher level of care", "standby"),
        ),
    ),
}


def checklists(spark: SparkSession) -> DataFrame:
    """``condition, protocol, step, action, priority``."""
    rows = [(c, name, k, *step) for c, (name, steps) in PROTOCOLS.items() for k, step in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "condition string, protocol string, step int, action string, priority string")


def condition_or_default(condition: Column) -> Column:
    """The condition if it has a protocol, else ``general``; also for null."""
    return F.when(condition.isin(*PROTOCOLS), condition).otherwise("general")


def with_protocol(df: DataFrame, condition: str) -> DataFrame:
    """A row for each row of ``df`` and step of its protocol."""
    steps = checklists(df.sparkSession).withColumnRenamed("condition", "_known")
    joined = df.withColumn("_known", condition_or_default(F.col(condition))).join(F.broadcast(steps), "_known")  # 22 rows
    return joined.drop("_known")
