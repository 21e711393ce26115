"""Type coercion, range and category checks, quarantine and reports."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.schemas import CATEGORIES, ENTITY, HOUR, INTEGERS, LABS, RANGES, VITALS


def coerce(df: DataFrame) -> DataFrame:
    """Known columns in their types; values that don't fit, and fractions in whole-number columns, become null."""
    casts = {}
    for c in df.columns:
        if c in INTEGERS:
            number = F.expr(f"try_cast(`{c}` AS DOUBLE)")
            casts[c] = F.when(number == F.floor(number), number.cast("long"))
        elif c in RANGES:
            number = F.expr(f"try_cast(`{c}` AS DOUBLE)")
            casts[c] = F.when(~F.isnan(number), number)
        elif c in CATEGORIES:
            casts[c] = F.col(c).cast("string")
    return df.withColumns(casts)


def in_range(c: str) -> Column:
    """Nulls pass."""
    low, high = RANGES[c]
    return F.coalesce(F.col(c).between(low, high), F.lit(True))


def in_category(c: str) -> Column:
    """Nulls fail."""
    return F.coalesce(F.col(c).isin(CATEGORIES[c]), F.lit(False))


def checks(df: DataFrame) -> dict[str, Column]:
    return {c: in_range(c) if c in RANGES else in_category(c) for c in df.columns if c in RANGES or c in CATEGORIES}


def is_valid(df: DataFrame) -> Column:
    return reduce(and_, checks(df).values(), F.lit(True))


def valid_rows(df: DataFrame) -> DataFrame:
    return df.filter(is_valid(df))


def quarantined(df: DataFrame) -> DataFrame:
    """Rows that a check rejects, with the checks' columns as reasons."""
    reasons = F.array_compact(F.array(*[F.when(~ok, F.lit(c)) for c, ok in checks(df).items()]))
    return df.withColumn("reject_reasons", reasons).filter(F.size("reject_reasons") > 0)


def validation_report(df: DataFrame) -> DataFrame:
    """``column_name, violations, checked``: one pass, one row for each checked column."""
    found = checks(df)
    totals = df.agg(*[F.count_if(~ok).alias(c) for c, ok in found.items()], F.count("*").alias("_n"))
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("violations")) for c in found])
    return totals.select(F.explode(rows).alias("r"), F.col("_n").alias("checked")).select("r.*", "checked")


def missing_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, missing, pct`` of columns with nulls."""
    totals = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count("*").alias("_n"))
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns])
    out = totals.select(F.explode(rows).alias("r"), "_n").select("r.*", F.round(100.0 * F.col("r.missing") / F.col("_n"), 2).alias("pct"))
    return out.filter("missing > 0")


#: Columns that each kind of table must have.
REQUIRED = {
    "vitals": (ENTITY, HOUR, *VITALS, "oxygen_device", "oxygen_flow", "mobility_score", "nurse_alert"),
    "labs": (ENTITY, HOUR, *LABS, "sepsis_risk_score"),
}
REQUIRED["panel"] = (*REQUIRED["vitals"], *LABS, "sepsis_risk_score", "age", "gender", "comorbidity_index", "admission_type")


def missing_columns(df: DataFrame, kind: str = "panel") -> list[str]:
    """The required columns that ``df`` lacks, in their order."""
    return [c for c in REQUIRED[kind] if c not in df.columns]


def missing_fields(df: DataFrame, required: list[str], output: str = "missing_fields") -> DataFrame:
    """``df`` with the required fields that a row has no value for, in their order: the required ones without the mapped ones."""
    mapped = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in required if c in df.columns]))
    return df.withColumn(output, F.array_except(F.array(*map(F.lit, required)), mapped))


def type_errors(df: DataFrame) -> DataFrame:
    """``column_name, errors``: values of the numeric columns that aren't null and don't read as numbers. One pass."""
    checked = [c for c in df.columns if c in RANGES]
    bad = lambda c: F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS DOUBLE)").isNull()
    totals = df.agg(*[F.count_if(bad(c)).alias(c) for c in checked])
    return totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("errors")) for c in checked])))


def strict_rejects(df: DataFrame, kind: str = "vitals") -> DataFrame:
    """``df`` with ``reject_reasons``: required columns that are null, and values out of range or of no category.

    Ids start at 1. Oxygen, mobility and alert have defaults, so their nulls pass.
    """
    optional = {"oxygen_device", "oxygen_flow", "mobility_score", "nurse_alert"}
    reasons = [F.when(F.col(ENTITY) < 1, F.lit(ENTITY))]
    for c in REQUIRED[kind]:
        if c in df.columns:
            if c not in optional:
                reasons.append(F.when(F.col(c).isNull(), F.lit(c)))
            known = in_range(c) if c in RANGES else F.coalesce(F.col(c).isin(CATEGORIES[c]), F.lit(True)) if c in CATEGORIES else F.lit(True)
            reasons.append(F.when(~known, F.lit(c)))
    return df.withColumn("reject_reasons", F.array_compact(F.array(*reasons)))


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows that have a target, as a whole number."""
    return df.filter(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("int"))


def as_record(*columns: str) -> Column:
    """A JSON record of the columns without its null fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def distinct_names(*groups: list[str]) -> list[str]:
    """Column names of all groups, each once, in the order of their first mention."""
    return list(dict.fromkeys(c for g in groups for c in g))


def oxygen_flow_consistent(device: str = "oxygen_device", flow: str = "oxygen_flow") -> Column:
    return (F.col(device) == "none") == (F.col(flow) == 0)


def gap_report(df: DataFrame) -> DataFrame:
    """Entities with missing hours between their first and last, and those hours."""
    seen = df.groupBy(ENTITY).agg(F.min(HOUR).alias("a"), F.max(HOUR).alias("b"), F.collect_set(HOUR).alias("s"))
    missing = F.array_sort(F.array_except(F.sequence("a", "b"), "s"))
    return seen.select(ENTITY, missing.alias("missing_hours")).filter(F.size("missing_hours") > 0)
