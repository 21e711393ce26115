"""Imputation within entities: carried, interpolated, median, sentinel; and missingness flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewell.operators.prefix import exact_percentiles
from tidewell.schemas import ENTITY, HOUR


def _entity() -> WindowSpec:
    return Window.partitionBy(ENTITY).orderBy(HOUR)


def _back() -> WindowSpec:
    return _entity().rowsBetween(Window.unboundedPreceding, 0)


def _ahead() -> WindowSpec:
    return _entity().rowsBetween(0, Window.unboundedFollowing)


def carry_forward(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.last(c, True).over(_back()) for c in columns})


def interpolate(df: DataFrame, columns: list[str], limit: int = 3) -> DataFrame:
    """Linear by row position, ``limit`` rows into each gap; trailing gaps carry the last value as far; leading ones stay."""
    df = df.withColumn("_i", F.row_number().over(_entity()))
    seen = {c: F.when(F.col(c).isNotNull(), F.col("_i")) for c in columns}
    df = df.withColumns({f"_pv_{c}": F.last(c, True).over(_back()) for c in columns} | {f"_pi_{c}": F.last(x, True).over(_back()) for c, x in seen.items()})
    df = df.withColumns({f"_nv_{c}": F.first(c, True).over(_ahead()) for c in columns} | {f"_ni_{c}": F.first(x, True).over(_ahead()) for c, x in seen.items()})
    out = {}
    for c in columns:
        pv, pi, nv, ni = (F.col(f"_{k}_{c}") for k in ("pv", "pi", "nv", "ni"))
        step = F.col("_i") - pi
        between = F.when(nv.isNull(), pv).otherwise(pv + (nv - pv) * step / (ni - pi))
        out[c] = F.coalesce(F.col(c), F.when(step <= limit, between))
    return df.withColumns(out).drop("_i", *[f"_{k}_{c}" for k in ("pv", "pi", "nv", "ni") for c in columns])


def fit_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: exact median and mean of each column."""
    medians = exact_percentiles(df, columns, {"median": 0.5})
    wide = medians.agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"{c}_median") for c in columns])
    both = df.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns]).crossJoin(F.broadcast(wide))  # one row each
    return both.select(*[f"{c}_{k}" for c in columns for k in ("median", "mean")])


def fill_median(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """``fitted`` is :func:`fit_statistics`' one row."""
    joined = df.crossJoin(F.broadcast(fitted.limit(1).select(*[F.col(f"{c}_median").alias(f"_m_{c}") for c in columns])))
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def cascade(df: DataFrame, fitted: DataFrame, columns: list[str], limit: int = 3) -> DataFrame:
    """Interpolation, then filling forward and backward, then the median."""
    df = interpolate(df, columns, limit)
    df = df.withColumns({c: F.coalesce(F.last(c, True).over(_back()), F.first(c, True).over(_ahead())) for c in columns})
    return fill_median(df, fitted, columns)


def with_nulls(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that hold a null, from one pass of counts."""
    if not columns:
        return []
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def fill_sentinel(df: DataFrame, columns: list[str], value: float = -999.0, only_with_nulls: bool = False) -> DataFrame:
    """``value`` for null, and a flag for each column; ``only_with_nulls`` counts first and leaves columns without nulls as they are."""
    columns = with_nulls(df, columns) if only_with_nulls else columns
    flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in columns}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in columns})
