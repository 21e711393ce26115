"""Trailing-window features: level, spread, shape, trend, variability and clinical scores.

``mode="exact"``: frames are short at the start of a stay and nulls are skipped. ``mode="padded"``: frames are filled up on
the left with their first row, as dense sequence models see them. All features of an entity share one window, so one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.schemas import CATEGORIES, ENTITY, HOUR

WIDTH = 12


def frame(width: int = WIDTH) -> Window:
    return Window.partitionBy(ENTITY).orderBy(HOUR).rowsBetween(1 - width, 0)


def statistics(df: DataFrame, columns: list[str], width: int = WIDTH) -> DataFrame:
    """Eight statistics of each column; 0 where a frame has too few values."""
    w, out = frame(width), {}
    # one pass over a frame's sorted values for all three quartiles
    df = df.withColumns({f"_p_{c}": F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w) for c in columns})
    for c in columns:
        n = F.count(c).over(w)
        or_zero = lambda x: F.coalesce(x, F.lit(0.0))
        out |= {f"{c}_{k}": or_zero(f(c).over(w)) for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))}
        out[f"{c}_std"] = F.when(n > 1, or_zero(F.stddev_samp(c).over(w))).otherwise(0.0)
        points = F.col(f"_p_{c}")
        out[f"{c}_median"] = or_zero(points[1])
        out[f"{c}_iqr"] = or_zero(points[2] - points[0])
        spread = F.max(c).over(w) - F.min(c).over(w)
        skew, kurt = F.skewness(c).over(w), F.kurtosis(c).over(w)
        out[f"{c}_skew"] = F.when((n > 2) & (spread > 0), F.sqrt(n * (n - 1.0)) / (n - 2) * skew).otherwise(0.0)
        out[f"{c}_kurt"] = F.when((n > 3) & (spread > 0), (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * kurt + 6)).otherwise(0.0)
    return df.withColumns(out).drop(*[f"_p_{c}" for c in columns])


def alert_load(df: DataFrame, width: int = WIDTH) -> DataFrame:
    w = frame(width)
    return df.withColumns({"nurse_alert_count": F.coalesce(F.sum("nurse_alert").over(w), F.lit(0)), "nurse_alert_ratio": F.coalesce(F.avg("nurse_alert").over(w), F.lit(0.0))})


def trends(df: DataFrame, columns: list[str], width: int = WIDTH) -> DataFrame:
    """Slope over the non-null values' own order, first-to-last change, its rate, and mean second difference."""
    w = frame(width)
    back = Window.partitionBy(ENTITY).orderBy(HOUR).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_k_{c}": F.when(F.col(c).isNotNull(), F.count(c).over(back)) for c in columns})
    df = df.withColumns({f"_a_{c}": F.collect_list(c).over(w) for c in columns})
    out = {}
    for c in columns:
        a, n = F.col(f"_a_{c}"), F.size(f"_a_{c}")
        at = lambda k, a=a: F.try_element_at(a, F.lit(k))
        out[f"{c}_slope"] = F.when(n >= 2, F.coalesce(F.regr_slope(c, f"_k_{c}").over(w), F.lit(0.0))).otherwise(0.0)
        out[f"{c}_delta"] = F.when(n >= 2, at(-1) - at(1)).otherwise(0.0)
        out[f"{c}_roc"] = F.when(n >= 2, (at(-1) - at(1)) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)
        out[f"{c}_accel"] = F.when(n >= 3, ((at(-1) - at(-2)) - (at(2) - at(1))) / (n - 2)).otherwise(0.0)
    return df.withColumns(out).drop(*[f"_{k}_{c}" for k in "ka" for c in columns])


def _successive(a: Column) -> Column:
    """Root mean square of successive differences; 0 for fewer than two values."""
    n = F.size(a)
    squares = F.zip_with(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), F.slice(a, 1, F.greatest(n - 1, F.lit(0))), lambda x, y: (x - y) * (x - y))
    return F.when(n >= 2, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / (n - 1))).otherwise(0.0)


def variability(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """Heart-rate and blood-pressure variability, and shares of low oxygen and fever; 0 for one value or none."""
    w = frame(width)
    many = lambda c, x: F.when(F.count(c).over(w) > 1, F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    spread = lambda c: F.max(c).over(w) - F.min(c).over(w)
    cv = lambda c: F.stddev_pop(c).over(w) / F.greatest(F.avg(c).over(w), F.lit(1e-8))
    share = lambda c, hit: F.avg(hit.cast("double")).over(w)
    std = lambda c: F.stddev_samp(c).over(w)
    df = df.withColumn("_hr", F.collect_list("heart_rate").over(w))
    return df.withColumns(
        {
            "hrv_sdnn": many("heart_rate", std("heart_rate")),
            "hrv_rmssd": _successive(F.col("_hr")),
            "hrv_range": many("heart_rate", spread("heart_rate")),
            "hrv_cv": many("heart_rate", cv("heart_rate")),
            "bpv_sbp_std": many("systolic_bp", std("systolic_bp")),
            "bpv_sbp_cv": many("systolic_bp", cv("systolic_bp")),
            "bpv_sbp_range": many("systolic_bp", spread("systolic_bp")),
            "bpv_dbp_std": many("diastolic_bp", std("diastolic_bp")),
            "bpv_dbp_range": many("diastolic_bp", spread("diastolic_bp")),
            "spo2_var_std": many("spo2_pct", std("spo2_pct")),
            "spo2_var_range": many("spo2_pct", spread("spo2_pct")),
            "spo2_below_90_ratio": many("spo2_pct", share("spo2_pct", F.col("spo2_pct") < 90)),
            "temp_var_std": many("temperature_c", std("temperature_c")),
            "temp_var_range": many("temperature_c", spread("temperature_c")),
            "temp_above_38": many("temperature_c", share("temperature_c", F.col("temperature_c") > 38.0)),
        }
    ).drop("_hr")


def clinical(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """Mean arterial pressure, shock index, qSOFA and lactate, now and over the frame."""
    w = frame(width)
    rows = F.count(F.lit(1)).over(w)
    met = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    df = df.withColumns(
        {
            "map_current": F.col("diastolic_bp") + (F.col("systolic_bp") - F.col("diastolic_bp")) / 3,
            "_si": F.when(F.col("systolic_bp").isNotNull(), F.col("heart_rate") / F.greatest("systolic_bp", F.lit(1.0))),
            "shock_index_current": F.when(F.col("systolic_bp").isNotNull(), F.col("heart_rate") / F.greatest("systolic_bp", F.lit(1e-8))),
            "qsofa_score": met(F.col("respiratory_rate") >= 22) + met(F.col("systolic_bp") <= 100) + met(F.col("mobility_score") <= 1),
        }
    )
    return df.withColumns(
        {
            "map_mean": F.when(rows > 1, F.avg("map_current").over(w)),
            "map_min": F.when(rows > 1, F.min("map_current").over(w)),
            "shock_index_mean": F.when(rows > 1, F.avg("_si").over(w)),
            "shock_index_max": F.when(rows > 1, F.max("_si").over(w)),
            "qsofa_ge2": (F.col("qsofa_score") >= 2).cast("int"),
            "qsofa_ge2_hours": F.sum((F.col("qsofa_score") >= 2).cast("int")).over(w),
            "lactate_elevated": met(F.col("lactate") > 2.0),
            "lactate_max_window": F.max("lactate").over(w),
        }
    ).drop("_si")


def padded_windows(df: DataFrame, columns: list[str], width: int = WIDTH, step: int = 1) -> DataFrame:
    """``window``: arrays of ``width`` structs, oldest first, filled up on the left with the frame's first row."""
    w = frame(width)
    rows = F.collect_list(F.struct(*columns)).over(w)
    number = F.row_number().over(Window.partitionBy(ENTITY).orderBy(HOUR)) - 1
    out = df.withColumns({"_rows": rows, "_n": number}).filter(F.col("_n") % step == 0)
    filled = F.concat(F.array_repeat(F.element_at("_rows", 1), F.lit(width) - F.size("_rows")), F.col("_rows"))
    return out.withColumn("window", filled).drop("_rows", "_n")


def flattened(df: DataFrame, columns: list[str], width: int = 3) -> DataFrame:
    """Columns ``{c}_t-{k}`` to ``{c}_t0`` of the padded window."""
    out = padded_windows(df, columns, width)
    names = {f"{c}_t-{k}" if k else f"{c}_t0": F.element_at("window", width - k)[c] for k in range(width - 1, -1, -1) for c in columns}
    return out.withColumns(names).drop("window")


def _squared_from(mean: Column):
    return lambda x: (x - mean) * (x - mean)


def padded_statistics(df: DataFrame, columns: list[str], width: int = WIDTH) -> DataFrame:
    """Seven statistics over the padded window: lower median and index quartiles, as fixed-length sequences have them."""
    out = padded_windows(df, columns, width)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    new = {}
    for c in columns:
        a = F.col(f"_a_{c}")
        out = out.withColumn(f"_a_{c}", F.expr(f"transform(window, r -> r.`{c}`)"))
        out = out.withColumn(f"_s_{c}", F.sort_array(f"_a_{c}"))
        whole = ~F.exists(a, lambda x: x.isNull())
        mean = total(a) / width
        at = lambda k, c=c: F.element_at(f"_s_{c}", k + 1)
        square = F.sqrt(total(F.transform(a, _squared_from(mean))) / (width - 1))
        new |= {
            f"{c}_mean": F.when(whole, mean),
            f"{c}_std": F.when(whole, square),
            f"{c}_min": F.when(whole, at(0)),
            f"{c}_max": F.when(whole, at(width - 1)),
            f"{c}_median": F.when(whole, at((width - 1) // 2)),
            f"{c}_iqr": F.when(whole, at(int(0.75 * width)) - at(int(0.25 * width))),
            f"{c}_range": F.when(whole, at(width - 1) - at(0)),
        }
    return out.withColumns(new).drop("window", *[f"_{k}_{c}" for k in "as" for c in columns])


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _spread(a: Column, width: int) -> Column:
    """Sample deviation."""
    mean = _total(a) / width
    return F.sqrt(_total(F.transform(a, _squared_from(mean))) / (width - 1))


def _steps(a: Column, width: int) -> Column:
    return F.zip_with(F.slice(a, 2, width - 1), F.slice(a, 1, width - 1), lambda x, y: x - y)


def padded_trends(df: DataFrame, columns: list[str], width: int = WIDTH) -> DataFrame:
    """Slope over positions, change, its rate and mean second difference of the padded window; null where it holds a null."""
    out = padded_windows(df, columns, width)
    centre = (width - 1) / 2
    around = sum((k - centre) ** 2 for k in range(width)) + 1e-8
    new = {}
    for c in columns:
        a = F.col(f"_a_{c}")
        out = out.withColumn(f"_a_{c}", F.expr(f"transform(window, r -> double(r.`{c}`))"))
        whole = lambda x, a=a: F.when(~F.exists(a, lambda v: v.isNull()), x)
        last, first = F.element_at(a, width), F.element_at(a, 1)
        leaning = F.transform(a, lambda x, k: x * (k - centre))
        new[f"{c}_slope"] = whole(_total(leaning) / around)
        new[f"{c}_delta"] = whole(last - first)
        new[f"{c}_roc"] = whole((last - first) / max(width - 1, 1))
        bend = (last - F.element_at(a, width - 1)) - (F.element_at(a, 2) - first) if width >= 3 else F.lit(0.0)
        new[f"{c}_accel"] = whole(bend / max(width - 2, 1))
    return out.withColumns(new).drop("window", *[f"_a_{c}" for c in columns])


def padded_clinical(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """Variability and clinical scores over the padded window; qSOFA has two signs here (mobility isn't among them).

    A feature is null where its window holds a null.
    """
    signals = ("heart_rate", "respiratory_rate", "spo2_pct", "temperature_c", "systolic_bp", "diastolic_bp", "lactate", "nurse_alert")
    out = padded_windows(df, list(signals), width)
    out = out.withColumns({f"_{c}": F.expr(f"transform(window, r -> double(r.`{c}`))") for c in signals})
    arr = {c: F.col(f"_{c}") for c in signals}
    whole = lambda x, *cs: F.when(~sum_null(*cs), x)

    def sum_null(*cs: str) -> Column:
        found = F.lit(False)
        for c in cs:
            found = found | F.exists(arr[c], lambda v: v.isNull())
        return found

    hr, rr, ox, temp, sbp, dbp, lac, nurse = (arr[c] for c in signals)
    reach = lambda a: F.array_max(a) - F.array_min(a)
    mean = lambda a: _total(a) / width
    share = lambda a, hit: _total(F.transform(a, lambda x: hit(x).cast("double"))) / width
    pressure = F.zip_with(dbp, sbp, lambda d, s: d + (s - d) / 3)
    shock = F.zip_with(hr, sbp, lambda h, s: h / F.greatest(s, F.lit(1.0)))
    signs = F.zip_with(rr, sbp, lambda r, s: (r >= 22).cast("int") + (s <= 100).cast("int"))
    new = {
        "hrv_sdnn": whole(_spread(hr, width), "heart_rate"),
        "hrv_rmssd": whole(F.sqrt(_total(F.transform(_steps(hr, width), lambda x: x * x)) / (width - 1) + 1e-8), "heart_rate"),
        "hrv_range": whole(reach(hr), "heart_rate"),
        "hrv_cv": whole(_spread(hr, width) / F.greatest(mean(hr), F.lit(1e-8)), "heart_rate"),
        "bpv_sbp_std": whole(_spread(sbp, width), "systolic_bp"),
        "bpv_sbp_cv": whole(_spread(sbp, width) / F.greatest(mean(sbp), F.lit(1e-8)), "systolic_bp"),
        "bpv_sbp_range": whole(reach(sbp), "systolic_bp"),
        "bpv_dbp_std": whole(_spread(dbp, width), "diastolic_bp"),
        "bpv_dbp_range": whole(reach(dbp), "diastolic_bp"),
        "spo2_var_std": whole(_spread(ox, width), "spo2_pct"),
        "spo2_var_range": whole(reach(ox), "spo2_pct"),
        "spo2_below_90_ratio": whole(share(ox, lambda x: x < 90), "spo2_pct"),
        "temp_var_std": whole(_spread(temp, width), "temperature_c"),
        "temp_var_range": whole(reach(temp), "temperature_c"),
        "temp_above_38": whole(share(temp, lambda x: x > 38.0), "temperature_c"),
        "map_current": whole(F.element_at(pressure, width), "systolic_bp", "diastolic_bp"),
        "map_mean": whole(mean(pressure), "systolic_bp", "diastolic_bp"),
        "map_min": whole(F.array_min(pressure), "systolic_bp", "diastolic_bp"),
        "shock_index_current": whole(F.element_at(shock, width), "heart_rate", "systolic_bp"),
        "shock_index_mean": whole(mean(shock), "heart_rate", "systolic_bp"),
        "shock_index_max": whole(F.array_max(shock), "heart_rate", "systolic_bp"),
        "qsofa_score": whole(F.element_at(signs, width), "respiratory_rate", "systolic_bp"),
        "qsofa_ge2": whole((F.element_at(signs, width) >= 2).cast("int"), "respiratory_rate", "systolic_bp"),
        "qsofa_ge2_hours": whole(F.size(F.filter(signs, lambda x: x >= 2)), "respiratory_rate", "systolic_bp"),
        "lactate_elevated": whole((F.element_at(lac, width) > 2.0).cast("int"), "lactate"),
        "lactate_max_window": whole(F.array_max(lac), "lactate"),
        "nurse_alert_count": whole(_total(nurse), "nurse_alert"),
        "nurse_alert_ratio": whole(mean(nurse), "nurse_alert"),
    }
    return out.withColumns(new).drop("window", *[f"_{c}" for c in signals])


# Ends of feature names that repeat a signal's only value, and those that are 0 with a single value.
LEVEL_ENDS = ("_mean", "_median", "_min", "_max", "_latest")
CHANGE_ENDS = ("_std", "_iqr", "_range", "_slope", "_delta", "_roc", "_accel", "_sdnn", "_rmssd", "_cv")


def expand_single(df: DataFrame, names: list[str], signals: list[str]) -> DataFrame:
    """``df`` with the named window features, told from one row alone: levels are the value itself, changes are 0.

    Statics have their fixed defaults (age 65, comorbidity 2, male, emergency), anything else is 0; nulls count as 0.
    """
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    fixed = {"age": 65.0, "comorbidity_index": 2.0, "gender_M": 1.0, "admission_type_ED": 1.0}
    new = {}
    for n in names:
        base = n.rsplit("_", 1)[0]
        if n.endswith(LEVEL_ENDS):
            new[n] = value(base) if base in signals else F.lit(0.0)
        elif n.endswith(CHANGE_ENDS):
            new[n] = F.lit(0.0)
        elif n.startswith("map_"):
            new[n] = (value("systolic_bp") + 2 * value("diastolic_bp")) / 3.0
        elif n.startswith("shock_index"):
            new[n] = value("heart_rate") / F.greatest(value("systolic_bp"), F.lit(1.0))
        elif n.startswith("qsofa"):
            new[n] = (value("respiratory_rate") >= 22).cast("double") + (value("systolic_bp") <= 100).cast("double")
        elif n == "lactate_elevated":
            new[n] = (value("lactate") > 2.0).cast("double")
        else:
            new[n] = F.lit(fixed.get(n, 0.0))
    return df.withColumns(new)


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    """A 0/1 column for each declared level; a null has none."""
    return df.withColumns({f"{c}_{v}": F.when(F.col(c) == v, 1).otherwise(0) for c in columns for v in CATEGORIES[c]})


def full_set(df: DataFrame, signals: list[str], width: int = WIDTH) -> DataFrame:
    """All features of the exact mode: statistics, alert load, trends, variability, clinical scores, latest values, levels."""
    out = alert_load(statistics(df, signals, width), width)
    out = clinical(variability(trends(out, signals, width), width), width)
    out = out.withColumns({f"{c}_latest": F.col(c) for c in signals})
    return one_hot(out, [c for c in ("gender", "admission_type") if c in df.columns])
