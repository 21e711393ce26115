"""Queries over the panel: quality, grid, imputation, labels, features and splits, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import features, grid, impute, labels, quality, split
from tidewell.plans.oracle_text import AHEAD, BACK, KEYS, SIGNALS, W12, rounded, with_panel
from tidewell.schemas import CATEGORIES, ENTITY, HOUR, RANGES
from tidewell.schemas import KEYS as KEY_COLUMNS
from tidewell.sources import panel as source

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.with_statics(source.events_to_panel(source.table(spark, sf_dir, "events")))


def tidy(df: DataFrame, columns: list[str], keys: list[str] = KEY_COLUMNS, digits: int = 6) -> DataFrame:
    """Keys and rounded columns; minus zero becomes zero."""
    return df.select(*keys, *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in columns])


def zeroed(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


_OK = " AND ".join(f"coalesce({c} BETWEEN {lo} AND {hi}, true)" for c, (lo, hi) in RANGES.items() if c in [*SIGNALS, "age", "comorbidity_index", "hour_from_admission", "mobility_score", "nurse_alert"])
_CHECKED = [c for c in RANGES if c in [*SIGNALS, "age", "comorbidity_index", "hour_from_admission", "mobility_score", "nurse_alert"]]


@query(
    """SELECT CAST(event_id AS BIGINT) AS event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS heart_rate,
  CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS age FROM events"""
)
def p01_coerce(spark, sf_dir):
    raw = source.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("event_id"), F.get_json_object("props", "$.k").alias("heart_rate"), F.col("value").cast("string").alias("age")
    )
    return quality.coerce(raw)


@query(with_panel(f"SELECT {KEYS}, {rounded(SIGNALS)} FROM full_panel WHERE {_OK}"))
def p05_valid_filter(spark, sf_dir):
    return tidy(quality.valid_rows(panel(spark, sf_dir)), SIGNALS)


@query(with_panel(f"SELECT {KEYS}, concat_ws(',', {', '.join(f'CASE WHEN NOT {c} BETWEEN {RANGES[c][0]} AND {RANGES[c][1]} THEN {c!r} END' for c in _CHECKED)}) AS reasons FROM full_panel WHERE NOT ({_OK})"))
def p05_quarantine_anti(spark, sf_dir):
    order = F.array(*[F.lit(c) for c in _CHECKED])
    out = quality.quarantined(panel(spark, sf_dir))
    return out.select(*KEY_COLUMNS, F.array_join(F.filter(order, lambda c: F.array_contains(F.col("reject_reasons"), c)), ",").alias("reasons"))


@query(
    with_panel(
        " UNION ALL ".join(
            [f"SELECT {c!r} AS column_name, CAST(count_if(NOT {c} BETWEEN {RANGES[c][0]} AND {RANGES[c][1]}) AS BIGINT) AS violations, count(*) AS checked FROM full_panel" for c in _CHECKED]
            + [f"SELECT {c!r} AS column_name, CAST(count_if(NOT coalesce({c} IN ({', '.join(map(repr, v))}), false)) AS BIGINT) AS violations, count(*) AS checked FROM full_panel" for c, v in CATEGORIES.items() if c != "oxygen_device"]
        )
    )
)
def a32_validation_report(spark, sf_dir):
    return quality.validation_report(panel(spark, sf_dir))


@query(
    with_panel(
        "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {c!r} AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS missing, round(100.0 * count_if({c} IS NULL) / count(*), 2) AS pct FROM full_panel" for c in SIGNALS) + ") WHERE missing > 0"
    )
)
def a31_missing_summary(spark, sf_dir):
    return quality.missing_summary(panel(spark, sf_dir), SIGNALS)


_GRID = ", span AS (SELECT patient_id, min(hour_from_admission) AS a, least(max(hour_from_admission), 71) AS b FROM panel GROUP BY patient_id), grid AS (SELECT patient_id, unnest(range(a, b + 1)) AS hour_from_admission FROM span)"


@query(with_panel(f"SELECT g.patient_id, g.hour_from_admission, {rounded(SIGNALS)} FROM grid g LEFT JOIN panel p ON p.patient_id = g.patient_id AND p.hour_from_admission = g.hour_from_admission", _GRID))
def g01_continuous_grid(spark, sf_dir):
    return tidy(grid.continuous_grid(panel(spark, sf_dir)), SIGNALS)


@query(with_panel("SELECT patient_id, CAST(floor(hour_from_admission / 4) * 4 AS BIGINT) AS hour_from_admission, round(avg(heart_rate), 6) AS heart_rate, round(avg(sbp_dense), 6) AS sbp_dense, arg_max(gender, hour_from_admission) AS gender FROM full_panel GROUP BY 1, 2"))
def g02_resample_4h(spark, sf_dir):
    out = grid.resample(panel(spark, sf_dir), 4, ["heart_rate", "sbp_dense"])
    return out.select(*KEY_COLUMNS, F.round("heart_rate", 6).alias("heart_rate"), F.round("sbp_dense", 6).alias("sbp_dense"), "gender")


@query(with_panel("SELECT g.patient_id, string_agg(CAST(g.hour_from_admission AS VARCHAR), ',' ORDER BY g.hour_from_admission) AS missing FROM grid g LEFT JOIN panel p ON p.patient_id = g.patient_id AND p.hour_from_admission = g.hour_from_admission WHERE p.patient_id IS NULL GROUP BY g.patient_id", _GRID))
def g04_gap_report(spark, sf_dir):
    return quality.gap_report(panel(spark, sf_dir)).select(ENTITY, F.array_join("missing_hours", ",").alias("missing"))


@query(
    with_panel(
        f"SELECT {KEYS}, CAST(coalesce(last_value(x IGNORE NULLS) OVER {BACK}, first_value(x IGNORE NULLS) OVER {AHEAD}) AS INTEGER) AS age FROM (SELECT *, CASE WHEN hour_from_admission % 5 = 0 THEN age END AS x FROM full_panel)"
    )
)
def g05_static_fill(spark, sf_dir):
    sparse = panel(spark, sf_dir).withColumn("age", F.when(F.col(HOUR) % 5 == 0, F.col("age")))
    return grid.fill_static(sparse, ["age"]).select(*KEY_COLUMNS, "age")


@query(
    with_panel(
        "SELECT coalesce(v.patient_id, l.patient_id) AS patient_id, coalesce(v.hour_from_admission, l.hour_from_admission) AS hour_from_admission, round(v.hr_dense, 6) AS hr_dense, round(l.hr_dense, 6) AS hr_dense_lab, round(l.lactate, 6) AS lactate "
        "FROM (SELECT * FROM panel WHERE hour_from_admission % 3 <> 0) v FULL JOIN (SELECT * FROM panel WHERE hour_from_admission % 2 = 0) l ON v.patient_id = l.patient_id AND v.hour_from_admission = l.hour_from_admission"
    )
)
def j01_merge_full_outer(spark, sf_dir):
    p = panel(spark, sf_dir)
    vitals = p.filter(F.col(HOUR) % 3 != 0).select(*KEY_COLUMNS, "hr_dense")
    labs = p.filter(F.col(HOUR) % 2 == 0).select(*KEY_COLUMNS, "hr_dense", "lactate")
    return tidy(grid.merge_facts(vitals, labs), ["hr_dense", "hr_dense_lab", "lactate"])


@query("SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment, c.c_nationkey FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def j02_static_left(spark, sf_dir):
    orders = source.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = source.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return grid.add_dimension(orders, customers, "o_custkey")


_LABEL = "CAST(CASE WHEN deterioration_hour >= 0 AND hour_from_admission < deterioration_hour AND deterioration_hour <= hour_from_admission + {h} THEN 1 ELSE 0 END AS INTEGER)"


@query(with_panel(f"SELECT p.patient_id, p.hour_from_admission, t.y AS target FROM panel p LEFT JOIN (SELECT {KEYS}, {_LABEL.format(h=12)} AS y FROM full_panel WHERE hour_from_admission % 2 = 0) t ON t.patient_id = p.patient_id AND t.hour_from_admission = p.hour_from_admission"))
def j05_target_lookup(spark, sf_dir):
    p = panel(spark, sf_dir)
    target = labels.deterioration(p.filter(F.col(HOUR) % 2 == 0), (12,)).select(*KEY_COLUMNS, F.col("deterioration_next_12h").alias("target"))
    return p.select(*KEY_COLUMNS).join(target, KEY_COLUMNS, "left")


_SPLIT = """, ids AS (SELECT DISTINCT patient_id FROM panel), ranked AS (SELECT patient_id, row_number() OVER (ORDER BY md5(concat(patient_id, ':42'))) AS r, count(*) OVER () AS n FROM ids),
split AS (SELECT patient_id, CASE WHEN r <= n - h THEN 'train' WHEN r <= n - h + h // 2 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, CAST(ceil(n * 3 / 10) AS BIGINT) AS h FROM ranked))"""


@query(with_panel("SELECT patient_id, split FROM split", _SPLIT))
def p11_entity_split(spark, sf_dir):
    return split.assign(panel(spark, sf_dir))


@query(with_panel(f"SELECT {KEYS} FROM panel SEMI JOIN (SELECT * FROM split WHERE split = 'train') USING (patient_id)", _SPLIT))
def j06_semi_split(spark, sf_dir):
    p = panel(spark, sf_dir)
    return source.of_entities(p, split.assign(p).filter("split = 'train'")).select(*KEY_COLUMNS)


@query(with_panel(f"SELECT split, count(*) AS n_rows, count(DISTINCT patient_id) AS n_entities, round(avg({_LABEL.format(h=12)}), 6) AS positive_rate FROM full_panel JOIN split USING (patient_id) GROUP BY split", _SPLIT))
def a35_split_stats(spark, sf_dir):
    p = labels.deterioration(panel(spark, sf_dir), (12,))
    return split.split_statistics(split.apply_split(p, split.assign(p)), "deterioration_next_12h")


@query(with_panel(f"SELECT {KEYS} FROM panel WHERE hour_from_admission < 48"))
def p09_clip(spark, sf_dir):
    return grid.clip_stay(panel(spark, sf_dir), 48).select(*KEY_COLUMNS)


@query(with_panel(f"SELECT {KEYS} FROM panel WHERE patient_id IN (SELECT patient_id FROM panel GROUP BY patient_id ORDER BY patient_id LIMIT 20)"))
def s03_first_entities(spark, sf_dir):
    return source.first_entities(panel(spark, sf_dir), 20).select(*KEY_COLUMNS)


@query(with_panel("SELECT patient_id, max(hour_from_admission) AS hour_from_admission, round(arg_max(hr_dense, hour_from_admission), 6) AS hr_dense FROM panel GROUP BY patient_id"))
def p30_latest_row(spark, sf_dir):
    return tidy(source.latest(panel(spark, sf_dir)), ["hr_dense"])


_LEVELS = {c: CATEGORIES[c] for c in ("gender", "admission_type")}


@query(with_panel(f"SELECT {KEYS}, " + ", ".join(f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS INTEGER) AS {c}_{v}" for c, vs in _LEVELS.items() for v in vs) + " FROM full_panel"))
def p13_one_hot(spark, sf_dir):
    return features.one_hot(panel(spark, sf_dir), list(_LEVELS)).select(*KEY_COLUMNS, *[f"{c}_{v}" for c, vs in _LEVELS.items() for v in vs])


_SOME = ["heart_rate", "systolic_bp"]


@query(with_panel(f"SELECT {KEYS}, " + ", ".join(f"round(last_value({c} IGNORE NULLS) OVER {BACK}, 6) AS {c}" for c in _SOME) + " FROM panel"))
def w06_locf(spark, sf_dir):
    return tidy(impute.carry_forward(panel(spark, sf_dir), _SOME), _SOME)


_INTERPOLATED = f""", nr AS (SELECT {KEYS}, row_number() OVER (PARTITION BY patient_id ORDER BY hour_from_admission) AS i, heart_rate AS v FROM panel),
nb AS (SELECT *, last_value(v IGNORE NULLS) OVER {BACK} AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER {BACK} AS pi,
  first_value(v IGNORE NULLS) OVER {AHEAD} AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER {AHEAD} AS ni FROM nr),
w7 AS (SELECT {KEYS}, coalesce(v, CASE WHEN i - pi <= 3 THEN CASE WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END END) AS heart_rate FROM nb)"""


@query(with_panel(f"SELECT {KEYS}, round(heart_rate, 6) AS heart_rate FROM w7", _INTERPOLATED))
def w07_interpolate(spark, sf_dir):
    return tidy(impute.interpolate(panel(spark, sf_dir), ["heart_rate"]), ["heart_rate"])


@query(with_panel(f"SELECT {KEYS}, round(coalesce(last_value(heart_rate IGNORE NULLS) OVER {BACK}, first_value(heart_rate IGNORE NULLS) OVER {AHEAD}, (SELECT quantile_cont(heart_rate, 0.5) FROM panel)), 6) AS heart_rate FROM w7", _INTERPOLATED))
def w08_cascade(spark, sf_dir):
    p = panel(spark, sf_dir)
    return tidy(impute.cascade(p, impute.fit_statistics(p, ["heart_rate"]), ["heart_rate"]), ["heart_rate"])


@query(with_panel(f"SELECT {KEYS}, " + ", ".join(f"round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM panel)), 6) AS {c}" for c in _SOME) + " FROM panel"))
def w09_median(spark, sf_dir):
    p = panel(spark, sf_dir)
    return tidy(impute.fill_median(p, impute.fit_statistics(p, _SOME), _SOME), _SOME)


@query(with_panel("SELECT " + ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS {c}_median, round(avg({c}), 6) AS {c}_mean" for c in SIGNALS) + " FROM panel"))
def a30_fit_statistics(spark, sf_dir):
    return tidy(impute.fit_statistics(panel(spark, sf_dir), SIGNALS), [f"{c}_{k}" for c in SIGNALS for k in ("median", "mean")], [])


@query(with_panel(f"SELECT {KEYS}, " + ", ".join(f"round(coalesce({c}, -999.0), 6) AS {c}, CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in _SOME) + " FROM panel"))
def p28_sentinel(spark, sf_dir):
    out = impute.fill_sentinel(panel(spark, sf_dir), _SOME)
    return out.select(*KEY_COLUMNS, *[F.round(c, 6).alias(c) for c in _SOME], *[f"{c}_missing" for c in _SOME])


@query(with_panel(f"SELECT {KEYS}, " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_was_missing" for c in SIGNALS) + " FROM panel"))
def p29_flags(spark, sf_dir):
    return impute.missing_flags(panel(spark, sf_dir), SIGNALS).select(*KEY_COLUMNS, *[f"{c}_was_missing" for c in SIGNALS])


@query(with_panel(f"SELECT {KEYS}, " + ", ".join(f"{_LABEL.format(h=h)} AS deterioration_next_{h}h" for h in (6, 10, 12)) + " FROM full_panel"))
def l01_label_6_10_12(spark, sf_dir):
    return labels.deterioration(panel(spark, sf_dir)).select(*KEY_COLUMNS, *[f"deterioration_next_{h}h" for h in (6, 10, 12)])


_EVENTS = {
    "sepsis_next_6h": ("coalesce(respiratory_rate >= 22, false) AND coalesce(systolic_bp <= 100, false) AND (coalesce(lactate >= 2, false) OR coalesce(temperature_c >= 38.3, false) OR coalesce(temperature_c <= 36, false))", 6),
    "cardiac_arrest_next_12h": ("coalesce(heart_rate < 35, false) OR coalesce(heart_rate > 180, false) OR coalesce(systolic_bp < 65, false) OR (deterioration_hour > 0 AND (coalesce(heart_rate < 40, false) OR coalesce(heart_rate > 150, false) OR coalesce(systolic_bp < 70, false)))", 12),
    "respiratory_failure_next_12h": ("coalesce(spo2_pct < 88, false) OR (coalesce(spo2_pct < 90, false) AND coalesce(respiratory_rate >= 28, false))", 12),
}


@query(
    with_panel(
        f"SELECT {KEYS}, " + ", ".join(f"CAST(EXISTS (SELECT 1 FROM full_panel f WHERE f.patient_id = p.patient_id AND f.hour_from_admission > p.hour_from_admission AND f.hour_from_admission <= p.hour_from_admission + {h} AND ({x})) AS INTEGER) AS {n}" for n, (x, h) in _EVENTS.items()) + " FROM full_panel p"
    )
)
def l06_outcome_labels(spark, sf_dir):
    return labels.look_ahead(panel(spark, sf_dir)).select(*KEY_COLUMNS, *labels.OUTCOMES)


_Y = f", y AS (SELECT patient_id, {_LABEL.format(h=12)} AS y FROM full_panel)"


@query(
    with_panel(
        """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(y) AS BIGINT) AS positives, CAST(count(DISTINCT patient_id) AS BIGINT) AS entities, CAST(count(DISTINCT CASE WHEN y = 1 THEN patient_id END) AS BIGINT) AS entities_with_event,
  round(sum(y) / count(*), 6) AS positive_rate, round(count(DISTINCT CASE WHEN y = 1 THEN patient_id END) / count(DISTINCT patient_id), 6) AS entity_event_rate, round((count(*) - sum(y)) / sum(y), 6) AS imbalance_ratio,
  CASE WHEN (count(*) - sum(y)) / sum(y) > 10 THEN 'severe' WHEN (count(*) - sum(y)) / sum(y) > 3 THEN 'moderate' ELSE 'balanced' END AS imbalance FROM y""",
        _Y,
    )
)
def a33_class_distribution(spark, sf_dir):
    out = labels.class_distribution(labels.deterioration(panel(spark, sf_dir), (12,)), "deterioration_next_12h")
    return out.withColumns({c: F.col(c).cast("long") for c in ("positives", "entities_with_event")})


@query(with_panel(f"SELECT {KEYS}, round((SELECT count(*) FROM y) / (2.0 * CASE WHEN {_LABEL.format(h=12)} = 1 THEN (SELECT sum(y) FROM y) ELSE (SELECT count(*) - sum(y) FROM y) END), 6) AS weight FROM full_panel", _Y))
def a34_sample_weights(spark, sf_dir):
    return tidy(labels.sample_weights(labels.deterioration(panel(spark, sf_dir), (12,)), "deterioration_next_12h"), ["weight"])


_STAT_COLUMNS = ["heart_rate", "hr_dense"]
_STATS = ["mean", "min", "max", "std", "median", "iqr", "skew", "kurt"]


def _stat_sql(c: str) -> str:
    n, spread = f"count({c}) OVER {W12}", f"max({c}) OVER {W12} - min({c}) OVER {W12}"
    parts = {
        "mean": f"coalesce(avg({c}) OVER {W12}, 0)",
        "min": f"coalesce(min({c}) OVER {W12}, 0)",
        "max": f"coalesce(max({c}) OVER {W12}, 0)",
        "std": f"CASE WHEN {n} > 1 THEN coalesce(stddev_samp({c}) OVER {W12}, 0) ELSE 0 END",
        "median": f"coalesce(quantile_cont({c}, 0.5) OVER {W12}, 0)",
        "iqr": f"coalesce(quantile_cont({c}, 0.75) OVER {W12} - quantile_cont({c}, 0.25) OVER {W12}, 0)",
        "skew": f"CASE WHEN {n} > 2 AND {spread} > 0 THEN skewness({c}) OVER {W12} ELSE 0 END",
        "kurt": f"CASE WHEN {n} > 3 AND {spread} > 0 THEN kurtosis({c}) OVER {W12} ELSE 0 END",
    }
    return ", ".join(f"round({x}, 5) + 0.0 AS {c}_{k}" for k, x in parts.items())


@query(with_panel(f"SELECT {KEYS}, {', '.join(map(_stat_sql, _STAT_COLUMNS))}, CAST(sum(nurse_alert) OVER {W12} AS BIGINT) AS nurse_alert_count, round(avg(nurse_alert) OVER {W12}, 5) AS nurse_alert_ratio FROM full_panel"))
def a01_a08_statistical(spark, sf_dir):
    names = [f"{c}_{k}" for c in _STAT_COLUMNS for k in _STATS]
    out = features.alert_load(features.statistics(panel(spark, sf_dir), _STAT_COLUMNS))
    return out.select(*KEY_COLUMNS, *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in names], F.col("nurse_alert_count").cast("long").alias("nurse_alert_count"), F.round("nurse_alert_ratio", 5).alias("nurse_alert_ratio"))


_TREND = f""", k AS (SELECT {KEYS}, heart_rate AS v, CASE WHEN heart_rate IS NOT NULL THEN count(heart_rate) OVER {BACK} END AS i FROM panel),
f AS (SELECT {KEYS}, list(v) FILTER (WHERE v IS NOT NULL) OVER {W12} AS a, regr_slope(v, i) OVER {W12} AS s FROM k)"""


@query(
    with_panel(
        f"""SELECT {KEYS}, round(CASE WHEN len(a) >= 2 THEN coalesce(s, 0) ELSE 0 END, 5) + 0.0 AS heart_rate_slope, round(CASE WHEN len(a) >= 2 THEN a[-1] - a[1] ELSE 0 END, 5) + 0.0 AS heart_rate_delta,
  round(CASE WHEN len(a) >= 2 THEN (a[-1] - a[1]) / greatest(len(a) - 1, 1) ELSE 0 END, 5) + 0.0 AS heart_rate_roc, round(CASE WHEN len(a) >= 3 THEN ((a[-1] - a[-2]) - (a[2] - a[1])) / (len(a) - 2) ELSE 0 END, 5) + 0.0 AS heart_rate_accel FROM f""",
        _TREND,
    )
)
def a09_a13_trend(spark, sf_dir):
    return tidy(features.trends(panel(spark, sf_dir), ["heart_rate"]), [f"heart_rate_{k}" for k in ("slope", "delta", "roc", "accel")], digits=5)


_VAR = ["hrv_sdnn", "hrv_rmssd", "hrv_range", "hrv_cv", "bpv_sbp_std", "bpv_sbp_range", "spo2_below_90_ratio", "temp_above_38"]


@query(
    with_panel(
        f"""SELECT {KEYS}, round(CASE WHEN len(a) > 1 THEN sd ELSE 0 END, 5) AS hrv_sdnn,
  round(CASE WHEN len(a) > 1 THEN sqrt(list_sum(list_transform(range(2, len(a) + 1), lambda i: (a[i] - a[i-1]) * (a[i] - a[i-1]))) / (len(a) - 1)) ELSE 0 END, 5) AS hrv_rmssd,
  round(CASE WHEN len(a) > 1 THEN mx - mn ELSE 0 END, 5) AS hrv_range, round(CASE WHEN len(a) > 1 THEN sp / greatest(m, 1e-8) ELSE 0 END, 5) AS hrv_cv,
  round(CASE WHEN nb > 1 THEN bs ELSE 0 END, 5) AS bpv_sbp_std, round(CASE WHEN nb > 1 THEN br ELSE 0 END, 5) AS bpv_sbp_range, round(CASE WHEN no > 1 THEN ol ELSE 0 END, 5) AS spo2_below_90_ratio, round(CASE WHEN nt > 1 THEN th ELSE 0 END, 5) AS temp_above_38 FROM g""",
        f""", g AS (SELECT {KEYS}, coalesce(list(heart_rate) FILTER (WHERE heart_rate IS NOT NULL) OVER {W12}, []) AS a, stddev_samp(heart_rate) OVER {W12} AS sd, stddev_pop(heart_rate) OVER {W12} AS sp, avg(heart_rate) OVER {W12} AS m, max(heart_rate) OVER {W12} AS mx, min(heart_rate) OVER {W12} AS mn,
  count(systolic_bp) OVER {W12} AS nb, stddev_samp(systolic_bp) OVER {W12} AS bs, max(systolic_bp) OVER {W12} - min(systolic_bp) OVER {W12} AS br,
  count(spo2_pct) OVER {W12} AS no, avg(CAST(spo2_pct < 90 AS DOUBLE)) OVER {W12} AS ol, count(temperature_c) OVER {W12} AS nt, avg(CAST(temperature_c > 38.0 AS DOUBLE)) OVER {W12} AS th FROM panel)""",
    )
)
def a14_a17_variability(spark, sf_dir):
    return tidy(features.variability(panel(spark, sf_dir)), _VAR, digits=5)


@query(
    with_panel(
        f"""SELECT {KEYS}, round(map_current, 5) AS map_current, round(CASE WHEN n > 1 THEN avg(map_current) OVER {W12} END, 5) AS map_mean, round(CASE WHEN n > 1 THEN min(map_current) OVER {W12} END, 5) AS map_min,
  round(CASE WHEN systolic_bp IS NOT NULL THEN heart_rate / greatest(systolic_bp, 1e-8) END, 5) AS shock_index_current, round(CASE WHEN n > 1 THEN max(si) OVER {W12} END, 5) AS shock_index_max,
  CAST(q AS INTEGER) AS qsofa_score, CAST(sum(CAST(q >= 2 AS INTEGER)) OVER {W12} AS BIGINT) AS qsofa_ge2_hours, CAST(coalesce(lactate > 2, false) AS INTEGER) AS lactate_elevated, round(max(lactate) OVER {W12}, 5) AS lactate_max_window
  FROM (SELECT *, diastolic_bp + (systolic_bp - diastolic_bp) / 3 AS map_current, CASE WHEN systolic_bp IS NOT NULL THEN heart_rate / greatest(systolic_bp, 1.0) END AS si, count(*) OVER {W12} AS n,
    CAST(coalesce(respiratory_rate >= 22, false) AS INTEGER) + CAST(coalesce(systolic_bp <= 100, false) AS INTEGER) + CAST(coalesce(mobility_score <= 1, false) AS INTEGER) AS q FROM full_panel)"""
    )
)
def a18_a21_clinical(spark, sf_dir):
    out = features.clinical(panel(spark, sf_dir))
    return out.select(
        *KEY_COLUMNS,
        *[F.round(c, 5).alias(c) for c in ("map_current", "map_mean", "map_min", "shock_index_current", "shock_index_max", "lactate_max_window")],
        "qsofa_score",
        F.col("qsofa_ge2_hours").cast("long").alias("qsofa_ge2_hours"),
        "lactate_elevated",
    )


_LAG = lambda c, k: f"round(CASE WHEN row_number() OVER o > {k} THEN lag({c}, {k}) OVER o ELSE first_value({c}) OVER o END, 6) AS \"{c}_t-{k}\"" if k else f"round({c}, 6) AS \"{c}_t0\""
_FLAT = ["hr_dense", "sbp_dense"]


@query(with_panel(f"SELECT {KEYS}, {', '.join(_LAG(c, k) for k in (2, 1, 0) for c in _FLAT)} FROM panel WINDOW o AS (PARTITION BY patient_id ORDER BY hour_from_admission)"))
def w04_flatten(spark, sf_dir):
    out = features.flattened(panel(spark, sf_dir), _FLAT)
    return out.select(*KEY_COLUMNS, *[F.round(f"`{n}`", 6).alias(n) for k in ("t-2", "t-1", "t0") for n in [f"{c}_{k}" for c in _FLAT]])


_PAD = f""", pr AS (SELECT {KEYS}, list(hr_dense) OVER {W12} AS a FROM panel), pw AS (SELECT {KEYS}, list_concat(list_transform(range(12 - len(a)), lambda i: a[1]), a) AS a FROM pr)"""


@query(
    with_panel(
        f"""SELECT {KEYS}, round(list_avg(a), 5) AS hr_dense_mean, round(list_stddev_samp(a), 5) AS hr_dense_std, round(list_min(a), 5) AS hr_dense_min, round(list_max(a), 5) AS hr_dense_max,
  round(list_sort(a)[6], 5) AS hr_dense_median, round(list_sort(a)[10] - list_sort(a)[4], 5) AS hr_dense_iqr, round(list_max(a) - list_min(a), 5) AS hr_dense_range FROM pw""",
        _PAD,
    )
)
def features_padded(spark, sf_dir):
    return tidy(features.padded_statistics(panel(spark, sf_dir), ["hr_dense"]), [f"hr_dense_{k}" for k in ("mean", "std", "min", "max", "median", "iqr", "range")], digits=5)


@query(
    with_panel(
        f"""SELECT v.patient_id, v.hour_from_admission, round(hr_mean, 5) AS hr_mean, round(hr_max, 5) AS hr_max, round(map_current, 5) AS map_current, qsofa_score, {_LABEL.format(h=12)} AS label FROM v""",
        f""", ok AS (SELECT * FROM full_panel WHERE {_OK}), filled AS (SELECT {KEYS}, deterioration_hour, mobility_score, """
        + ", ".join(f"last_value({c} IGNORE NULLS) OVER {BACK} AS {c}" for c in ("heart_rate", "respiratory_rate", "systolic_bp", "diastolic_bp"))
        + f""" FROM ok), v AS (SELECT *, coalesce(avg(heart_rate) OVER {W12}, 0) AS hr_mean, coalesce(max(heart_rate) OVER {W12}, 0) AS hr_max, diastolic_bp + (systolic_bp - diastolic_bp) / 3 AS map_current,
  CAST(coalesce(respiratory_rate >= 22, false) AS INTEGER) + CAST(coalesce(systolic_bp <= 100, false) AS INTEGER) + CAST(coalesce(mobility_score <= 1, false) AS INTEGER) AS qsofa_score FROM filled)""",
    )
)
def flagship(spark, sf_dir):
    """Valid rows, carried forward, with trailing statistics, clinical scores and the 12-hour label: one shuffle by entity."""
    p = quality.valid_rows(panel(spark, sf_dir))
    p = impute.carry_forward(p, ["heart_rate", "respiratory_rate", "systolic_bp", "diastolic_bp"])
    w = features.frame()
    p = p.withColumns({"hr_mean": F.coalesce(F.avg("heart_rate").over(w), F.lit(0.0)), "hr_max": F.coalesce(F.max("heart_rate").over(w), F.lit(0.0))})
    p = labels.deterioration(features.clinical(p), (12,))
    return p.select(*KEY_COLUMNS, *[F.round(c, 5).alias(c) for c in ("hr_mean", "hr_max", "map_current")], "qsofa_score", F.col("deterioration_next_12h").alias("label"))
