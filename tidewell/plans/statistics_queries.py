"""Queries over paired tests, subgroups by age and stay, drift verdicts, tree models, mini-batches and the messages' table function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import alerts, attributions, drift, evaluation, grid, message_function, metrics, prefix, quality
from tidewell.plans.model_queries import _BAND, _FIRED, _HALF, _MESSAGE_FIELDS, _PROB, alert_rows, halves, messages, scored, with_probability
from tidewell.plans.oracle_text import KEYS, SCORED, SIGNALS, with_panel
from tidewell.plans.panel_queries import panel
from tidewell.schemas import ENTITY, HOUR
from tidewell.schemas import KEYS as KEY_COLUMNS
from tidewell.sources import minibatches

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _above_half(z: str) -> str:
    """What the normal distribution function has above one half at ``z``, 0 or more: its odd series, double factorials by the gamma function."""
    return f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 151), lambda k: exp((2 * k + 1) * ln(greatest({z}, 1e-12)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2))))"


def _placed(score: str) -> str:
    return f"avg(CASE WHEN x.{score} > y.{score} THEN 1.0 WHEN x.{score} = y.{score} THEN 0.5 ELSE 0.0 END)"


@query(
    f"""WITH {SCORED}, t AS (SELECT doc_id, label, score AS a, round((score + (n_chars % 977) / 977.0) / 2, 3) AS b FROM s),
p AS (SELECT x.doc_id, {_placed("a")} AS va, {_placed("b")} AS vb FROM t x JOIN t y ON x.label = 1 AND y.label = 0 GROUP BY x.doc_id),
q AS (SELECT y.doc_id, {_placed("a")} AS wa, {_placed("b")} AS wb FROM t x JOIN t y ON x.label = 1 AND y.label = 0 GROUP BY y.doc_id),
m AS (SELECT avg(va) AS a, avg(vb) AS b, (var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb)) / count(*) AS v FROM p), n AS (SELECT (var_samp(wa) + var_samp(wb) - 2 * covar_samp(wa, wb)) / count(*) AS w FROM q),
r AS (SELECT a, b, a - b AS d, sqrt(v + w) AS se, (a - b) / sqrt(v + w) AS z FROM m, n)
SELECT round(a, 6) AS auroc_one, round(b, 6) AS auroc_two, round(d, 6) AS difference, round(se, 6) AS se, round(z, 6) AS z, round(2 * (0.5 - {_above_half("abs(z)")}), 6) AS p_value FROM r"""
)
def a73_paired_delong(spark, sf_dir) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("other", F.round((F.col("score") + (F.col("n_chars") % 977) / 977.0) / 2, 3))
    return metrics.paired_delong(rows, "score", "other")


def _uniform(number: str) -> str:
    """A 32-bit mix of ``base`` and ``number``, as a number between 0 and 1."""
    x = f"xor(base, ({number}) * 2654435769 % 4294967296)"
    y = "(xor({0}, {0} >> 16) * 2146121005 % 4294967296)".format("x")
    z = "CAST(CAST(xor(y, y >> 15) AS HUGEINT) * 2221713035 % 4294967296 AS BIGINT)"
    return f"list_transform([{x}], lambda x: list_transform([{y}], lambda y: list_transform([{z}], lambda z: (xor(z, z >> 16) + 0.5) / 4294967296.0)[1])[1])[1]"


@query(
    f"""WITH {SCORED}, c AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score),
k AS (SELECT score, y, CAST(CASE WHEN y = 1 THEN pos ELSE neg END AS BIGINT) AS n, CAST('0x' || substr(md5('42:' || CAST(floor(score * 1e9 + 0.5) AS BIGINT) || ':' || y), 1, 8) AS BIGINT) AS base FROM c, (VALUES (1), (0)) v(y)),
m AS (SELECT *, list_transform(range(0, n + 120), lambda j: exp(j * ln(n) - n - lgamma(j + 1))) AS mass FROM k WHERE n > 0),
d AS (SELECT *, list_transform(range(1, len(mass) + 1), lambda j: list_sum(mass[1:j])) AS upto FROM m),
w AS (SELECT score, y, r, CASE WHEN n <= 64 THEN len(list_filter(upto, lambda x: x < u)) ELSE greatest(floor(n + sqrt(n) * sqrt(-2 * ln(u)) * cos(2 * pi() * v) + 0.5), 0) END AS w
  FROM (SELECT *, {_uniform("2 * r + 1")} AS u, {_uniform("2 * r + 2")} AS v FROM d, range(0, 2000) t(r))),
p AS (SELECT r, score, coalesce(sum(w) FILTER (y = 1), 0) AS pos, coalesce(sum(w) FILTER (y = 0), 0) AS neg FROM w GROUP BY r, score),
u AS (SELECT r, pos, sum(pos) OVER b AS tp, sum(neg) OVER b AS fp, sum(pos) OVER (PARTITION BY r) AS total FROM p WINDOW b AS (PARTITION BY r ORDER BY score DESC)),
e AS (SELECT r, sum(pos / greatest(total, 1) * tp / greatest(tp + fp, 1)) AS area FROM u GROUP BY r),
o AS (SELECT sum(pos) OVER () AS total, pos, sum(pos) OVER b AS tp, sum(neg) OVER b AS fp FROM c WINDOW b AS (ORDER BY score DESC))
SELECT (SELECT round(sum(pos * tp / (total * (tp + fp))), 6) FROM o) AS auprc, round(quantile_cont(area, 0.025), 6) AS low, round(quantile_cont(area, 0.975), 6) AS high FROM e"""
)
def a73_auprc_interval(spark, sf_dir) -> DataFrame:
    return metrics.bootstrap_auprc(scored(spark, sf_dir))


@query(
    with_panel(
        """SELECT age_group, quartile, count(*) AS n, CAST(sum(nurse_alert) AS BIGINT) AS positives, CAST(count_if(probability >= 0.5 AND nurse_alert = 1) AS BIGINT) AS tp, CAST(count_if(probability >= 0.5 AND nurse_alert = 0) AS BIGINT) AS fp,
  round(coalesce(count_if(probability >= 0.5 AND nurse_alert = 1) / nullif(sum(nurse_alert), 0), 0), 6) AS recall, round(coalesce(count_if(probability >= 0.5 AND nurse_alert = 1) / nullif(count_if(probability >= 0.5), 0), 0), 6) AS precision
  FROM (SELECT pr.*, quartile, CASE WHEN age < 50 THEN '<50' WHEN age <= 70 THEN '50-70' ELSE '>70' END AS age_group FROM pr JOIN q USING (patient_id)) GROUP BY GROUPING SETS ((age_group), (quartile))""",
        f"{_PROB}, q AS (SELECT patient_id, CAST(ntile(4) OVER (ORDER BY stay, patient_id) AS INTEGER) AS quartile FROM (SELECT patient_id, max(hour_from_admission) - min(hour_from_admission) + 1 AS stay FROM full_panel GROUP BY patient_id))",
    )
)
def a72_age_and_stay(spark, sf_dir) -> DataFrame:
    rows = with_probability(spark, sf_dir)
    quartiles = metrics.stay_quartiles(rows, ENTITY, HOUR).select(ENTITY, "quartile")
    return metrics.subgroups(rows.join(quartiles, ENTITY).withColumn("age_group", metrics.age_band(F.col("age"))), ["age_group", "quartile"], score="probability", label="nurse_alert")


@query(
    with_panel(
        f"""SELECT n, round(gap, 6) AS statistic, round(p, 6) AS p_value, p < 0.01 AS drifted FROM (SELECT n, gap, CASE WHEN sqrt(n) * gap < 0.2 THEN 1.0
  ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * n * gap * gap))), 0), 1) END AS p FROM g)""",
        f""", r AS (SELECT avg(hr_dense) AS mean, stddev_pop(hr_dense) AS std FROM panel WHERE {_HALF[0]}),
c AS (SELECT hr_dense AS x, count(*) AS c FROM panel WHERE {_HALF[1]} AND hr_dense IS NOT NULL GROUP BY hr_dense),
u AS (SELECT x, c, sum(c) OVER (ORDER BY x) AS upto, sum(c) OVER () AS n, least(greatest((x - mean) / std, -8), 8) AS z FROM c, r),
h AS (SELECT *, 0.5 + sign(z) * {_above_half("abs(z)")} AS share FROM u),
g AS (SELECT CAST(max(n) AS BIGINT) AS n, max(greatest(upto / n - share, share - (upto - c) / n)) AS gap FROM h)""",
    )
)
def a51_ks_verdict(spark, sf_dir) -> DataFrame:
    reference, live = halves(spark, sf_dir, ["hr_dense"])
    moments = reference.agg(F.avg("hr_dense").alias("mean"), F.stddev_pop("hr_dense").alias("std")).first()
    return drift.ks_against_normal(live, "hr_dense", moments["mean"], moments["std"])


_FLAT = """SELECT 'flat' AS feature, round(CASE WHEN max(ln) < 50 THEN 0 ELSE sum((l - r) * ln(l / r)) END, 6) AS psi FROM (
  SELECT b, greatest(coalesce(rn, 0) / sum(coalesce(rn, 0)) OVER (), 1e-8) AS r, greatest(coalesce(lv, 0) / sum(coalesce(lv, 0)) OVER (), 1e-8) AS l, sum(coalesce(lv, 0)) OVER () AS ln FROM range(10) x(b) LEFT JOIN (
    SELECT least(floor((x - 4.5) / (1.0 / 10)), 9) AS k, count_if(NOT late) AS rn, count_if(late) AS lv FROM f WHERE x BETWEEN 4.5 AND 5.5 GROUP BY 1) ON k = b)"""


@query(with_panel(f"{_FLAT} UNION ALL SELECT 'rare', 0.0", f", f AS (SELECT {_HALF[1]} AS late, CAST(CASE WHEN {_HALF[1]} THEN 5 + patient_id % 3 / 4.0 ELSE 5 END AS DOUBLE) AS x FROM panel)"))
def a50_psi_constant(spark, sf_dir) -> DataFrame:
    """A feature with one value in the reference, whose range is widened, and one with a single value at all."""
    before, after = halves(spark, sf_dir, [ENTITY])
    rare = F.when(F.col(ENTITY) < 0, 1.0).cast("double")
    first = before.select(F.lit(5.0).alias("flat"), rare.alias("rare")).unionByName(before.sparkSession.createDataFrame([(None, 1.0)], "flat double, rare double"))
    return drift.psi(first, after.select((5 + F.col(ENTITY) % 3 / 4.0).alias("flat"), rare.alias("rare")), ["flat", "rare"])


_TREE = """, f AS (SELECT patient_id, hour_from_admission, coalesce(heart_rate, 0) > 90 AS h, coalesce(spo2_pct, 0) > 95 AS s, coalesce(lactate, 0) > 2 AS l FROM panel),
t AS (SELECT count(*) AS n, count_if(NOT h) AS a, count_if(h) AS b, count_if(NOT h AND NOT s) AS a0, count_if(NOT h AND s) AS a1, count_if(h AND NOT l) AS b0, count_if(h AND l) AS b1 FROM f),
z AS (SELECT *, unnest([{'v': 0.9, 'up': 0, 'second': 0}, {'v': 0.1, 'up': 0, 'second': 1}, {'v': 0.3, 'up': 1, 'second': 0}, {'v': 0.8, 'up': 1, 'second': 1}]) AS leaf FROM t),
y AS (SELECT leaf.v AS v, leaf.up AS up, leaf.second AS second, CASE WHEN leaf.up = 0 THEN a / n ELSE b / n END AS zh,
  coalesce(CASE WHEN leaf.up = 0 THEN (CASE WHEN leaf.second = 0 THEN a0 ELSE a1 END) / nullif(a, 0) ELSE (CASE WHEN leaf.second = 0 THEN b0 ELSE b1 END) / nullif(b, 0) END, 0) AS zs FROM z),
o AS (SELECT f.patient_id, f.hour_from_admission, v, up, zh, zs, CAST(CAST(h AS INTEGER) = up AS INTEGER) AS oh, CAST((CASE WHEN up = 0 THEN CAST(s AS INTEGER) ELSE CAST(l AS INTEGER) END) = second AS INTEGER) AS os FROM f, y)"""
_SHARE = "v * ({0} - {1}) * ({2} + {3}) / 2"


def _panel_tree(p: DataFrame) -> list[attributions.Leaves]:
    """A tree of two levels whose covers are the panel's rows: heart rate, then saturation or lactate."""
    h, s, lac = (F.coalesce(F.col(c), F.lit(0.0)) > at for c, at in (("heart_rate", 90), ("spo2_pct", 95), ("lactate", 2)))
    of = {"n": F.lit(True), "a": ~h, "b": h, "a0": ~h & ~s, "a1": ~h & s, "b0": h & ~lac, "b1": h & lac}
    row = p.agg(*[F.count_if(c).alias(n) for n, c in of.items()]).first()
    nodes = [("n", 0, 90.0, 1, 2, 0.0), ("a", 1, 95.0, 3, 4, 0.0), ("b", 2, 2.0, 5, 6, 0.0), ("a0", -1, None, -1, -1, 0.9), ("a1", -1, None, -1, -1, 0.1), ("b0", -1, None, -1, -1, 0.3), ("b1", -1, None, -1, -1, 0.8)]
    table = [(0, k, f, t, left, right, float(row[n]), v) for k, (n, f, t, left, right, v) in enumerate(nodes)]
    return attributions.leaves(p.sparkSession.createDataFrame(table, attributions.NODES))


_TREE_FEATURES = ["heart_rate", "spo2_pct", "lactate"]


@query(
    with_panel(
        f"""SELECT {KEYS}, round(sum({_SHARE.format("oh", "zh", "os", "zs")}), 6) + 0.0 AS heart_rate, round(sum(CASE WHEN up = 0 THEN {_SHARE.format("os", "zs", "oh", "zh")} ELSE 0 END), 6) + 0.0 AS spo2_pct,
  round(sum(CASE WHEN up = 1 THEN {_SHARE.format("os", "zs", "oh", "zh")} ELSE 0 END), 6) + 0.0 AS lactate FROM o GROUP BY ALL""",
        _TREE,
    )
)
def m09_tree_attributions(spark, sf_dir) -> DataFrame:
    p = panel(spark, sf_dir)
    shown = attributions.attribute(p.select(*KEY_COLUMNS, *_TREE_FEATURES), _panel_tree(p), _TREE_FEATURES)
    return shown.select(*KEY_COLUMNS, *[(F.round(F.element_at("attributions", k + 1), 6) + F.lit(0.0)).alias(f) for k, f in enumerate(_TREE_FEATURES)])


@query(with_panel(f"SELECT {KEYS}, CAST(CASE WHEN coalesce(heart_rate, 0) > 90 THEN CASE WHEN coalesce(lactate, 0) > 2 THEN 0.8 ELSE 0.3 END ELSE CASE WHEN coalesce(spo2_pct, 0) > 95 THEN 0.1 ELSE 0.9 END END AS DOUBLE) AS margin FROM panel"))
def m01_tree_scores(spark, sf_dir) -> DataFrame:
    p = panel(spark, sf_dir)
    return attributions.score(p.select(*KEY_COLUMNS, *_TREE_FEATURES), _panel_tree(p), _TREE_FEATURES).select(*KEY_COLUMNS, "margin")


@query(
    with_panel(
        f"SELECT {KEYS}, CAST(i // 64 AS BIGINT) AS batch, CAST(i % 64 AS INTEGER) AS place FROM (SELECT {KEYS}, row_number() OVER (ORDER BY md5('42:1:' || patient_id || ':' || hour_from_admission), patient_id, hour_from_admission) - 1 AS i, count(*) OVER () AS n FROM panel) WHERE i // 64 < n // 64"
    )
)
def p33_batches(spark, sf_dir) -> DataFrame:
    return minibatches.numbered(panel(spark, sf_dir).select(*KEY_COLUMNS), KEY_COLUMNS, 64, epoch=1, drop_last=True).select(*KEY_COLUMNS, "batch", "place")


_ROWS = " UNION ALL ".join(f"SELECT patient_id || '-' || hour_from_admission AS control_id, CAST(patient_id AS VARCHAR) AS mrn, {k} AS position, '{c}' AS text, round({c}, 3) AS number FROM full_panel" for k, c in enumerate(_MESSAGE_FIELDS, 1))


@query(with_panel(_ROWS))
def x01_message_function(spark, sf_dir) -> DataFrame:
    message_function.register(spark)
    messages(spark, sf_dir).createOrReplaceTempView("tidewell_messages")
    return spark.sql("SELECT o.control_id, o.mrn, o.position, o.text, o.number FROM tidewell_messages m, LATERAL parse_message(m.message) o")


@query(
    f"""WITH RECURSIVE {with_panel("", _FIRED)[5:]}, one AS (SELECT rule, any_value(cooldown) AS wait, hour_from_admission * 60 + patient_id % 60 AS t, min(patient_id) AS patient_id FROM fired GROUP BY ALL),
r AS (SELECT rule, any_value(wait) AS wait, min(t) AS t FROM one GROUP BY rule UNION ALL SELECT r.rule, wait, (SELECT min(o.t) FROM one o WHERE o.rule = r.rule AND o.t >= r.t + r.wait) FROM r WHERE r.t IS NOT NULL)
SELECT r.rule, o.patient_id, CAST(r.t AS BIGINT) AS second FROM r JOIN one o ON o.rule = r.rule AND o.t = r.t"""
)
def w19_own_cooldowns(spark, sf_dir) -> DataFrame:
    """The rules' own cooldowns, an hour of the panel counting as a minute."""
    rows = alerts.fired(alert_rows(spark, sf_dir)).withColumn("ts", F.timestamp_seconds(F.col(HOUR) * 60 + F.col(ENTITY) % 60))
    return alerts.cool_down(rows).select("rule", ENTITY, F.unix_timestamp("ts").alias("second"))


@query(
    with_panel(
        f"""SELECT 'active_patients_by_risk' AS name, 'level=' || l AS labels, CAST(count(level) AS DOUBLE) AS value FROM (VALUES ('LOW'), ('MODERATE'), ('HIGH'), ('CRITICAL')) v(l)
  LEFT JOIN (SELECT {_BAND} AS level FROM (SELECT patient_id, arg_max(probability, hour_from_admission) AS probability FROM pr GROUP BY patient_id)) ON l = level GROUP BY l
UNION ALL SELECT 'model_auroc', 'model=' || gender, round(sum(CASE WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0 END) / count(*), 6) FROM (SELECT x.gender, x.probability AS a, y.probability AS b FROM few x JOIN few y ON x.gender = y.gender AND x.nurse_alert = 1 AND y.nurse_alert = 0) GROUP BY gender
UNION ALL SELECT 'model_f1', 'model=' || gender, round(2.0 * count_if(probability >= 0.5 AND nurse_alert = 1) / (count_if(probability >= 0.5) + count_if(nurse_alert = 1)), 6) FROM few GROUP BY gender""",
        f"{_PROB}, few AS (SELECT gender, round(probability, 3) AS probability, nurse_alert FROM pr WHERE probability IS NOT NULL)",
    )
)
def k14_gauges(spark, sf_dir) -> DataFrame:
    rows = with_probability(spark, sf_dir)
    latest = rows.groupBy(ENTITY).agg(F.max_by("probability", HOUR).alias("probability"))
    evaluated = rows.filter("probability is not null").select("gender", F.round("probability", 3).alias("score"), F.col("nurse_alert").cast("long").alias("label"))
    return evaluation.gauges(latest, evaluated, "probability", "gender")


@query(with_panel(f"SELECT {KEYS}, row_number() OVER (ORDER BY patient_id, hour_from_admission) - 1 AS position FROM panel"))
def o01_panel_order(spark, sf_dir) -> DataFrame:
    """The panel in order, each row's position read off the order of the files' partitions and rows."""
    ordered = grid.in_order(panel(spark, sf_dir).select(*KEY_COLUMNS)).withColumn("_at", F.monotonically_increasing_id())
    return prefix.row_numbers(ordered, ["_at"], "position", "_all").select(*KEY_COLUMNS, "position")


@query(with_panel(f"SELECT {KEYS}, hr_dense, CAST(NULL AS DOUBLE) AS lactate FROM panel WHERE {_HALF[0]} UNION ALL SELECT {KEYS}, NULL, lactate FROM panel WHERE {_HALF[1]}"))
def u01_concatenated(spark, sf_dir) -> DataFrame:
    before, after = halves(spark, sf_dir, [*KEY_COLUMNS, "hr_dense", "lactate"])
    return grid.concatenate(before.drop("lactate"), after.drop("hr_dense"))


@query(with_panel(f"SELECT {KEYS}, concat_ws(',', {', '.join(f'CASE WHEN {c} IS NULL THEN {chr(39)}{c}{chr(39)} END' for c in SIGNALS)}, 'crp_level') AS missing FROM panel"))
def u02_missing_fields(spark, sf_dir) -> DataFrame:
    rows = quality.missing_fields(panel(spark, sf_dir), [*SIGNALS, "crp_level"])
    return rows.select(*KEY_COLUMNS, F.array_join("missing_fields", ",").alias("missing"))
