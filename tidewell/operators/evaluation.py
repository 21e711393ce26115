"""Evaluation by group, reference statistics, and summaries of predictions. A null score or label takes no part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.prefix import exact_percentiles, running_sums_by, stacked_values
from tidewell.operators.risk import LEVELS, band
from tidewell.schemas import ENTITY, HOUR

# Upper ends of the latency (seconds) and confidence buckets.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
CONFIDENCE_BUCKETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def stacked(df: DataFrame, pairs: dict[str, tuple[str, str]], name: str = "outcome") -> DataFrame:
    """``name, score, label``: a row for each row of ``df`` and each named pair of a score and a label column."""
    rows = F.array(*[F.struct(F.lit(n).alias(name), F.col(s).cast("double").alias("score"), F.col(y).cast("long").alias("label")) for n, (s, y) in pairs.items()])
    return df.select(F.inline(rows)).filter("score is not null and label is not null")


def by_group(rows: DataFrame, group: str, threshold: float = 0.5, digits: int = 6) -> DataFrame:
    """``group, n, positives, auroc, auprc, recall, specificity`` of each group's ``score`` and ``label``.

    Groups without positives are left out. Data are aggregated to distinct scores of a group, and these are summed by ranges.
    """
    counts = rows.groupBy(group, "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    counts = running_sums_by(counts, group, "score", ["pos", "neg"], descending=True)
    counts = counts.withColumnsRenamed({"pos_upto": "tp", "neg_upto": "fp", "pos_all": "p", "neg_all": "n_neg"})
    hit = F.col("score") >= threshold
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, n = F.max("p"), F.max("n_neg")
    out = counts.groupBy(group).agg(
        (p + n).alias("n"),
        p.alias("positives"),
        F.round(ratio(F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("neg") / 2)), p * n), digits).alias("auroc"),
        F.round(F.sum(F.try_divide(F.col("pos") * F.col("tp"), F.col("p") * (F.col("tp") + F.col("fp")))), digits).alias("auprc"),
        F.round(ratio(F.sum(F.when(hit, F.col("pos")).otherwise(0)), p), digits).alias("recall"),
        F.round(ratio(F.sum(F.when(~hit, F.col("neg")).otherwise(0)), n), digits).alias("specificity"),
    )
    return out.filter("positives > 0")


def shadow_metrics(pairs: DataFrame, champion: str, challenger: str, label: str) -> DataFrame:
    """One row: both models' AUROC and AUPRC on the same labelled rows, 0 without both classes, and the differences."""
    both = stacked(pairs.filter(F.col(champion).isNotNull() & F.col(challenger).isNotNull()), {"champion": (champion, label), "challenger": (challenger, label)}, "model")
    got = by_group(both, "model", digits=9)
    of = lambda m, c: F.coalesce(F.max(F.when((F.col("model") == m) & (F.col("positives") < F.col("n")), F.col(c))), F.lit(0.0))
    row = got.agg(F.coalesce(F.max("n"), F.lit(0)).alias("labelled"), *[of(m, c).alias(f"{m}_{c}") for m in ("champion", "challenger") for c in ("auroc", "auprc")])
    return row.withColumns({f"{c}_delta": F.round(F.col(f"challenger_{c}") - F.col(f"champion_{c}"), 6) for c in ("auroc", "auprc")})


def paired_predictions(inputs: DataFrame, champion: Column, challenger: Column) -> DataFrame:
    """``inputs`` with both models' scores of the same row; no join."""
    return inputs.withColumns({"champion_prob": champion, "challenger_prob": challenger})


def multi_task_loss(rows: DataFrame, weights: dict[str, float] | None = None, most: float = 20.0) -> DataFrame:
    """``outcome, pos_weight, loss``: class-weighted cross-entropy of each outcome's logits (``score``), times its task weight.

    Positives weigh negatives over positives, ``most`` at most, one row of each class at least. A loss is a mean over rows. One
    aggregation: the weight enters the sum of the positives' part.
    """
    x = F.col("score")
    soft = F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))  # -log(sigmoid(x)), without overflow
    sums = rows.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("label").alias("p"), F.sum(F.when(F.col("label") == 1, soft)).alias("on_pos"), F.sum(F.when(F.col("label") == 0, soft + x)).alias("on_neg"))
    positives = F.greatest("p", F.lit(1)).cast("double")
    weight = F.least(F.greatest(F.col("n") - positives, F.lit(1.0)) / positives, F.lit(most))
    task = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in (weights or {"": 1.0}).items() for v in kv]), "outcome"), F.lit(1.0))
    loss = (weight * F.coalesce("on_pos", F.lit(0.0)) + F.coalesce("on_neg", F.lit(0.0))) / F.col("n")
    return sums.select("outcome", F.round(weight, 6).alias("pos_weight"), F.round(task * loss, 6).alias("loss"))


def reference_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, mean, std, median, q25, q75`` (population deviation, interpolated quartiles) of the values that aren't null or NaN."""
    moments = stacked_values(df, list(columns)).groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    out = moments.join(exact_percentiles(df, list(columns), {"median": 0.5, "q25": 0.25, "q75": 0.75}), "feature")
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "q25", "q75")])


def weighted_metric(rows: DataFrame, group: str, metric: str, weight: str) -> DataFrame:
    """``group`` and the mean of ``metric``, weighted; the plain mean if no weight is above 0."""
    total = F.sum(F.when(F.col(metric).isNotNull(), F.col(weight)))
    mean = F.when(total > 0, F.sum(F.col(metric) * F.col(weight)) / total).otherwise(F.avg(metric))
    return rows.groupBy(group).agg(F.round(mean, 6).alias(metric))


def watchlist_counts(df: DataFrame, p: str) -> DataFrame:
    level = band(F.col(p))
    return df.agg(F.count_if(level == "CRITICAL").alias("critical"), F.count_if(level == "HIGH").alias("high"), F.count(p).alias("total"))


def batch_summary(df: DataFrame, p: str, millis: str) -> DataFrame:
    """Number of predictions, those of high or critical risk, and the mean time; 0 for an empty batch."""
    high = F.count_if(band(F.col(p)).isin("HIGH", "CRITICAL") & F.col(p).isNotNull())
    return df.agg(F.count("*").alias("total"), high.alias("high_risk"), F.round(F.coalesce(F.avg(millis), F.lit(0.0)), 2).alias("mean_ms"))


def bucket_counts(df: DataFrame, value: str, buckets: Sequence[float], group: str | None = None) -> DataFrame:
    """``le, n``: how many values are at most each bucket's upper end, the last without one; one pass."""
    ends = [*buckets, float("inf")]
    x = F.col(value)
    totals = (df.groupBy(group) if group else df).agg(*[F.count_if(x <= e).alias(f"_{k}") for k, e in enumerate(ends)])
    rows = F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"_{k}").alias("n")) for k, e in enumerate(ends)])
    return totals.select(*([group] if group else []), F.inline(rows))


def most_recent(df: DataFrame, n: int, order: str, *tie: str) -> DataFrame:
    """The ``n`` newest rows: a top-n in each task, then of these."""
    return df.orderBy(F.desc(order), *tie).limit(n)


def with_trend(df: DataFrame, p: str, still: float = 0.01, key: str = ENTITY, order: str = HOUR) -> DataFrame:
    """``df`` with ``trend``: up, down or level, by the change since the entity's row before; level for its first."""
    change = F.col(p) - F.lag(p).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("trend", F.when(change > still, "↑").when(change < -still, "↓").otherwise("→"))


def highest(df: DataFrame, p: str, *tie: str) -> DataFrame:
    """The row of the largest ``p``, of equals the first by ``tie``."""
    return most_recent(df.filter(F.col(p).isNotNull()), 1, p, *tie)


def best_run(runs: DataFrame, metric: str, larger: bool = True, *tie: str) -> DataFrame:
    """The run with the best value of a metric; runs without it take no part."""
    known = runs.filter(F.col(metric).isNotNull())
    return known.orderBy(F.desc(metric) if larger else F.asc(metric), *tie).limit(1)


def first_statics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each entity the first value of each column that isn't null, by hour."""
    return df.groupBy(ENTITY).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(HOUR))).alias(c) for c in columns])


def to_devices(alerts: DataFrame, carers: DataFrame, devices: DataFrame) -> DataFrame:
    """A row for each alert and each active device of a physician of its patient."""
    return alerts.join(carers, ENTITY).join(devices.filter("active"), "physician_id")


def with_context(trigger: DataFrame, recent: DataFrame, key: str = "id") -> DataFrame:
    """The triggering rows and the recent ones, without recent rows of the same key."""
    return trigger.unionByName(recent.join(trigger.select(key), key, "left_anti").select(*trigger.columns))


def exposition(predictions: DataFrame, p: str, seconds: str, model: str) -> DataFrame:
    """``name, labels, value``: counters by model and level, and cumulative histograms of latency and confidence by model.

    The predictions are read once and summed by model and level; the metrics are added up from that small table.
    """
    kinds = {"latency_seconds": (seconds, LATENCY_BUCKETS), "confidence": (p, CONFIDENCE_BUCKETS)}
    upto = {f"{n}_bucket|{e}": F.count_if(F.col(c) <= e) for n, (c, ends) in kinds.items() for e in (*ends, float("inf"))}
    # decimals, so that a sum doesn't depend on the order of the rows
    sums = {f"{n}_sum|": F.sum(F.col(c).cast("decimal(28,9)")) for n, (c, _) in kinds.items()}
    small = predictions.groupBy(F.col(model).alias("model"), band(F.col(p)).alias("level")).agg(F.count("*").alias("predictions_total"), *[x.cast("decimal(38,9)").alias(k) for k, x in (upto | sums).items()])
    of = lambda *more: F.concat_ws(",", F.concat(F.lit("model="), "model"), *more)
    entry = lambda n, labels, v: F.struct(F.lit(n).alias("name"), labels.alias("labels"), v.cast("decimal(38,9)").alias("value"))
    rows = [entry("predictions_total", of(F.concat(F.lit("level="), "level")), F.col("predictions_total"))]
    for k in (*upto, *sums):
        name, _, end = k.partition("|")
        rows.append(entry(name, of(F.lit("le=+Inf" if end == "inf" else f"le={end}")) if end else of(), F.col(f"`{k}`")))
    return small.select(F.inline(F.array(*rows))).groupBy("name", "labels").agg(F.round(F.sum("value").cast("double"), 6).alias("value"))


def gauges(latest: DataFrame, evaluated: DataFrame, p: str, model: str, threshold: float = 0.5) -> DataFrame:
    """``name, labels, value``: how many entities are at each level now (``latest`` has a row for each), and each model's area under the
    ROC curve and F1 on the evaluated rows (``score``, ``label``); levels without entities are 0.
    """
    levels = latest.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    now = latest.groupBy(band(F.col(p)).alias("level")).agg(F.count("*").alias("n"))
    active = levels.join(F.broadcast(now), "level", "left")  # four rows
    active = active.select(F.lit("active_patients_by_risk").alias("name"), F.concat(F.lit("level="), "level").alias("labels"), F.coalesce("n", F.lit(0)).cast("double").alias("value"))
    hit, y = F.col("score") >= threshold, F.col("label") == 1
    f1 = evaluated.groupBy(model).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    f1 = f1.select(model, F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("v"))
    area = by_group(evaluated, model, threshold).select(model, F.col("auroc").alias("v"))
    of = lambda name, rows: rows.select(F.lit(name).alias("name"), F.concat(F.lit("model="), model).alias("labels"), F.round("v", 6).alias("value"))
    return active.unionByName(of("model_auroc", area)).unionByName(of("model_f1", f1))


def find(df: DataFrame, p: str, name: str, level: str | None = None, text: str | None = None, most: int | None = None) -> DataFrame:
    """Rows of a risk level whose name holds ``text`` in any case, by level, then falling probability, then name; ``most`` at most."""
    out = df.withColumn("risk_level", band(F.col(p)))
    if level is not None:
        out = out.filter(F.col("risk_level") == level)
    if text:
        out = out.filter(F.contains(F.lower(F.col(name).cast("string")), F.lit(text.lower())))
    place = F.array_position(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MODERATE", "LOW"))), F.col("risk_level"))
    out = out.orderBy(place, F.desc(p), name)
    return out if most is None else out.limit(most)
