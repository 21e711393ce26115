"""Evaluation of scores against binary labels.

Everything starts from counts by distinct score, so the data are aggregated once; cumulative counts run over that table, by
ranges of scores where it is large.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.checkpoints import cut
from tidewell.operators.drift import normal_share
from tidewell.operators.prefix import running_sums, tiles


def by_score(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    got = df.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = {
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": _ratio(tn, tn + fp),
    }
    return got.withColumns({k: F.round(v, 6) for k, v in rates.items()})


def curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``score, tp, fp, positives, negatives``: counts at each distinct threshold, highest first."""
    rows = running_sums(by_score(df, score, label), "score", ["pos", "neg"], descending=True)
    return rows.select("score", F.col("pos_upto").alias("tp"), F.col("neg_upto").alias("fp"), F.col("pos_all").alias("positives"), F.col("neg_all").alias("negatives"), "pos", "neg")


def auroc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The rank statistic, ties counted half."""
    c = curve(df, score, label)
    below = F.col("negatives") - F.col("fp")
    total = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    return c.agg(F.round(F.try_divide(total, F.max(F.col("positives").cast("double") * F.col("negatives"))), 6).alias("auroc"))


def auprc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Average precision: the sum of precision times the step in recall."""
    c = curve(df, score, label)
    return c.agg(F.round(F.sum(F.try_divide(F.col("pos") * F.col("tp"), F.col("positives") * (F.col("tp") + F.col("fp")))), 6).alias("auprc"))


def roc_points(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    c = curve(df, score, label)
    return c.select("score", F.round(F.col("fp") / F.col("negatives"), 6).alias("fpr"), F.round(F.col("tp") / F.col("positives"), 6).alias("tpr"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"))


def grid_counts(df: DataFrame, low: int, high: int, per: float, score: str = "score", label: str = "label") -> DataFrame:
    """``threshold, tp, fp, fn, tn`` on the grid low/per to high/per.

    A score counts at every grid point up to it: scores are counted by the last such point and summed from the top, so the
    data meet no grid.
    """
    step = F.least(F.greatest(F.floor(F.col(score) * per + 1e-9), F.lit(low - 1)), F.lit(high)).cast("int")
    # a score that rounding put on the wrong side of its grid point is moved back
    step = F.when((step >= low) & (F.col(score) < step / F.lit(per)), step - 1).when((step < high) & (F.col(score) >= (step + 1) / F.lit(per)), step + 1).otherwise(step)
    counts = df.groupBy(step.alias("k")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    grid = df.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("k"))
    w = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    full = grid.join(counts, "k", "left").select("k", zero("pos").alias("pos"), zero("neg").alias("neg"))
    out = full.select("k", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("n"))
    return out.filter(F.col("k") >= low).select((F.col("k") / F.lit(per)).alias("threshold"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))


def thresholds(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Five strategies on the grid 0.05 to 0.95; 0.5 where none fits."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    g = grid_counts(df, 10, 190, 200.0, score, label).withColumns(
        {"f1": _ratio(2 * tp, 2 * tp + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "youden": _ratio(tp, tp + fn) - _ratio(fp, fp + tn)}
    )
    t = F.col("threshold")
    first_max = lambda v, ok=None: F.max_by(t if ok is None else F.when(ok, t), F.struct(v if ok is None else F.when(ok, v), -t))
    default = lambda x: F.round(F.coalesce(x, F.lit(0.5)), 6)
    return g.agg(
        default(first_max(F.col("f1"))).alias("f1"),
        default(first_max(F.round("youden", 12))).alias("youden"),
        default(F.min(F.when(F.col("precision") >= 0.9, t))).alias("precision_90"),
        default(F.max(F.when(F.col("recall") >= 0.9, t))).alias("recall_90"),
        default(first_max(F.col("f1"), F.col("recall") >= 0.75)).alias("clinical"),
    )


def brier(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return df.agg(F.round(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))), 6).alias("brier"))


def calibration_error(df: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins [low, high); a score of 1 is in none but counts in the total."""
    per = df.groupBy(F.when(F.col(score) < 1, F.floor(F.col(score) * bins)).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("s"), F.avg(label).alias("y"))
    return per.agg(F.round(F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("s") - F.col("y")))) / F.sum("n"), 6).alias("ece"))


def temperature(df: DataFrame, score: str = "score", label: str = "label", steps: int = 490) -> DataFrame:
    """The temperature of 0.1, 0.11, ... with the least log loss, from counts by score; each task adds up all temperatures' losses."""
    p = F.least(F.greatest(F.col("score"), F.lit(1e-7)), F.lit(1 - 1e-7))
    rows = by_score(df, score, label).withColumn("z", F.ln(p / (1 - p)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's losses at all steps, and its rows: as many numbers as there are steps, whatever the task reads."""
        t, total, n = 0.1 + np.arange(steps) / 100.0, np.zeros(steps), 0.0
        for batch in batches:
            z, pos, neg = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(3))
            for a in range(0, len(z), 4096):
                q = np.clip(1 / (1 + np.exp(np.minimum(-z[a : a + 4096, None] / t, 700.0))), 1e-12, 1 - 1e-12)
                total -= pos[a : a + 4096] @ np.log(q) + neg[a : a + 4096] @ np.log(1 - q)
            n += pos.sum() + neg.sum()
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(total), pa.array(np.full(steps, n))], names=["t", "loss", "n"])

    sums = rows.select("z", F.col("pos").cast("double").alias("pos"), F.col("neg").cast("double").alias("neg")).mapInArrow(run, "t double, loss double, n double")
    loss = sums.groupBy("t").agg(F.try_divide(F.sum("loss"), F.sum("n")).alias("nll"))
    return loss.agg(F.round(F.min_by("t", F.struct(F.round("nll", 9), F.col("t"))), 6).alias("temperature"), F.round(F.min("nll"), 6).alias("nll"))


def subgroups(df: DataFrame, groups: list[str], threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """Counts and rates for each value of each grouping column, by grouping sets over one scan."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    sets = [[F.col(g)] for g in groups]
    got = df.groupingSets(sets, *groups).agg(
        F.count("*").alias("n"), F.sum(label).cast("long").alias("positives"), F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp")
    )
    return got.withColumns({"recall": F.round(_ratio(F.col("tp"), F.col("positives")), 6), "precision": F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6)})


def losses(df: DataFrame, score: str = "score", label: str = "label", gamma: float = 2.0, alpha: float = 0.25, smooth: float = 0.1) -> DataFrame:
    """Focal loss and label-smoothed cross entropy as means."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-7)), F.lit(1 - 1e-7))
    y = F.col(label)
    right, weight = F.when(y == 1, p).otherwise(1 - p), F.when(y == 1, alpha).otherwise(1 - alpha)
    soft = y * (1 - smooth) + smooth / 2
    return df.agg(
        F.round(F.avg(-weight * F.pow(1 - right, F.lit(gamma)) * F.ln(right)), 6).alias("focal"), F.round(F.avg(-(soft * F.ln(p) + (1 - soft) * F.ln(1 - p))), 6).alias("smoothed_bce")
    )


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Low and high end of the Wilson interval of ``hits`` in ``n``; null without rows."""
    rate = hits / n
    middle, half = rate + z * z / (2 * n), z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))
    end = lambda v: F.when(n > 0, v / (1 + z * z / n))
    return F.struct(end(middle - half).alias("low"), end(middle + half).alias("high"))


def reclassification(df: DataFrame, old: str, new: str, label: str = "label", cuts: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row: net reclassification over the classes between ``cuts``, and integrated discrimination improvement.

    One pass with partial sums. Rows with a null score or label take no part; without events, or without others, both are null.
    """
    level = lambda c: sum(((F.col(c) >= cut).cast("int") for cut in cuts), F.lit(0))
    rows = df.dropna(subset=[old, new, label]).select((F.col(label) == 1).alias("event"), F.signum(level(new) - level(old)).alias("move"), (F.col(new) - F.col(old)).alias("gain"))
    mean = lambda c, event: F.avg(F.when(F.col("event") == event, F.col(c)))
    return rows.agg((mean("move", True) - mean("move", False)).alias("nri"), (mean("gain", True) - mean("gain", False)).alias("idi"))


def delong(df: DataFrame, score: str = "score", label: str = "label", z: float = 1.96) -> DataFrame:
    """``auroc, se, low, high``: DeLong's standard error from the variance of placement values, and the interval.

    A placement is the share of the other class that a row is ranked above, ties half; rows of one score have the same, so the
    curve's table is enough. Null with fewer than two rows of a class.
    """
    c = curve(df, score, label)
    n, m = F.col("negatives").cast("double"), F.col("positives").cast("double")
    placed = c.select("pos", "neg", m.alias("m"), n.alias("n"), ((n - F.col("fp") + F.col("neg") / 2.0) / n).alias("v"), ((F.col("tp") - F.col("pos") / 2.0) / m).alias("w"))
    sums = placed.agg(F.max("m").alias("m"), F.max("n").alias("n"), F.sum(F.col("pos") * F.col("v")).alias("v1"), F.sum(F.col("pos") * F.col("v") * F.col("v")).alias("v2"), F.sum(F.col("neg") * F.col("w")).alias("w1"), F.sum(F.col("neg") * F.col("w") * F.col("w")).alias("w2"))
    spread = lambda k, one, two: F.try_divide(F.col(two) - F.col(one) * F.col(one) / F.col(k), (F.col(k) - 1) * F.col(k))
    got = sums.select((F.col("v1") / F.col("m")).alias("auroc"), F.sqrt(F.greatest(F.lit(0.0), spread("m", "v1", "v2") + spread("n", "w1", "w2"))).alias("_se"), (F.least("m", "n") > 1).alias("_enough"))
    se = F.when(F.col("_enough"), F.col("_se"))
    return got.select(F.round("auroc", 6).alias("auroc"), F.round(se, 6).alias("se"), F.round(F.col("auroc") - z * se, 6).alias("low"), F.round(F.col("auroc") + z * se, 6).alias("high"))


def _placements(df: DataFrame, score: str, label: str) -> DataFrame:
    """``score, v, w``: the shares of negatives below and of positives above each distinct score, ties half; counts of both classes."""
    c = curve(df, score, label)
    n, m = F.col("negatives").cast("double"), F.col("positives").cast("double")
    return c.select(F.col("score").alias(f"_{score}"), F.try_divide(n - F.col("fp") + F.col("neg") / 2.0, n).alias(f"v_{score}"), F.try_divide(F.col("tp") - F.col("pos") / 2.0, m).alias(f"w_{score}"))


def paired_delong(df: DataFrame, one: str, two: str, label: str = "label") -> DataFrame:
    """``auroc_one, auroc_two, difference, se, z, p_value``: DeLong's test of two scores of the same rows.

    Each score's placements are a table of distinct scores, made by ranges; rows look both up, and the rest is sums: variances and the
    covariance of the two placements among positives and among negatives. Rows with a null score or label take no part. Error and
    test are null with fewer than two rows of a class, the test also where the two rank all rows alike.
    """
    rows = df.dropna(subset=[one, two, label]).select(F.col(one).alias(one), F.col(two).alias(two), F.col(label).cast("int").alias(label))
    for score in (one, two):
        rows = rows.join(_placements(rows.select(score, label), score, label), F.col(score) == F.col(f"_{score}"))
    pos, neg = F.col(label) == 1, F.col(label) == 0
    among = lambda f, keep, *c: f(*[F.when(keep, F.col(x)) for x in c])
    sums = rows.agg(
        F.count_if(pos).alias("m"),
        F.count_if(neg).alias("n"),
        among(F.avg, pos, f"v_{one}").alias("a"),
        among(F.avg, pos, f"v_{two}").alias("b"),
        *[among(F.covar_samp, keep, f"{k}_{x}", f"{k}_{y}").alias(f"{k}{i}") for keep, k in ((pos, "v"), (neg, "w")) for i, (x, y) in enumerate(((one, one), (two, two), (one, two)))],
    )
    part = lambda i: F.try_divide(F.col(f"v{i}"), F.col("m")) + F.try_divide(F.col(f"w{i}"), F.col("n"))
    variance = F.greatest(part(0) + part(1) - 2 * part(2), F.lit(0.0))
    out = sums.withColumns({"d": F.col("a") - F.col("b"), "se": F.when(F.least("m", "n") > 1, F.sqrt(variance))})
    out = out.withColumn("z", F.when(F.col("se") > 1e-12, F.col("d") / F.col("se")))
    # of the z as it is; in one select with its rounding it would be that of the rounded one
    out = out.withColumn("p_value", F.when(F.col("z").isNotNull(), 2 * (1 - normal_share(F.abs("z")))))
    names = {"auroc_one": "a", "auroc_two": "b", "difference": "d", "se": "se", "z": "z", "p_value": "p_value"}
    return out.select(*[F.round(c, 6).alias(name) for name, c in names.items()])


def _uniforms(base: int, numbers: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 by a 32-bit mix of ``base`` and each of ``numbers``."""
    low = np.uint64(0xFFFFFFFF)
    h = np.uint64(base) ^ (numbers.astype(np.uint64) * np.uint64(0x9E3779B9) & low)
    h = (h ^ (h >> np.uint64(16))) * np.uint64(0x7FEB352D) & low
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0x846CA68B) & low
    return ((h ^ (h >> np.uint64(16))).astype(float) + 0.5) / 2**32


def replicate_weights(score: float, positive: bool, count: int, replicates: int, seed: int) -> np.ndarray:
    """How often the ``count`` rows of a score and class are drawn in each replicate: Poisson numbers that depend on these alone.

    They are read off the distribution function at a uniform number; for more than 64 rows, off the normal distribution.
    """
    if not count:
        return np.zeros(replicates)
    base = int(hashlib.md5(f"{seed}:{math.floor(score * 1e9 + 0.5)}:{int(positive)}".encode()).hexdigest()[:8], 16)
    number = 2 * np.arange(replicates)
    u = _uniforms(base, number + 1)
    if count <= 64:
        upto = np.cumsum([math.exp(j * math.log(count) - count - math.lgamma(j + 1)) for j in range(count + 120)])
        return np.searchsorted(upto, u, side="left").astype(float)
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * _uniforms(base, number + 2))
    return np.maximum(np.floor(count + math.sqrt(count) * z + 0.5), 0)


def bootstrap_auprc(df: DataFrame, score: str = "score", label: str = "label", replicates: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """``auprc, low, high``: the average precision and the interval of its Poisson bootstrap, from one table of counts by score.

    Ranges of scores, highest first, add up their weights of all replicates; what stands before a range is a table of one row of
    numbers for each range. Then each range adds its steps of all curves. Rows aren't read again for a replicate.
    """
    counts = by_score(df, score, label).filter("score is not null")
    placed = cut(counts.repartitionByRange(F.desc("score")).sortWithinPartitions(F.desc("score")).withColumn("part", F.spark_partition_id()))

    def weights(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s, pos, neg in zip(*(batch.column(k).to_pylist() for k in range(3))):
            yield replicate_weights(s, True, pos, replicates, seed), replicate_weights(s, False, neg, replicates, seed)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, (pos, neg) in zip(batch.column(3).to_pylist(), weights(batch)):
                held = by_part.setdefault(part, np.zeros((2, replicates)))
                held += (pos, neg)
        yield pa.RecordBatch.from_arrays([pa.array(list(by_part), pa.int32()), *[pa.array([list(v[k]) for v in by_part.values()], pa.list_(pa.float64())) for k in (0, 1)]], names=["part", "pos", "neg"])

    columns = placed.select("score", "pos", "neg", "part")
    sums = {r["part"]: np.array([r["pos"], r["neg"]]) for r in columns.mapInArrow(totals, "part int, pos array<double>, neg array<double>").toLocalIterator()}  # a row for each range
    before, whole = {}, np.zeros((2, replicates))
    for part in sorted(sums):
        before[part] = whole.copy()
        whole += sums[part]
    spread = df.sparkSession.sparkContext.broadcast((before, whole))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, total = spread.value
        at, area = {}, np.zeros(replicates)
        for batch in batches:
            for part, (pos, neg) in zip(batch.column(3).to_pylist(), weights(batch)):
                upto = at[part] = at.get(part, start[part]) + (pos, neg)
                area += pos * upto[0] / np.maximum(total[0], 1) / np.maximum(upto.sum(axis=0), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(area)], names=["replicate", "area"])

    curves = columns.mapInArrow(steps, "replicate long, area double").groupBy("replicate").agg(F.sum("area").alias("area"))
    ends = curves.agg(F.percentile("area", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("e"))  # as many rows as replicates
    return auprc(df, score, label).crossJoin(F.broadcast(ends)).select("auprc", F.round(F.col("e")[0], 6).alias("low"), F.round(F.col("e")[1], 6).alias("high"))


def age_band(age: Column) -> Column:
    return F.when(age < 50, "<50").when(age <= 70, "50-70").when(age > 70, ">70")


def stay_quartiles(df: DataFrame, key: str, hour: str) -> DataFrame:
    """``key, stay, quartile``: each entity's stay in rows' hours and its quartile among all entities, ties by key."""
    stays = df.groupBy(key).agg((F.max(hour) - F.min(hour) + 1).alias("stay"))
    return tiles(stays, ["stay", key], 4, "quartile")


def youden(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``threshold, j``: the score at which sensitivity exceeds the false positive rate most, of equals the highest; no row if
    none does. Compared in whole numbers, so ties are exact."""
    c = curve(df, score, label)
    gain = (F.col("tp") * F.col("negatives") - F.col("fp") * F.col("positives")).cast("double")
    rows = c.select("score", gain.alias("gain"), (F.col("positives").cast("double") * F.col("negatives")).alias("all")).filter("gain > 0")
    best = rows.agg(F.max_by(F.struct("score", "gain", "all"), F.struct("gain", "score")).alias("b")).filter("b is not null")
    return best.select(F.col("b.score").alias("threshold"), F.round(F.col("b.gain") / F.col("b.all"), 6).alias("j"))


def kaplan_meier(df: DataFrame, time: str, observed: str) -> DataFrame:
    """``time, at_risk, events, survival`` at each distinct time: the product of the shares that passed it without an event."""
    counts = df.filter(F.col(time).isNotNull()).groupBy(F.col(time).alias("time")).agg(F.count("*").alias("n"), F.count_if(F.col(observed)).alias("events"))
    risk = running_sums(counts, "time", ["n"]).select("time", "events", (F.col("n_all") - F.col("n_upto") + F.col("n")).alias("at_risk"))
    stay = F.col("at_risk") - F.col("events")
    steps = risk.withColumns({"_log": F.when(stay > 0, F.ln(stay / F.col("at_risk"))).otherwise(0.0), "_end": F.when(stay > 0, 0).otherwise(1)})
    out = running_sums(steps, "time", ["_log", "_end"])
    return out.select("time", "at_risk", "events", F.round(F.when(F.col("_end_upto") > 0, 0.0).otherwise(F.exp("_log_upto")), 6).alias("survival"))


def lead_times(alerts: DataFrame, escalations: DataFrame, key: str, at: str, level: str = "risk_level") -> DataFrame:
    """``escalations`` with ``first_alert`` and ``lead``: the time from the entity's first high or critical alert to the escalation,
    negative if the alert came later, null without one."""
    first = alerts.filter(F.col(level).isin("HIGH", "CRITICAL")).groupBy(key).agg(F.min(at).alias("first_alert"))
    return escalations.join(first, key, "left").withColumn("lead", F.col(at) - F.col("first_alert"))


def softmax(df: DataFrame, score: str, key: str, output: str = "weight") -> DataFrame:
    """``df`` with weights by ``exp(score)`` that add up to 1 within each ``key``; null for a null score."""
    own = Window.partitionBy(key)
    e = F.exp(F.col(score) - F.max(score).over(own))
    return df.withColumn("_e", e).withColumn(output, F.col("_e") / F.sum("_e").over(own)).drop("_e")
