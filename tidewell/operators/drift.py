"""Feature and prediction drift against a reference sample."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.prefix import running_sums


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``bin, n, share``: equal widths from minimum to maximum, the last bin closed, shares at least 1e-8."""
    edges = widened(df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
    counts = _binned(df, edges, column, bins)
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return full.select("bin", "n", F.greatest(F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)), F.lit(1e-8)).alias("share"))


def widened(edges: DataFrame) -> DataFrame:
    """A range of one value reaches half a unit each way."""
    one = F.col("lo") == F.col("hi")
    return edges.withColumns({"lo": F.when(one, F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(one, F.col("hi") + 0.5).otherwise(F.col("hi"))})


def _binned(df: DataFrame, edges: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts by bin; values outside the edges are dropped."""
    x = F.col(column)
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    inside = df.filter(x.isNotNull()).crossJoin(F.broadcast(edges)).filter(x.between(F.col("lo"), F.col("hi")))
    return inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def psi(reference: DataFrame, live: DataFrame, columns: list[str], bins: int = 10, least: int = 50, buffered: int = 100) -> DataFrame:
    """``feature, psi``: population stability of each column; 0 with fewer than ``least`` live values inside the edges, and for
    all columns with fewer than ``buffered`` live rows."""
    stack = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns])).alias("r")).select("r.*").filter("x is not null")
    ref, now = stack(reference), stack(live)
    edges = widened(ref.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    both = ref.withColumn("live", F.lit(0)).unionByName(now.withColumn("live", F.lit(1)))
    # one row for each feature, so the edges are small whatever the data
    placed = both.join(F.broadcast(edges), "feature").filter(F.col("x").between(F.col("lo"), F.col("hi")))
    counts = placed.groupBy("feature", at.alias("bin")).agg(F.count_if(F.col("live") == 0).alias("r"), F.count_if(F.col("live") == 1).alias("l"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counts, ["feature", "bin"], "left").fillna(0, ["r", "l"])
    w = Window.partitionBy("feature")
    share = lambda c: F.greatest(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(1e-8))
    parts = full.select("feature", "l", ((share("l") - share("r")) * F.ln(share("l") / share("r"))).alias("part"))
    rows = live.agg(F.count("*").alias("rows"))  # one row
    sums = parts.groupBy("feature").agg(F.sum("l").alias("l"), F.sum("part").alias("part")).join(F.broadcast(rows))
    return sums.select("feature", F.round(F.when((F.col("l") < least) | (F.col("rows") < buffered), 0.0).otherwise(F.col("part")), 6).alias("psi"))


def ks_statistic(reference: DataFrame, live: DataFrame, column: str) -> DataFrame:
    """Exact two-sample statistic: the largest gap between the two empirical distributions, from counts by value."""
    tagged = reference.select(F.col(column).alias("x"), F.lit(1).alias("r"), F.lit(0).alias("l")).unionByName(live.select(F.col(column).alias("x"), F.lit(0).alias("r"), F.lit(1).alias("l")))
    counts = tagged.filter("x is not null").groupBy("x").agg(F.sum("r").alias("r"), F.sum("l").alias("l"))
    sums = running_sums(counts, "x", ["r", "l"])
    gap = F.abs(F.col("r_upto") / F.col("r_all") - F.col("l_upto") / F.col("l_all"))
    return sums.select(gap.alias("gap")).agg(F.round(F.max("gap"), 6).alias("ks"))


def normal_share(z: Column) -> Column:
    """The normal distribution function, by its odd series within eight deviations."""
    inside = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    step = lambda acc, k: F.struct((acc["term"] * inside * inside / (2 * k + 1)).alias("term"), (acc["sum"] + acc["term"] * inside * inside / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(150)), F.struct(inside.alias("term"), inside.alias("sum")), step)["sum"]
    return F.least(F.greatest(0.5 + series * F.exp(-inside * inside / 2) / math.sqrt(2 * math.pi), F.lit(0.0)), F.lit(1.0))


def kolmogorov_tail(statistic: Column, n: Column) -> Column:
    """The probability of a larger gap between a sample of ``n`` and its distribution, by the limit's series; 1 for a gap near 0."""
    x = F.sqrt(n.cast("double")) * statistic
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))


def ks_against_normal(live: DataFrame, column: str, mean: float, std: float, level: float = 0.01, buffered: int = 100) -> DataFrame:
    """``n, statistic, p_value, drifted``: the largest gap between the live values' distribution and the normal one with the reference's
    moments, its p-value, and whether that is below ``level``. With fewer than ``buffered`` live rows 0, 1 and not drifted.
    """
    counts = live.select(F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x)").groupBy("x").agg(F.count("*").alias("c"))
    placed = running_sums(counts, "x", ["c"])
    share = normal_share((F.col("x") - F.lit(float(mean))) / F.lit(max(float(std), 1e-8)))
    upto, before = F.col("c_upto") / F.col("c_all"), (F.col("c_upto") - F.col("c")) / F.col("c_all")
    row = placed.select("c_all", F.greatest(upto - share, share - before).alias("gap")).agg(F.coalesce(F.max("c_all"), F.lit(0)).alias("n"), F.max("gap").alias("gap"))
    rows = live.agg(F.count("*").alias("rows"))  # one row
    enough = (F.col("rows") >= buffered) & (F.col("n") > 0)
    p = F.when(enough, kolmogorov_tail(F.col("gap"), F.col("n"))).otherwise(1.0)
    return row.crossJoin(F.broadcast(rows)).select("n", F.round(F.when(enough, F.col("gap")).otherwise(0.0), 6).alias("statistic"), F.round(p, 6).alias("p_value"), (p < level).alias("drifted"))


def severity(value: str = "psi"):
    c = F.col(value)
    return F.when(c > 0.25, "significant").when(c > 0.2, "high").when(c > 0.1, "moderate").otherwise("none")


def report(psis: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` drifted features with severity, and the overall advice on each row."""
    every = Window.partitionBy()
    drifted = F.avg((F.col("psi") > 0.2).cast("double")).over(every)
    advice = F.when(drifted > 0.3, "RETRAIN_RECOMMENDED").when(drifted > 0, "MONITOR").otherwise("STABLE")
    out = psis.select("feature", "psi", severity().alias("severity"), F.round(F.avg("psi").over(every), 6).alias("mean_psi"), advice.alias("advice"))
    return out.orderBy(F.desc("psi"), "feature").limit(most)


def prediction_drift(reference: DataFrame, live: DataFrame, score: str, least: int = 50, limit: float = 0.2) -> DataFrame:
    """Relative shift of the mean score, and whether it exceeds the limit."""
    a = reference.agg(F.avg(score).alias("a"), F.count(score).alias("n"))
    b = live.agg(F.avg(score).alias("b"), F.count(score).alias("m"))
    shift = F.abs(F.col("b") - F.col("a")) / F.greatest(F.abs("a"), F.lit(1e-8))
    return a.crossJoin(b).select(F.round(shift, 6).alias("shift"), ((F.col("m") >= least) & (shift > limit)).alias("drifted"))


def should_retrain(state: DataFrame, least: int = 5000):
    """``drifted, samples, busy, shadow_running`` → one gate column."""
    return state.withColumn("retrain", F.col("drifted") & (F.col("samples") >= least) & ~F.col("busy") & ~F.col("shadow_running"))
