"""Aggregation of model parameters over sites, privacy accounting and masking, on long tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: parameter names that stay local under batch-norm aware averaging.
LOCAL_NAMES = "bn|norm|running_mean|running_var|num_batches_tracked"


def long_table(vectors: DataFrame, site: str, param: str, values: str, weight: str | Column) -> DataFrame:
    """``site, param, idx, value, weight`` from array columns."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return vectors.select(F.col(site).alias("site"), F.col(param).alias("param"), w.alias("weight"), F.posexplode(values).alias("idx", "value"))


def fed_avg(cells: DataFrame) -> DataFrame:
    """Weighted mean of each parameter cell; equal weights if all are zero. Partial sums combine before the shuffle."""
    total = F.sum("weight")
    mean = F.when(total != 0, F.sum(F.col("weight") * F.col("value")) / total).otherwise(F.avg("value"))
    return cells.groupBy("param", "idx").agg(mean.alias("value"))


def fed_bn(cells: DataFrame) -> DataFrame:
    """Normalisation parameters from the first site, the rest averaged."""
    total = F.sum("weight")
    mean = F.when(total != 0, F.sum(F.col("weight") * F.col("value")) / total).otherwise(F.avg("value"))
    first = F.min_by("value", "site")
    return cells.groupBy("param", "idx").agg(F.when(F.lower("param").rlike(LOCAL_NAMES), first).otherwise(mean).alias("value"))


def clip_norm(vectors: DataFrame, values: str, most: float) -> DataFrame:
    """Vectors scaled down to a norm of ``most``."""
    norm = F.sqrt(F.aggregate(F.transform(values, lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))
    scale = F.least(F.lit(1.0), F.try_divide(F.lit(most), norm))
    return vectors.withColumn(values, F.transform(values, lambda x: x * F.coalesce(scale, F.lit(1.0))))


def noised(vectors: DataFrame, values: str, sigma: float, most: float, key: str, seed: int = 42) -> DataFrame:
    """Clipped vectors with normal noise of ``sigma`` times the clip, the same in every run: drawn by hash of seed, key and place."""
    unit = lambda salt, i: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), F.col(key), i), 11).cast("double") + 0.5) / float(2**53)
    normal = lambda i: F.sqrt(-2.0 * F.log(unit(0, i))) * F.cos(2.0 * math.pi * unit(1, i))
    return clip_norm(vectors, values, most).withColumn(values, F.transform(values, lambda x, i: x + float(sigma * most) * normal(i)))


#: Orders of the accountant: 1.1 to 10.9 by tenths, then 12 to 63.
ORDERS = (*[1 + k / 10 for k in range(1, 100)], *map(float, range(12, 64)))


def rdp_epsilon(rounds: DataFrame, delta: float = 1e-5, orders: tuple[float, ...] = ORDERS) -> DataFrame:
    """``round, epsilon``: cumulative privacy loss. ``rounds``: round, q, sigma, steps."""
    alphas = F.array(*map(F.lit, orders))
    each = rounds.withColumn("alpha", F.explode(alphas))
    step = F.when(F.col("q") >= 1, F.col("alpha") / (2 * F.col("sigma") ** 2)).otherwise(F.col("q") ** 2 * F.col("alpha") / (2 * F.col("sigma") ** 2)) * F.col("steps")
    upto = F.sum(step).over(Window.partitionBy("alpha").orderBy("round").rowsBetween(Window.unboundedPreceding, 0))
    rows = each.select("round", (upto + F.lit(1.0) * F.ln(F.lit(1 / delta)) / (F.col("alpha") - 1)).alias("e"))
    return rows.groupBy("round").agg(F.round(F.min("e"), 6).alias("epsilon"))


def pair_masks(sites: DataFrame, cells: int, seed: int = 7) -> DataFrame:
    """``site, idx, mask``: additive masks from pairwise seeds; over all sites they sum to zero in each cell."""
    a, b = sites.select(F.col("site").alias("a")), sites.select(F.col("site").alias("b"))
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    number = F.conv(F.substring(F.sha2(F.concat_ws(":", "a", "b", "idx", F.lit(seed)), 256), 1, 8), 16, 10).cast("double") / 4294967295.0 - 0.5
    signed = pairs.withColumn("m", number).select(F.explode(F.array(F.struct(F.col("a").alias("site"), F.col("m").alias("m")), F.struct(F.col("b").alias("site"), (-F.col("m")).alias("m")))).alias("r"), "idx")
    return signed.groupBy("r.site", "idx").agg(F.sum("r.m").alias("mask"))


def site_states(events: DataFrame, now: float, timeout: float = 300.0) -> DataFrame:
    """``site_id, last_heartbeat, dataset_size, rounds, active`` from ``site_id, kind, at, dataset_size`` events.

    Kinds: register, heartbeat, unregister, submit. A site that left after it last registered goes; one that was silent for longer
    than ``timeout`` seconds isn't active. Registering counts as a heartbeat.
    """
    when = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("at")))
    size = F.max_by("dataset_size", F.when(F.col("kind") == "register", F.col("at")))
    rows = events.filter(F.col("at") <= now).groupBy("site_id").agg(when("register").alias("_in"), when("unregister").alias("_out"), when("register", "heartbeat").alias("last_heartbeat"), size.alias("dataset_size"), F.count_if(F.col("kind") == "submit").alias("rounds"))
    there = F.col("_in").isNotNull() & (F.col("_out").isNull() | (F.col("_out") < F.col("_in")))
    return rows.filter(there).withColumn("active", F.col("last_heartbeat") >= now - timeout).drop("_in", "_out")


def can_start(sites: DataFrame, spent: float, budget: float, least: int = 2) -> DataFrame:
    """One row: the active sites and whether a round may start (enough of them, and privacy budget left)."""
    return sites.agg(F.count_if("active").alias("active_sites")).withColumn("can_start", (F.col("active_sites") >= least) & F.lit(spent < budget))


def round_states(rounds: DataFrame, updates: DataFrame, sites: DataFrame) -> DataFrame:
    """``rounds`` (round_number, aggregated) with accepted updates, those awaited from active sites, and the state.

    An update counts once a site and only from a registered one. COMPLETED once aggregated; READY when every active site has sent;
    else TRAINING.
    """
    sent = updates.select("round_number", "site_id").distinct().join(F.broadcast(sites.select("site_id", "active")), "site_id")
    counts = sent.groupBy("round_number").agg(F.count("*").alias("received"), F.count_if("active").alias("_from_active"))
    awaited = sites.agg(F.count_if("active").alias("expected"))  # one row
    out = rounds.join(counts, "round_number", "left").crossJoin(F.broadcast(awaited)).fillna(0, ["received", "_from_active"])
    state = F.when(F.col("aggregated"), "COMPLETED").when(F.col("_from_active") >= F.col("expected"), "READY").otherwise("TRAINING")
    return out.withColumn("state", state).drop("_from_active")
