"""Alert rules, cooldown and alert statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.checkpoints import cut

#: A block of a clock is this many cooldowns long, and a day at least; a task holds at most a row for each of its seconds.
BLOCK_COOLDOWNS, BLOCK_SECONDS = 64, 86_400

# Fixed values. Rule name: condition (a Spark SQL expression over the row), severity, cooldown in seconds. Users add theirs alike.
RULES = {
    "critical_risk": ("probability >= 0.75", "CRITICAL", 60),
    "high_risk": ("probability >= 0.50 AND probability < 0.75", "WARNING", 300),
    "rapid_increase": ("probability - previous > 0.20", "CRITICAL", 120),
}
SYSTEM_RULES = {
    "gpu_memory_high": ("gpu_pct > 90", "WARNING", 600),
    "high_latency": ("latency_ms > 500", "WARNING", 300),
    "model_error_spike": ("error_rate > 0.05", "CRITICAL", 120),
}
DRIFT_RULES = {
    "feature_drift": ("psi > 0.2", "WARNING", 3600),
    "prediction_drift": ("relative_drift > 0.25", "CRITICAL", 1800),
}


def with_previous(df: DataFrame, key: str = "patient_id", order: str = "ts", p: str = "probability") -> DataFrame:
    return df.withColumn("previous", F.lag(p).over(Window.partitionBy(key).orderBy(order)))


def fired(df: DataFrame, rules: dict = RULES) -> DataFrame:
    """A row for each rule that a row of ``df`` meets."""
    hits = F.array_compact(F.array(*[F.when(F.expr(f"coalesce({cond}, false)"), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.lit(c).alias("cooldown"))) for n, (cond, s, c) in rules.items()]))
    return df.withColumn("_r", F.explode(hits)).select(*df.columns, "_r.*")


def cool_down(alerts: DataFrame, scope: tuple[str, ...] = ("rule",), order: str = "ts", key: str = "patient_id") -> DataFrame:
    """Alerts that remain when one silences its scope for the cooldown; of one second's, the one with the smallest key.

    ``scope=("rule",)`` is one clock for each rule, ``("rule", "patient_id")`` one for each rule and patient.

    A clock runs through its time in order, yet no task sees the whole of it. Alerts come down to one row for each second; time
    is cut into blocks of many cooldowns. Where a block is entered depends on the last alert kept before it, less than a
    cooldown earlier, so each block tells for each of its few possible entries when the clock is free again. These short tables
    are followed from block to block, and each block is then folded from the entry found. Alerts without a time, or with no
    cooldown (0 or less), are all kept; a cooldown that is null never ends.
    """
    kind = dict(alerts.dtypes)
    # times travel to Python as numbers: Arrow's timestamps carry a zone, and Spark takes back no other than UTC
    timed = kind[order] == "timestamp"
    stamp, back = (F.unix_micros(order), F.timestamp_micros("x.ts")) if timed else (F.col(order), F.col("x.ts"))
    names = [f"s{k}" for k in range(len(scope))]
    scoped = ", ".join(f"{n} {kind[c]}" for n, c in zip(names, scope))
    rows = alerts.select(*[F.col(c).alias(n) for n, c in zip(names, scope)], F.col("cooldown").cast("double").alias("wait"), F.unix_timestamp(order).alias("t"), F.struct(F.col(key).alias("k"), stamp.alias("ts")).alias("x"))
    open_rows, endless = rows.filter("t is null or wait <= 0"), rows.filter("t is not null and wait is null")
    first = endless.groupBy(*names).agg(F.min_by("x", F.struct("t", "x")).alias("x"))
    seconds = rows.filter("t is not null and wait > 0").groupBy(*names, "wait", "t").agg(F.min("x").alias("x"))
    length = F.greatest(F.ceil(F.col("wait") * BLOCK_COOLDOWNS), F.lit(BLOCK_SECONDS)).cast("long")
    seconds = cut(seconds.withColumn("block", F.floor(F.col("t") / length)).withColumn("start", F.col("block") * length))
    clock = [*names, "wait"]
    times = seconds.select(*clock, "block", "start", "t")

    def entries(block: pa.Table) -> pa.Table:
        block = block.sort_by("t")
        t, wait = block["t"].to_numpy(), block["wait"][0].as_py()
        after = np.searchsorted(t, t + wait)  # the next alert that an alert lets through; past the end: none in this block
        free = t + wait
        for i in range(len(t) - 1, -1, -1):
            if after[i] < len(t):
                free[i] = free[after[i]]
        some = min(len(t), int(np.searchsorted(t, block["start"][0].as_py() + wait)) + 1)
        return block.slice(0, some).append_column("free", pa.array(free[:some], pa.float64()))

    def follow(clock_entries: pa.Table) -> pa.Table:
        clock_entries = clock_entries.sort_by("t")
        free, block, out = -math.inf, None, []
        for i, (b, t, f) in enumerate(zip(*(clock_entries[c].to_pylist() for c in ("block", "t", "free")))):
            if b != block and t >= free:
                block, free = b, f
                out.append(i)
        return clock_entries.select([*clock, "block", "t"]).take(pa.array(out, pa.int64()))

    def fold(block: pa.Table, entry: pa.Table) -> pa.Table:
        block = block.sort_by("t")
        t, keep = block["t"].to_numpy(), []
        i = int(np.searchsorted(t, entry["t"][0].as_py())) if len(entry) else len(t)
        while i < len(t):
            keep.append(i)
            i = int(np.searchsorted(t, t[i] + block["wait"][0].as_py()))
        return block.select([*names, "k", "ts"]).take(pa.array(keep, pa.int64()))

    place = f"{scoped}, wait double, block long"
    possible = times.groupBy(*clock, "block").applyInArrow(entries, f"{place}, start long, t long, free double")
    entered = possible.groupBy(*clock).applyInArrow(follow, f"{place}, t long")
    item = f"{scoped}, k {kind[key]}, ts {'long' if timed else kind[order]}"
    flat = seconds.select(*clock, "block", "t", "x.k", "x.ts")
    folded = flat.groupBy(*clock, "block").cogroup(entered.groupBy(*clock, "block")).applyInArrow(fold, item)
    kept = folded.select(*names, F.struct("k", "ts").alias("x")).unionByName(first).unionByName(open_rows.select(*names, "x"))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, scope)], *([F.col("x.k").alias(key)] if key not in scope else []), back.alias(order))


def by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("n"))


def recent(alerts: DataFrame, limit: int, severity: str | None = None, order: str = "ts") -> DataFrame:
    """The last ``limit`` alerts, then the filter, newest first; a filtered call may return fewer."""
    out = alerts.orderBy(F.desc(order), "patient_id", "rule").limit(limit)
    return out.filter(F.col("severity") == severity) if severity else out
