"""Running sums over a whole table without one task seeing it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.checkpoints import cut


def running_sums(df: DataFrame, order: str, columns: list[str], descending: bool = False, one_task: int = 0) -> DataFrame:
    """``df`` with ``{c}_upto``, the sum of ``c`` over all rows up to this one, and ``{c}_all``. Values of ``order`` are distinct,
    and no column is named ``part``.

    The table is cut into ranges, one to a partition; a range's own sums run on from what the ranges before it hold, which
    is a table of one row for each range. Only a caller that gives ``one_task`` has tables up to that many rows summed by one task.
    """
    by = F.desc(order) if descending else F.asc(order)
    df = cut(df)
    if one_task and df.limit(one_task + 1).count() <= one_task:
        whole, every = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
        return df.withColumns({f"{c}_{n}": F.sum(c).over(w) for c in columns for n, w in (("upto", whole), ("all", every))})
    rows = cut(df.repartitionByRange(by).withColumn("part", F.spark_partition_id()))
    parts = rows.groupBy("part").agg(*[F.sum(c).alias(c) for c in columns])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *[x for c in columns for x in (F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}"), F.sum(c).over(Window.partitionBy()).alias(f"{c}_all"))])
    own = Window.partitionBy("part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(parts), "part").withColumns({f"{c}_upto": F.sum(c).over(own) + F.col(f"_{c}") for c in columns})
    return out.drop("part", *[f"_{c}" for c in columns])


def running_sums_by(df: DataFrame, group: str, order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """As :func:`running_sums`, within each ``group``; pairs of group and ``order`` are distinct, and neither a group nor the whole table
    is one task's work. ``{c}_all`` are the group's sums.

    Ranges are of (group, order). What a range adds to a group is one row for each group in it, and only groups that go on in
    another range, two a range at most, have anything carried over.
    """
    by = F.desc(order) if descending else F.asc(order)
    rows = cut(df.repartitionByRange(F.col(group), by).withColumn("part", F.spark_partition_id()))
    parts = rows.groupBy(group, "part").agg(*[F.sum(c).alias(c) for c in columns])
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(group, "part", F.count("*").over(Window.partitionBy(group)).alias("_spans"), *[F.sum(c).over(before).alias(f"_before_{c}") for c in columns])
    carried = carried.filter("_spans > 1").drop("_spans")
    every = rows.groupBy(group).agg(*[F.sum(c).alias(f"{c}_all") for c in columns])
    own = Window.partitionBy("part", group).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_own_{c}": F.sum(c).over(own) for c in columns}).join(F.broadcast(carried), [group, "part"], "left").join(every, group)
    zero = F.lit(0)
    return out.withColumns({f"{c}_upto": F.col(f"_own_{c}") + F.coalesce(f"_before_{c}", zero) for c in columns}).drop("part", *[f"{k}_{c}" for c in columns for k in ("_before", "_own")])


def stacked_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, x``: a row for each value of each column that isn't null or NaN."""
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    return df.select(rows).filter("x is not null and not isnan(x)")


def exact_percentiles(df: DataFrame, columns: list[str], points: dict[str, float]) -> DataFrame:
    """``feature`` and a column for each of ``points``: interpolated percentiles of each column, from counts by value and ranges of values.

    The data are aggregated once; a value's place is a running count, so no task holds all values of a column.
    """
    counts = stacked_values(df, columns).groupBy("feature", "x").agg(F.count("*").alias("n"))
    placed = running_sums_by(counts, "feature", "x", ["n"])
    last = F.col("n_all") - 1
    out = []
    for name, p in points.items():
        at = last * F.lit(float(p))
        for end, k in (("low", F.floor(at)), ("high", F.ceil(at))):
            out.append(F.min(F.when(F.col("n_upto") > k, F.col("x"))).alias(f"_{name}_{end}"))
    got = placed.groupBy("feature").agg(F.max("n_all").alias("_n"), *out)
    between = lambda name, p: F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * ((F.col("_n") - 1) * float(p) - F.floor((F.col("_n") - 1) * float(p)))
    return got.select("feature", *[between(name, p).alias(name) for name, p in points.items()])


def row_numbers(df: DataFrame, order: list[str], name: str = "row", total: str = "rows") -> DataFrame:
    """``df`` with each row's number by ``order``, from 0, and the number of all rows; by ranges and counts, not by one task.

    Values of ``order`` together are distinct, or ties go by chance.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("part", F.shiftright("_at", 33).cast("int")))
    parts = rows.groupBy("part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias(total))
    number = F.col("_before") + F.col("_at") - F.shiftleft(F.col("part").cast("long"), 33)
    return rows.join(F.broadcast(parts), "part").withColumn(name, number).drop("part", "_at", "_before")


def tiles(df: DataFrame, order: list[str], n: int, name: str = "tile") -> DataFrame:
    """``df`` with ``name``: which of ``n`` parts of equal size (the first ones a row larger) a row is in, by ``order``, from 1."""
    rows = row_numbers(df, order, "_number", "_all")
    small, large = F.floor(F.col("_all") / n), F.col("_all") % n
    head = large * (small + 1)  # rows of the larger parts
    tile = F.when(F.col("_number") < head, F.floor(F.col("_number") / (small + 1))).otherwise(large + F.floor((F.col("_number") - head) / F.greatest(small, F.lit(1))))
    return rows.withColumn(name, (tile + 1).cast("int")).drop("_number", "_all")
