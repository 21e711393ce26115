"""Thresholds that don't depend on row order, and searches with thousands of equally near rows."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import nearest, quality


def signal_rows(spark, n=60_000):
    """Rows with signals drawn from a hash of their number: one group far beyond what one partition's buckets would show."""
    u = (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10_000).cast("double")
    rows = spark.range(n).select(F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(1000).cast("long").alias("n_words"), (5000 + 3000 * u).cast("long").alias("word_chars"), (u * 90).cast("long").alias("n_symbols"), (u * 40).cast("long").alias("n_dup_lines"), (u * 300).cast("long").alias("n_repeat_words"), F.lit(False).alias("base_failed"))
    return rows


def test_fences_are_the_same_whatever_the_order(spark):
    rows = signal_rows(spark)
    first = sorted(map(str, quality.fences(rows).collect()))
    assert first == sorted(map(str, quality.fences(rows).collect()))
    assert first == sorted(map(str, quality.fences(rows.repartition(7).orderBy(F.rand(3))).collect()))
    exact = rows.filter("source = 'b'").agg(F.expr("percentile(n_repeat_words / n_words, 0.5)"), F.expr("percentile(n_repeat_words / n_words, 0.25)")).first()
    got = quality.fences(rows).filter("_source = 'b'").first()["_repeat_share_high"]
    f = quality.FENCES["repeat_share"]
    assert abs(got - (exact[0] + f.high * max(exact[0] - exact[1], f.least))) < 0.01 * got


def test_a_small_group_takes_the_next_larger_ones_fences(spark):
    rows = signal_rows(spark, 3000)
    few = rows.limit(5).withColumn("source", F.lit("few"))
    other = rows.limit(4).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("far")})
    got = {(r["_lang"], r["_source"]): tuple(r)[2:] for r in quality.fences(rows.unionByName(few).unionByName(other)).collect()}
    levels = {tuple(r)[:3]: r for r in quality.sketches(rows).select("level", "lang", "source").distinct().collect()}
    assert (1, "en", None) in levels and (2, None, None) in levels
    assert got["en", "few"] == tuple(quality.fences(rows.unionByName(few).withColumn("source", F.lit("x"))).first())[2:]
    assert got[None, "far"] == tuple(quality.fences(rows.unionByName(few).unionByName(other).withColumns({"lang": F.lit("l"), "source": F.lit("x")})).first())[2:]


def test_ties_of_a_whole_tile_need_little_memory():
    n, dim = nearest.CANDIDATE_TILE, 64
    c = np.ones((n, dim))
    tracemalloc.start()
    found = nearest.tile_pair(np.arange(200), np.ones((200, dim)), np.arange(n), c, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30
    assert [v for q, v, _ in found if q == 3] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10] and all(s == 0 for *_, s in found)
