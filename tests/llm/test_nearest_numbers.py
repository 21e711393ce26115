"""Repeated query rows, ids with several vectors, and numbers whose squares leave doubles."""

from __future__ import annotations

import random

from tidewell.llm import nearest


def test_repeated_rows_count_once(spark):
    rng = random.Random(4)
    rows = [(k, [rng.random() for _ in range(4)]) for k in range(60)]
    again = spark.createDataFrame(rows + [rows[0], rows[0], rows[7], (9, [9.0] * 4)], "vec_id long, embedding array<double>")
    once = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    order = lambda df: sorted(tuple(r) for r in df.collect())
    assert order(nearest.nearest(again)) == order(nearest.nearest(once)) and len(order(nearest.nearest(again))) == 10


def test_numbers_of_any_size(spark):
    rows = [(0, [1e200, 1.0]), (1, [2e200, 0.0]), (2, [1.0, 2.0]), (3, [4e200, 3e200]), (100, [1e-200, 0.0]), (5, [3e-200, 0.0]), (6, [5.0, 5.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}
    assert found[0, 1] == (1, 1e200) and found[0, 2] == (2, 1e200) and len(found) == 6
    assert found[100, 1] == (5, 2e-200) and found[100, 2][0] == 2
