"""Ids that are negative, repeated or missing."""

from __future__ import annotations

import random

from tests.llm.test_set_operators import classes, family
from tidewell.llm import near_duplicates


def test_repeated_ids_lose_no_clean_text_and_no_row_without_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (None, a), (None, a), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str((r["doc_id"], r["text"])) for r in near_duplicates.keep_one(df).collect())
    assert got == sorted(map(str, [(1, a), (2, b), (3, c), (None, a), (None, a), (4, None), (4, None)]))


def test_links_of_negative_ids_are_found_in_the_second_turn(spark):
    rng = random.Random(3)
    texts = family(rng, 120, 80, 12) + family(rng, 30, 40, 6)
    df = spark.createDataFrame([(k - 1000, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = near_duplicates.link(df, 2).orderBy("doc_id").collect()
    assert [r["component_id"] + 1000 for r in got] == classes(texts, 2)[0]
