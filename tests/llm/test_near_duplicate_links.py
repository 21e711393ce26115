"""No true link is lost, and what reaches the comparison of texts doesn't grow with the square of a template's pages."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_set_operators import classes, family
from tidewell.llm import near_duplicates


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def fresh(rng, n):
    return [f"u{rng.randrange(10**12)}" for _ in range(n)]


def agree(spark, texts, width=2):
    got = [r["component_id"] for r in near_duplicates.link(documents(spark, texts), width).orderBy("doc_id").collect()]
    assert got == classes(texts, width)[0]


def test_pair_hidden_behind_decoys_is_linked(spark):
    """Two similar texts whose signatures agree in the low bytes of a band that they don't share, with smaller ids in all their buckets."""
    rng = random.Random(4)
    core = fresh(rng, 101)
    hashes = near_duplicates.WordHash()
    while True:
        pair = [core + fresh(rng, 12) for _ in range(2)]
        sigs = [near_duplicates.signature(near_duplicates.shingle_hashes([w.encode() for w in words], 2, hashes)) for words in pair]
        low = [s.astype(np.uint8)[: near_duplicates.BANDS * near_duplicates.BAND].reshape(near_duplicates.BANDS, -1) for s in sigs]
        shared = np.flatnonzero(near_duplicates.band_keys(sigs[0]) == near_duplicates.band_keys(sigs[1]))
        if shared.size and (low[0] == low[1]).all(axis=1).argmax() != shared[0]:
            break
    texts = [" ".join(core[6:] + fresh(rng, 20)) for _ in range(12)] + [" ".join(words) for words in pair]
    assert classes(texts, 2)[0][12:] == [12, 12]
    agree(spark, texts)


@pytest.mark.parametrize("size", [5, 11, 100, 1000])
def test_families_round_the_limit(spark, size):
    rng = random.Random(size)
    texts = []
    for _ in range(12):
        core = fresh(rng, size)
        for _ in range(10):
            own = max(1, round(size * rng.choice((0.06, 0.11, 0.125, 0.2))))
            texts.append(" ".join(core[: size - rng.randint(0, own)] + fresh(rng, rng.randint(0, own))))
    rng.shuffle(texts)
    agree(spark, texts)


def test_small_sets_at_exactly_the_limit(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(300):
        words = fresh(rng, 6)  # five shingles, and four of them: 4 / 5
        texts += [" ".join(words), " ".join(words[: 5])]
    rng.shuffle(texts)
    agree(spark, texts)


def test_random_families_in_several_components(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "FIRST_SHARED", 40)  # so that most links are left to the second turn
    monkeypatch.setattr(near_duplicates, "PART", 8)
    monkeypatch.setattr(near_duplicates, "CHUNK_MEMBERS", 4)
    monkeypatch.setattr(near_duplicates, "SMALL", 2)
    rng = random.Random(12)
    agree(spark, family(rng, 150, 80, 12) + family(rng, 40, 40, 6) + family(rng, 40, 8, 2))


def pages(rng, n, share):
    """Pages of one template, alike by about ``share``."""
    core = fresh(rng, 200)
    own = round(200 * (1 - share) / (2 * share))
    return [" ".join(core + fresh(rng, own)) for _ in range(n)]


def test_template_pages_give_no_pairs(spark):
    rng = random.Random(13)
    docs = documents(spark, pages(rng, 2000, 0.70)).withColumn("component", F.col("doc_id"))
    members = docs.select("doc_id", "component", F.lit(1).cast("long").alias("comp_size"), F.lit(200 + 43 - 1).cast("long").alias("n_shingles"))
    fronts = near_duplicates.front_shingles(members, docs.select("doc_id", "text"), 2, 80)
    assert near_duplicates.cross_pairs(near_duplicates._in_parts(fronts), 80).count() == 0
    got = near_duplicates.link(docs.select("doc_id", "text"), 2)
    assert got.filter("kept").count() == 2000
    close = pages(rng, 60, 0.79) + pages(rng, 60, 0.81)
    agree(spark, close)


def test_repeated_rows_in_the_second_turn(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "FIRST_SHARED", 99)
    rng = random.Random(14)
    texts = family(rng, 60, 60, 9)
    df = documents(spark, texts)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.link(df.unionByName(df), 2).collect()}
    assert [got[k] for k in range(60)] == classes(texts, 2)[0]


@pytest.mark.parametrize("pool", [5, 50])
def test_pages_about_the_limit_ship_rows_in_proportion(spark, monkeypatch, pool):
    """Pages of a hundred fixed words and seven of a small pool: what is shipped grows with the pages, results equal brute force."""
    monkeypatch.setattr(near_duplicates, "FEW", 8)
    rng, counted = random.Random(pool), []
    kept = near_duplicates.product
    monkeypatch.setattr(near_duplicates, "product", lambda t, *rest: counted.append(t.count()) or kept(t, *rest))
    confirmed = near_duplicates.confirm
    monkeypatch.setattr(near_duplicates, "confirm", lambda p, *rest: counted.append(p.count()) or confirmed(p, *rest))
    core, words = fresh(rng, 100), fresh(rng, pool)

    def page():
        own = list(core)
        for _ in range(7):
            own.insert(rng.randrange(len(own)), rng.choice(words))
        return " ".join(own)

    texts = [page() for _ in range(900)]
    shipped = {}
    for n in (300, 900):
        counted.clear()
        agree(spark, texts[:n])
        shipped[n] = sum(counted)
    assert shipped[900] <= 6 * shipped[300] + 900
