"""Urls, shards and packing against plain Python versions."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.llm import packing, sharding, url_filter


def test_alias_classes_equal_union_find(spark):
    rng = random.Random(6)
    hosts = ["a.example.com", "b.net", "c.example.net", "d.org", "e.io", "f.dev"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(('en', 'de', 'es', 'fr'))}/{rng.randrange(90)}" for _ in range(300)]
    hub = "http://hub.io/fr/1"
    links = {u: rng.choice(urls) if rng.random() < 0.3 else hub if rng.random() < 0.5 else None for u in urls}
    rows = [(k, u, f'<head><link rel="canonical" href="{links[u]}"></head>' if links[u] else "<p>x</p>") for k, u in enumerate(urls)]
    parent: dict[str, str] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def own(url):
        host, _, path = url.split("://")[1].partition("/")
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        return max(fits, key=lambda r: len(r.name), default=None)

    for u, v in links.items():
        if v:
            parent[find(u)] = find(v)
    found: dict[str, set] = {}
    for u in {*links, *filter(None, links.values())}:
        if own(u):
            found.setdefault(find(u), set()).add(own(u).verdict)
    got = url_filter.decide(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and len(found) > 1
    for r in got:
        rule, seen = own(urls[r["page_id"]]), found.get(find(urls[r["page_id"]]), set())
        assert r["verdict"] == (rule.verdict if rule else "allow" if "allow" in seen or not seen else "block")


@pytest.mark.parametrize(
    ("html", "target"),
    [
        ("<!-- <link rel=canonical href=http://x.com/en/1> -->", None),
        ("<script>var a = '<link rel=canonical href=http://x.com/en/1>'</script>", None),
        ("<link rel=canonical href='http://x.com/a/../en/./1'>", "x.com/en/1"),
        ("<link rel=canonical href='../../en/1'>", "p.dev/en/1"),
        ("<link rel=canonical href='..'>", "p.dev/"),
        ("<base href='//x.com/en/'><link href='1' rel='alternate canonical'>", "x.com/en/1"),
        ("<link data-href='/no' rel=canonical href='/yes?a=1&#38;b=2&#x2f;'>", "p.dev/yes?a=1&b=2/"),
        ("<meta http-equiv=Refresh content='5; URL=/r#f'>", "p.dev/r"),
        ("<link rel=canonical href='mailto:a@b'>", None),
        ("<meta " + "x" * 1_000_000 + "><link rel=canonical href=/en/1>", "p.dev/en/1"),
        ("<link " + "a='b' " * 100_000 + "rel=canonical href=/en/1>", "p.dev/en/1"),
        ("<meta " * 100_000 + "> canonical", None),
        ("<meta '>\" " * 50_000 + "<link rel=canonical href=/en/1>", "p.dev/en/1"),
        ("<link rel=stylesheet href='/s'>", None),
        (None, None),
    ],
)
def test_targets_of_links(spark, html, target):
    pages = spark.createDataFrame([("http://P.dev/q/w", html)], "url string, html string")
    assert [r["v"] for r in url_filter.page_links(pages).collect()] == ([target] if target else [])


def plain_permutation(number, n, seed):
    """The network and the walk with Python's whole numbers, one row at a time."""
    full = (1 << 64) - 1
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)

    def turn(x, key):
        x = (x + key) & full
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    while True:
        left, right = number >> half, number & ((1 << half) - 1)
        for k in range(4):
            left, right = right, left ^ (turn(right, ((seed * 4 + k + 1) * 0x9E3779B97F4A7C15) & full) & ((1 << half) - 1))
        number = (left << half) | right
        if number < n:
            return number


def test_shards_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL_ROWS", 7)
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 2, 3, k]), rng.choice([None, "", "a", "é" * k])) for k in range(400)] + [(None, "hot")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sized = df.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"))
    order = sized.withColumn("b", F.pmod(F.xxhash64(*sized.columns), F.lit(sharding.BUCKETS))).collect()
    order.sort(key=lambda r: (r["b"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    want = Counter()
    for number, r in enumerate(order):
        place = plain_permutation(number, len(order), 42)
        want[r["doc_id"], r["text_crc32"], r["size"], place % 24, place // 24] += 1
    got = Counter((r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in sharding.shard_documents(df).collect())
    assert got == want
    assert {zlib.crc32((t or "").encode()) for _, t in rows} == {k[1] for k in got}


def test_sequences_are_near_the_least_possible(spark, sf):
    rows = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet")).agg(F.sum("length"), F.countDistinct("sequence_id"), F.count_if(F.col("length") > 512)).first()
    least = max(-(-rows[0] // 1024), rows[2])
    assert least <= rows[1] <= 1.01 * least + 1
