"""Operators over whole tables: near-duplicates, components, neighbours, urls, shards, packing, mixing."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from tidewell.llm import components, mixing, near_duplicates, nearest, packing, queries, sharding, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source=lambda k: "s"):
    return spark.createDataFrame([(k, t, "en", source(k), 0) for k, t in enumerate(texts)], DOC)


@pytest.mark.parametrize("name", sorted(k for k in queries.oracle_sql()))
def test_query_matches_its_oracle(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


# components


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(500, k) for k in range(501, 700)] + [(k, k + 1) for k in range(800, 860)] + [(1, 1), (1, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# near duplicates


def classes(texts, width):
    sets = [near_duplicates.shingles(near_duplicates.split_words(t), width) for t in texts]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def family(rng, n, size, changes):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(size)] = f"x{rng.randint(0, 5000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_classes_equal_brute_force(spark, monkeypatch, width):
    rng = random.Random(width)
    monkeypatch.setattr(near_duplicates, "PART", 16)  # so that parts, large components and chunks all occur
    monkeypatch.setattr(near_duplicates, "CHUNK_MEMBERS", 8)
    texts = [None, "", "  ", "one", "ONE", "one two", "One  Two", "one two three four", "a a a a a a"]
    texts += family(rng, 120, 80, 12) + family(rng, 30, 40, 6) + ["same text for all of them, word by word " * 3] * 40 + family(rng, 20, 8, 2)
    rng.shuffle(texts)
    got = near_duplicates.link(documents(spark, texts), width).orderBy("doc_id").collect()
    want, sizes = classes(texts, width)
    assert [r["component_id"] for r in got] == want and [r["n_shingles"] for r in got] == sizes
    assert [r["kept"] for r in got] == [k == w for k, w in enumerate(want)]


def test_one_of_each_stays_even_if_rows_repeat(spark):
    text = "a b c d e f g h i j k l"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None), (4, "")], "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = near_duplicates.keep_one(df)
    assert got.columns == df.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "4", "None"]
    assert near_duplicates.link(df.limit(0)).count() == 0


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    both = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = near_duplicates.signature(np.unique(both[:900])), near_duplicates.signature(np.unique(both[100:]))
    assert abs((a == b).mean() - 0.8) < 0.1
    small = [near_duplicates.signature(np.unique(rng.integers(0, 2**63, k, dtype=np.uint64))) for k in (1, 2, 5)]
    assert all((s != 0).all() for s in small)


# nearest neighbours


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = [list(map(float, v)) for v in rng.normal(size=(260, 16)) * 10 ** rng.uniform(-3, 3, size=(260, 1))]
    vectors[5] = vectors[6] = vectors[7]  # ties
    vectors += [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0] * 3, [2.0] * 3]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in nearest.nearest(df, every=10, k=4, query_tile=7, candidate_tile=50).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    usable = {k: np.array(v) for k, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)}
    for q, x in usable.items():
        if q % 10 == 0:
            want = sorted((float(np.sqrt(np.cumsum((x - y) ** 2)[-1])), k) for k, y in usable.items() if k != q and len(x) == len(y))[:4]
            assert got.get(q, []) == want
    assert nearest.nearest(df.limit(0)).count() == 0


# urls


def page(*links):
    return "<head>" + "".join(links) + "</head>"


def test_blocks_reach_aliases_and_allow_comes_first(spark):
    rows = [
        (1, "http://a.example.com/en/1", page('<link rel="canonical" href="https://b.example.org/x?a=1&amp;b=2#f">')),
        (2, "HTTP://B.example.org/x?a=1&b=2", None),
        (3, "http://c.net/q/w", page("<meta http-equiv='refresh' content='0; url=/w2'>")),
        (6, "http://d.net/z", page("<link href='//c.net/w2' rel=canonical>", '<meta http-equiv=refresh content="3;URL=http://E.example.com/en/7x">')),
        (7, "http://e.example.com/en/7x", ""),
        (8, "http://x.example.com/en/9#q", page("<link rel=canonical href=/de/1>")),
        (9, "ftp://x.example.com/de/1", ""),
        (10, None, "x"),
        (11, "nourl", None),
        (12, "http://y.org/es/", page("<link rel=canonical href=http://e.example.com/en/7x>")),
        (12, "http://y.org/es/", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.decide(df).collect()}
    assert got[1][2:] == ("com/en/", "block") and got[2] == ("b.example.org", "/x", None, "block")
    assert got[3][3] == got[6][3] == "allow" and got[7][2] == "example.com/en/7"
    assert got[9] == ("x.example.com", "/de/1", None, "block") and got[10] == got[11] == ("", "", None, "allow")
    assert got[12] == ("y.org", "/es/", "org/es/", "block")  # a rule of its own comes before the class
    redirects = spark.createDataFrame([("http://new.io/1", "http://a.example.com/en/1")], "source string, target string")
    alias = spark.createDataFrame([(1, "https://new.io/1", None)], "page_id long, url string, html string")
    assert url_filter.decide(alias, redirects=redirects).first()["verdict"] == "block"
    assert url_filter.decide(df.limit(0)).count() == 0


def test_rules_on_the_pages_table(spark, sf):
    import re

    def wanted(url):
        rest = url.split("://", 1)[1] if url and "://" in url else None
        m = re.match(r"([^/?#]*)([^?#]*)", rest or "", re.S)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        return host, path, best and best.name, best.verdict if best else "allow"

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    for r in url_filter.decide(pages).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == wanted(urls[r["page_id"]])


# shards


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(sharding.permute(np.arange(n), n, 3).tolist()) == list(range(n))


def test_shards_are_even_gapless_and_independent_of_partitions(spark):
    texts = [None, "", "x"] + [f"text {k % 50}" for k in range(500)]
    df = documents(spark, texts).withColumn("slot", F.lit("clash"))
    first = {r["doc_id"]: r for r in sharding.shard_documents(df, 24).collect()}
    again = {r["doc_id"]: r for r in sharding.shard_documents(df.repartition(7).orderBy(F.rand()), 24).collect()}
    assert first == again
    slots = defaultdict(list)
    for r in first.values():
        slots[r["shard"]].append(r["slot"])
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "rows" and r["grown_shard"] is None
    assert len(slots) == 24 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(df.limit(0)).count() == 0
    twice = sharding.shard_documents(df.unionByName(df)).select("row_number").collect()
    assert sorted(r[0] for r in twice) == list(range(2 * len(texts)))


# packing


def test_tightest_open_sequence_is_taken():
    rng = random.Random(8)
    lengths = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    sequences, offsets = packing.best_fit(lengths, 64)
    rooms, used = [], defaultdict(int)
    for n, s, o in zip(lengths, sequences, offsets):
        fit = min((r for r in rooms if r >= n), default=None)
        assert (64 - o) == (64 if fit is None else fit)
        if fit is not None:
            rooms.remove(fit)
        rooms.append(64 - o - n)
        assert used[s] == o
        used[s] += n
    assert max(used.values()) <= 64


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts = [None, "", "a", "a", "é" * 50, "<|endoftext|> in text", "²³ ½ 中文 \x1c\x85 x", "  spaces  and\n\nlines's we'll _x_ 12ab", "word " * 3000, "x" * 30_000]
    texts += [" ".join("".join(rng.choice("abcé1'_- \n") for _ in range(8)) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for t in texts]
    df = documents(spark, texts).withColumn("length", F.lit("clash"))
    rows = packing.pack_documents(df, block_rows=20).collect()
    pieces, used = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for _, _, n in own) == len(ids[k])
        assert all(n == 1024 for p, _, n in own if p) and [s for _, s, _ in own] == [sum(n for _, _, n in own[:i]) for i in range(len(own))]
    for places in used.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 1024
    assert len(pieces) == len(texts) and packing.pack_documents(df.limit(0)).count() == 0


# mixing


def test_exponent_meets_the_target_and_budgets_hold(spark):
    sizes = {"big": 900, "mid": 90, "small": 30, None: 60}
    names = [s for s, n in sizes.items() for _ in range(n)]
    rng = random.Random(10)
    texts = [" ".join(["w"] * rng.randint(1, 30)) for _ in names]
    df = spark.createDataFrame([(k, t, "en", s, 0) for k, (t, s) in enumerate(zip(texts, names))], DOC)
    rows = mixing.mix(df, evenness=0.8, most_repeats=50).collect()
    weight = {r["source"]: r["weight"] for r in rows}
    w = np.array(list(weight.values()))
    assert w.sum() == pytest.approx(1, abs=1e-6) and -(w * np.log(w)).sum() == pytest.approx(0.8 * np.log(4), abs=1e-6)
    tokens, drawn = Counter(), Counter()
    for r in rows:
        assert r["copies"] >= 1 and r["n_tokens"] == len(texts[r["doc_id"]].split())
        tokens[r["source"]] += r["n_tokens"]
        drawn[r["source"]] += r["n_tokens"] * r["copies"]
    assert drawn["big"] == tokens["big"]
    total = sum(drawn.values())
    assert all(abs(drawn[s] - weight[s] * total) <= 0.01 * total for s in sizes)
    limited = mixing.mix(df, evenness=0.5, most_repeats=2.0).agg(F.max("copies")).first()[0]
    assert limited <= 3
    few = mixing.mix(df, budget=500.0).agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0]
    assert 380 <= few <= 500


def test_blocks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 10)
    df = documents(spark, ["a b"] * 200 + ["c"] * 50 + [None] * 5, lambda k: "x" if k < 200 else "y")
    both = df.unionByName(df).withColumn("copies", F.lit("clash"))
    rows = mixing.mix(both, most_repeats=30).collect()
    assert len(rows) == 510 and all(n == 2 for n in Counter((r["doc_id"], r["copies"]) for r in rows).values())
    assert mixing.realise(both, most_repeats=30).columns == both.columns
    assert mixing.realise(both, most_repeats=30).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.realise(df.limit(0)).count() == 0


def test_mixing_plan_has_no_python(spark, sf):
    plan = mixing.realise(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
