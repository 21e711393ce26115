"""Phrase collocations, the Jaccard join and the prefix trie against SQL and plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.oracle import assert_same
from tidewell.llm import collocations, jaccard_join, prefix_trie, queries, shingling, tiles

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_collocations", "op12_jaccard_join", "op13_prefix_trie"])
def test_equal_to_sql(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


# collocations


def plain_phrases(rows, least, contained, top):
    """Counts by dictionaries, one text after the other."""
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for ch in ".,;:!?\x0a\x0b\x0c\x0d":
            text = text.replace(ch, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    counts[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in counts.items():
        found = []
        for p, a in c.items():
            if len(p) > 1 and a >= least:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                longer = [b for q, b in c.items() if len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
                if not any(100 * b >= contained * a for b in longer):
                    found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def test_collocations_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 1500)
    monkeypatch.setattr(collocations, "KEEP", 20)
    rng = random.Random(11)
    vocabulary = ["New", "york", "die", "ÄB", "été", "x y", "a", "b", "c", "d"]
    rows = [(None, "en"), ("", None), (" \t ", "en"), ("a b" * 3, None)]
    for k in range(150):
        words = rng.choices(vocabulary, weights=[9, 9, 5, 4, 3, 2, 2, 1, 1, 1], k=rng.randint(1, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    rows += [rows[-1]] * 3 + [("new york times square " * 500, "en")]
    df = spark.createDataFrame([(k, t, lang, "s", 0) for k, (t, lang) in enumerate(rows)], DOC)
    got = sorted(tuple(r) for r in collocations.mine(df, least=6, top=25).collect())
    assert got == plain_phrases(rows, 6, 80, 25) and len(got) > 20
    assert collocations.mine(df.limit(0)).count() == 0


def test_summaries_keep_all_frequent_cells_within_their_capacity():
    rng = np.random.default_rng(5)
    stream = np.concatenate([np.repeat(np.arange(50, dtype=np.uint32), 40), rng.integers(1000, 1 << 31, 60_000, dtype=np.uint32), np.full(30_000, 7, np.uint32)])
    rng.shuffle(stream)
    least = 30
    summary = collocations.Summary(len(stream) // least, least)
    for part in np.array_split(stream, 40):
        summary.add(*np.unique(part, return_counts=True))
        summary.merge()
        assert len(summary.keys) <= summary.capacity or summary.error == least - 1
    assert summary.error < least and set(range(50)) <= set(summary.survivors().tolist())
    small = collocations.Summary(10, least)  # too small for its mass: it grows instead of losing what is frequent
    for part in np.array_split(stream, 40):
        small.add(*np.unique(part, return_counts=True))
        small.merge()
    assert small.error < least and set(range(50)) <= set(small.survivors().tolist())


# the Jaccard join


def plain_components(texts, width, percent):
    def shingles(t):
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        return ({tuple(w)} if w else set()) if len(w) <= width else set(zip(*(w[k:] for k in range(width))))

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(k, len(s), find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent", "few"), [(3, 90, 12), (3, 90, 1), (2, 70, 1)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, width, percent, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(tiles, "LEAST_ROWS", 5)
    monkeypatch.setattr(tiles, "TILE_SHINGLES", 200)
    rng = random.Random(12)
    texts = [None, "", " \t", "One two", "one  TWO", "one", "a b c", "A b c"]
    for _ in range(12):  # families of near copies about the limit, of all sizes
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 12, 30, 90, 250]))]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            texts.append(" ".join(w))
    page = [f"p{k}" for k in range(60)]  # pages of one template
    texts += [" ".join(page[:30] + [f"q{rng.randint(0, 4)}" for _ in range(3)] + page[30:]) for _ in range(60)]
    texts += texts[10:20]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOC).withColumnRenamed("n_chars", "component_id")
    got = sorted(tuple(r) for r in jaccard_join.similar_components(df, width, percent).collect())
    want = plain_components(texts, width, percent)
    assert got == want and len({c for _, _, c in want}) < len(texts)


def test_jaccard_ids_that_are_missing_or_repeated(spark):
    rows = [(None, "a b c d"), (-5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (4, "z"), (4, "a b c d")]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOC)
    got = Counter(tuple(r) for r in jaccard_join.similar_components(df).collect())
    assert got == {(None, 2, None): 1, (-5, 2, -5): 1, (3, 2, -5): 2, (4, 1, -5): 1, (4, 2, -5): 1}
    assert jaccard_join.similar_components(df.limit(0)).count() == 0


def test_products_and_set_sizes():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    shared = tiles.overlaps(sets)
    assert all(shared[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    words = [b"w%d" % k for k in rng.integers(0, 40, 3000)]
    for width in (1, 2, 3, 5, 14):
        assert shingling.set_size(words, width) == len(set(zip(*(words[k:] for k in range(width)))))
    low = jaccard_join.bands(500, 90)
    for n in range(1, 450):
        m = n * 100 // 90
        assert np.searchsorted(low, m, side="right") - np.searchsorted(low, n, side="right") <= 1


# the trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    members, ends, last = defaultdict(list), defaultdict(list), {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        worth = (len(m) - 1) * (len(s[-1][1].encode()) if s else 0)
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += worth
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), kids[s], leaves[s], saved[s], digest(s)) for s, m in members.items())


def test_trie_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rng = random.Random(13)
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, None, "user", "first"), (8, 3, "user", "a"), (8, 3, "user", "a")]
    for c in range(40, 90):  # threads whose turns are few, so that much is shared
        rows += [(c, t, "user" if t % 2 else "assistant", rng.choice(["yes", "no", "é"]) * rng.randint(1, 2)) for t in range(rng.randint(1, 12))]
    rows += [(100, t, "user", f"turn {t}") for t in range(150)]  # one long chain, and copies of it
    rows += [(c, t, "user", f"turn {t}") for c in (101, 102, 104) for t in range(140 + c % 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((*(x if x is not None else -1 for x in tuple(r)),) for r in prefix_trie.conversation_trie(df).collect())
    assert got == plain_trie(rows)
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0
