"""Operators that work row by row: token counts, secrets, HTML, quality signals."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewell.llm import html_extract, quality, secret_scan, token_counts

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=None):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({c: F.lit(7) for c in extra}) if extra else df


# token counts


@pytest.fixture(scope="module")
def sentencepiece_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())


def test_counts_equal_the_library_on_random_texts(sentencepiece_model):
    rng = random.Random(2)
    parts = [" ", "  ", "   ", "▁", "a", "the", "in", "ing", "\n", "é", "中", "文", "<s>", "\x00", "①", "xxxxx", "er", "tion", "1", "23", "!", "\U0001f600"]
    counts = token_counts.Counts(token_counts.load(token_counts.default_model()))
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert token_counts.count_text(text, counts, rng.choice([1, 2, 3, 5, 1000])) == len(sentencepiece_model.encode(text)), repr(text)


def test_state_maps_compose_associatively_at_any_cut():
    counts = token_counts.Counts(token_counts.load(token_counts.default_model()))
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("▁▁abertionth\n") for _ in range(rng.randint(3, 300)))
        i, j = sorted(rng.sample(range(len(text)), 2))
        a, b, c = (token_counts.chunk_map(x, counts) for x in (text[:i], text[i:j], text[j:]))
        before = counts.transducer.run("".join(rng.choice("▁abert") for _ in range(5)))[0]
        want = counts.transducer.run(text, before)[1]
        for whole in (token_counts.compose(token_counts.compose(a, b), c), token_counts.compose(a, token_counts.compose(b, c))):
            assert whole(before)[1] == want and whole(token_counts.START)[1] == counts.transducer.run(text)[1]


def test_states_stay_bounded_within_a_word(monkeypatch, sentencepiece_model):
    monkeypatch.setattr(token_counts, "KEEP_STATES", 500)
    counts = token_counts.Counts(token_counts.load(token_counts.default_model()))
    counts.transducer.clear()
    rng = random.Random(5)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    assert token_counts.count_text(word, counts) == len(sentencepiece_model.encode(word)) == token_counts.count_text(word, counts, 777)
    assert len(counts.transducer.states) <= 502


def test_token_query_on_edge_texts(spark, sentencepiece_model):
    texts = [None, "", " ", "a b", "a b", "x" * 200_000, "wörd " * 5000]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(documents(spark, texts, ["n_tokens"]), chunk=1000).collect()}
    for k, t in enumerate(texts):
        assert got[k]["n_tokens"] == len(sentencepiece_model.encode(t or "")) and got[k]["n_bytes"] == len((t or "").encode())
        assert got[k]["over_limit"] == (got[k]["n_tokens"] > 4096)
    assert token_counts.count_tokens(documents(spark, [])).count() == 0


# secrets


def base_spans(text):
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def test_one_automaton_equals_each_regex():
    scanner, rng = secret_scan.compile_rules(), random.Random(1)
    parts = ["token", "secret", "=", ":", " ", "'", '"', "api_key", "Passwd", "AKIA", "0123456789abcdef", "AB12", "x", "é", "\n", "mysecret", "---", "A" * 15, "f" * 9]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for text, found in zip(texts, secret_scan.scan_texts(scanner, [t.encode() for t in texts])):
        assert [(s, k, e) for k, s, e in found if k < 3] == base_spans(text), repr(text)


def test_minimised_automaton_accepts_what_the_nfa_does():
    rules = (("a", r"ab+c", 0, 0), ("b", r"[x-z]{3,}", 0, 0))
    found = secret_scan.scan_texts(secret_scan.compile_rules(rules), [b"abbbc xyzzy abc"])[0]
    assert found == [(0, 0, 5), (1, 6, 11), (0, 12, 15)]


def test_added_kinds_and_redaction(spark):
    key = "ghp_" + "a1B2" * 9
    texts = [f"é {key} end", None, "", "plain words", "-----BEGIN RSA PRIVATE KEY-----", "token: abcdefghijklmnop", "token: abcdefghijklmnop"]
    df = documents(spark, texts, ["spans"])
    got = [r for r in secret_scan.digest(df).orderBy("doc_id").collect()]
    assert got[0]["spans"] == f"github:2:{2 + len(key)}" and got[4]["spans"].startswith("pem:0:")
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[5]["n_assign"] == 1
    clean = [r["text"] for r in secret_scan.redact(df).orderBy("doc_id").collect()]
    assert clean == ["é [SECRET] end", None, "", "plain words", "[SECRET]", "[SECRET]", "[SECRET]"]
    assert secret_scan.digest(documents(spark, [])).count() == 0


# html


def test_training_separates_held_out_pages():
    model, right, total = html_extract.trained(), 0, 0
    for html in html_extract.training_pages(200, 99):
        page = html_extract.parse(html)
        for y, p, t in zip(html_extract.states(page), model.marginals(page), page.text):
            if t is not None:
                total += 1
                right += (p > 0.5) == (y == html_extract.CONTENT)
    assert right / total > 0.98


def test_marginals_equal_enumeration():
    from itertools import product

    model = html_extract.trained()
    page = html_extract.parse("<div class=x><p>One two three.</p><nav><a href=/>m</a></nav></div>")
    n = len(page.parent)
    weight = [0.0] * n
    total = 0.0
    for y in product(range(3), repeat=n):
        p = 1.0
        for i in range(n):
            p *= model.emission(page.kind[i])[y[i]] * (model.potential(page.kind[i])[y[page.parent[i]]][y[i]] if i else 1.0)
        total += p
        for i in range(n):
            weight[i] += p * (y[i] == html_extract.CONTENT)
    assert model.marginals(page)[1:] == pytest.approx([w / total for w in weight][1:])


def test_articles_of_the_pages_table_are_read_whole(spark, sf):
    import html as entities

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}

    def wanted(page):
        inner = re.sub(r"<br>|</?p>|</?h1>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        return " ".join(entities.unescape(re.sub(r"<[^>]*>", "", inner)).split())

    got = html_extract.extract(pages).collect()
    assert len(got) == len(raw) and all(r["text"] == wanted(raw[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)


def test_html_edge_cases(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var a='</p><p>no';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        "<article><h1>Title here</h1><p>First   paragraph &amp; more text, with words.<p>Second <b>bold</b>ly written one.</p><aside class=ad>Buy now</aside></article>"
        "<div id=comments><p>Nice post! I agree with all of it.</p></div><form><label>Mail</label><input></form><footer>&copy; 2024</footer>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (4, "u", "<p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[1] == "Title here First paragraph & more text, with words. Second boldly written one." and got[2] == got[3] == ""
    assert html_extract.extract(df.limit(0)).count() == 0


# quality


def signals_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_signals_equal_a_direct_count(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a", "a b", "é ü\n\n é ü\n x#*$", "a b c a b c", "w " * 3000]
    texts += ["".join(rng.choice(["a", "b", "c", " ", "\n", "#", "é", "\x0b", " a b c"]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    got = quality.signals(documents(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in quality.BASE) for r in got] == [signals_of(t) for t in texts]


def test_fences_follow_the_group_and_clean_documents_stay(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    clean = [" ".join(word() for _ in range(80)) for _ in range(60)]
    junk = [" ".join(word() + "###" for _ in range(80)) for _ in range(20)]
    rows = [(k, t, None if k % 2 else "en", "hot", 1) for k, t in enumerate(clean + junk)]
    got = {r["doc_id"]: r["kept"] for r in quality.assess(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[k] for k in range(60)) and not any(got[k] for k in range(60, 80))


def test_filter_keeps_columns_and_empty_tables(spark):
    df = documents(spark, [None, "a"], ["kept", "n_words"])
    assert quality.keep_good(df).columns == df.columns and quality.keep_good(df).count() == 0
    assert quality.assess(documents(spark, [])).count() == 0


def test_quality_plan_has_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = quality.keep_good(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_whole_table_of_the_small_scale(spark, sf, sentencepiece_model):
    texts = pq.read_table(f"{sf}/documents.parquet").to_pandas().set_index("doc_id").text
    for r in token_counts.count_tokens(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        assert r["n_tokens"] == len(sentencepiece_model.encode(texts[r["doc_id"]]))


@pytest.mark.parametrize("sizes", [range(1, 8), range(8, 70, 9), (70,)])
def test_token_counts_by_rows_of_chunks(spark, sentencepiece_model, sizes):
    """Chunks of every kind of size, maps composed by two and by many, equal rows, an id on two texts, no id."""
    rng = random.Random(8)
    letters = ["  ", " ", "the", "ing", "\n", "é", "中", "▁", "xyzw" * 30, "a1", "\U0001f600"]
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (3, 9, 40, 40, 90)] + ["ab" * 150, "ab" * 150, "", None, "the end"]
    rows = [(k if k != 4 else None, t) for k, t in enumerate(texts)]
    rows += [rows[2]] * 3 + [rows[4]] + [(2, texts[3]), (5, "ab" * 151), (9, "the end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((k, len((t or "").encode()), len(sentencepiece_model.encode(t or ""))) for k, t in rows)
    for chunk in sizes:
        got = token_counts.count_tokens(df, chunk=chunk, fan=2 + chunk % 5 * 3).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want, chunk
