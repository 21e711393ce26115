"""The mixture on sources that are less even than the target, and on such that are not."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import assert_same
from tidewell.llm import mixing, queries


def test_skewed_sources_are_mixed_as_the_oracle_says(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "hot").otherwise(F.col("source")))
    docs.coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    name = "op10_temperature_mixing"
    df = queries.queries()[name](spark, str(tmp_path))
    assert_same(df, queries.oracle_sql()[name], str(tmp_path))
    rows = df.collect()
    weights = {r["source"]: r["weight"] for r in rows}
    entropy = lambda shares: -sum(w * math.log(w) for w in shares)
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
    present = entropy(n / sum(tokens.values()) for n in tokens.values())
    assert abs(entropy(weights.values()) - (present + mixing.LIFT * (math.log(len(weights)) - present))) < 1e-6
    assert max(r["copies"] for r in rows) > 1
    staged = Counter(r["doc_id"] for r in corpus_pipeline.mixed_sources(spark, docs, str(tmp_path)).select("doc_id").collect())
    assert staged == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_sources_more_even_than_the_target_keep_their_shares(spark):
    df = spark.createDataFrame([(k, "a b", "en", f"s{k % 4}", 3) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r["weight"], r["copies"]) for r in mixing.mix(df).collect()} == {(0.25, 1)}


def test_a_target_below_the_present_entropy_sharpens(spark):
    df = spark.createDataFrame([(k, "a b", "en", "a" if k % 5 < 2 else f"s{k % 5}", 3) for k in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = mixing.mix(df, evenness=0.8, most_repeats=50).collect()
    weights = {r["source"]: r["weight"] for r in rows}
    assert abs(-sum(w * math.log(w) for w in weights.values()) - 0.8 * math.log(4)) < 1e-6
    assert weights["a"] > 0.4 and min(r["copies"] for r in rows) == 1 and max(r["copies"] for r in rows if r["source"] == "a") > 1


def test_the_tables_sources_move_and_passes_come_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert max(r["copies"] for r in rows.values()) > 1
    out = mixing.realise(docs, number="turn").select("doc_id", "turn").collect()
    keys = [(r["turn"], rows[r["doc_id"]]["block_key"], rows[r["doc_id"]]["doc_key"]) for r in out]
    assert keys == sorted(keys) and Counter(r["doc_id"] for r in out) == {k: r["copies"] for k, r in rows.items() if r["copies"]}
