"""The pipeline's stages on nulls, empty tables, repeated rows, long texts and clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, rank int, component_id long"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, None if t is None else len(t), None, 3, -1) for k, t, lang, s in rows], DOC)


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioubcdfgklmnprst") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    texts = [prose(rng, 90) for _ in range(30)]
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "s") for k, t in enumerate(texts)]
    rows += [(100, texts[1], "en", "s"), (1, texts[1], "en", None), (None, texts[2], "en", "s"), (None, None, None, None), (101, "", "en", "s"), (102, prose(rng, 30_000), "en", "s"), (103, texts[4] + ' password = "Abcdefgh12345678"', "en", "s")]
    return frame(spark, rows)


def test_every_stage_keeps_columns_and_takes_odd_rows(spark, docs, tmp_path):
    table, ids = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, "")
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        table = spark.read.parquet(str(tmp_path / str(k)))
        ids.append([r[0] for r in table.select("doc_id").collect()])
    good, once, clean, mixed, packed = ids
    assert 101 not in good and 102 in good and good.count(None) == 1  # texts with too few words go, a missing id stays
    assert 100 not in once and once.count(1) == 1 and 103 not in once and once.count(None) == 1
    assert sorted(map(str, clean)) == sorted(map(str, once)) and set(mixed) == set(clean) and set(packed) == set(mixed)


def test_secrets_of_kept_rows_are_replaced(spark, docs):
    out = corpus_pipeline.without_secrets(spark, docs, "").filter("doc_id = 103").first()
    assert "Abcdefgh12345678" not in out["text"] and out["n_chars"] == len(out["text"])


def test_empty_tables_pass_through(spark, docs):
    table = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, "")
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)
    assert corpus_pipeline.packed(spark, table.withColumn("piece", F.lit(1)), "").count() == 0
