"""The pipeline held against a brute-force version of its stages."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm.test_set_operators import classes
from tests.llm.test_text_operators import base_spans
from tidewell.llm import packing, quality


def test_stages_on_the_small_scale(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs.collect()
    good = {r["doc_id"]: r["text"] for r in seen["quality rules"]}
    judged = {r["doc_id"]: r["kept"] for r in quality.assess(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert good == {k: t for k, t in texts.items() if judged[k]}
    ids = sorted(good)
    roots, _ = classes([good[k] for k in ids], 5)
    assert {r["doc_id"] for r in seen["near-duplicates"]} == {ids[r] for r in set(roots)}
    assert len(seen["secret scan"]) == len(seen["near-duplicates"])
    for r in seen["secret scan"]:
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"]) and (r["text"] == good[r["doc_id"]] or "[SECRET]" in r["text"])
    mixed = Counter(r["doc_id"] for r in seen["source mixture"])
    assert set(mixed) == {r["doc_id"] for r in seen["secret scan"]}
    vocabulary = packing.word_ids(packing.default_tokenizer())
    length = {r["doc_id"]: len(vocabulary.ids(r["text"])) // 4 + 1 for r in seen["secret scan"]}
    packed = Counter()
    for r in seen["packing"]:
        packed[r["doc_id"]] += r["length"]
    assert packed == {k: n * length[k] for k, n in mixed.items()}


def test_run_reads_what_it_wrote(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
