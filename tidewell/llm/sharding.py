"""Reproducible shuffle into shards by a keyed permutation of global row numbers.

Rows get numbers 0 to n-1 that depend on their keys alone, not on files, partitions or cluster size: equal rows are counted
first, keys are ranked within hash buckets whose number grows with the table, and the buckets' counts, summed up, give each
bucket's first number. Equal rows come as one row with a count through all shuffles. A Feistel network over the next power of
four permutes these numbers; values of n and above walk on along their cycle until they fall below n. Shard and slot follow
by arithmetic: place % shards and place // shards. Shard sizes in rows differ by one at most (law ``rows``), and slots are
gapless. Only ids, sizes and checksums are shuffled, never texts.

Defined cases: a null text has size 8 and the checksum of the empty string; null ids rank first; repeated rows get places of
their own; an empty table gives an empty result; clashing extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tidewell.llm.common import by_size, cut

#: Hash buckets that keys are ranked in, at least, and rows for which there is one more; their table of counts is one task's.
BUCKETS, BUCKET_ROWS = 4096, 1_000_000
#: Equal rows that one task writes out; more are dealt to several tasks.
EQUAL_ROWS = 100_000
ROUNDS = 4
#: Buckets up to which their table is broadcast, 16 bytes each.
BROADCAST_BUCKETS = 1_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function: the network's round function before it is cut to half the bits."""
    x = x + np.uint64(key & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def feistel(x: np.ndarray, half: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0 to 4**half - 1."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in range(rounds):
        left, right = right, left ^ (mix(right, (seed * rounds + k + 1) * 0x9E3779B97F4A7C15) & mask)
    return (left << np.uint64(half)) | right


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0 to n - 1, by cycle walking."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    out = feistel(numbers.astype(np.uint64), half, seed)
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = feistel(out[far], half, seed)
    return out.astype(np.int64)


def number_rows(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (``n`` of them) with ``row_number`` from 0, by hash bucket, then by all columns."""
    keys = rows.columns
    buckets = max(BUCKETS, n // BUCKET_ROWS)
    distinct = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    distinct = cut(distinct)
    counts = distinct.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    first = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_bucket").orderBy(*keys)) - F.col("_n")
    placed = distinct.withColumn("_before", before).join(by_size(first, BROADCAST_BUCKETS), "_bucket").withColumn("_first", F.col("_first") + F.col("_before"))
    part = lambda d, k: d.withColumn("row_number", F.explode(F.sequence(F.col("_first") + k, F.col("_first") + F.least(k + EQUAL_ROWS, "_n") - 1)))
    few = part(placed.filter(F.col("_n") <= EQUAL_ROWS), F.lit(0).cast("long"))
    many = placed.filter(F.col("_n") > EQUAL_ROWS).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(EQUAL_ROWS).cast("long"))))
    many = part(many.repartition(*keys, "_k"), F.col("_k"))
    return few.select(*keys, "row_number").unionByName(many.select(*keys, "row_number"))


def shard_rows(rows: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``row_number``, ``shard`` and ``slot``. All columns are the key, so they should be few and small."""
    rows = cut(rows.drop("row_number", "shard", "slot"))
    n = rows.count()
    numbered = number_rows(rows, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permute(batch.column(batch.num_columns - 1).to_numpy(), n, seed)
            shard, slot = pa.array((place % shards).astype(np.int32)), pa.array(place // shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, shard, slot], names=[*batch.schema.names, "shard", "slot"])

    schema = StructType([*numbered.schema.fields]).add("shard", IntegerType()).add("slot", LongType())
    return numbered.mapInArrow(run, schema)


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 42) -> DataFrame:
    """The contract's columns; law ``rows``, so there is no ``grown_shard``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(sized.select("doc_id", "text_crc32", "size"), shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
