"""A join of similar texts by a blocked sparse matrix product of documents by word n-grams.

Which blocks are multiplied follows from sizes. Two sets of similarity ``percent`` or more differ in size by a bounded ratio, so
sizes fall into bands and only sets of one band or of neighbouring ones meet. Within a band, the shingles in which two such sets
differ are bounded as well, by ``d`` say: if the columns are dealt by hash into ``d + 1`` groups, the two rows are equal in one group
at least. A block is thus the documents whose rows are equal in one column group; no linked pair is outside all blocks, and a
passage or a word that many documents share puts none of them into one block.

Documents of equal word sequences are one row. A document is linked first with the smallest one of the block it shares most often;
the components of these links settle nearly all blocks. In blocks that still hold several components, those of a few rows give
their pairs, once each; others, those that share documents together if that is less work, are cut into tiles of bounded size, and each two tiles are multiplied in a task: overlap counts are
added up column by column, pairs below the size-derived bounds are discarded, and what remains gives at most one link for two
components. So no number of rows grows with the square of a block, and no block is capped.

Defined cases: null and blank texts have no shingles and are linked with nothing; with fewer words than a shingle has, the whole
sequence is one shingle; repeated rows give repeated results, and rows of one id with different texts are one document with the
links of them all; rows without an id take no part (no component); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import by_size, cut, map_texts, store
from tidewell.llm.components import connected_components
from tidewell.llm.near_duplicates import confirm
from tidewell.llm.shingling import WordHash, set_size, shingle_hashes, split_words, words_key
from tidewell.llm.tiles import BROADCAST_IDS, families, product, tile_pairs

#: Rows of a block up to which its pairs are rows; larger blocks are cut into tiles.
FEW = 12
ROWS = "doc_id long, n_shingles long, words_key binary, blocks array<long>"


def bands(most: int, percent: int) -> np.ndarray:
    """Smallest sizes of the bands up to size ``most``, and one more; sets of similar sizes are in one band or in neighbouring ones."""
    low = [1]
    while low[-1] <= most:
        low.append(low[-1] * 100 // percent + 1)
    return np.array(low + [low[-1] * 100 // percent + 1])


def block_keys(own: np.ndarray, n: int, percent: int, low: np.ndarray) -> np.ndarray:
    """Keys of the column groups of a set (sorted hashes), for its band and the next, where it meets larger sets."""
    band = int(np.searchsorted(low, n, side="right")) - 1
    spread = own * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread ^ (spread >> np.uint64(29)), dtype=np.uint64)])
    out = []
    for b in (band, band + 1):
        groups = 2 * (int(low[b + 1]) - 1) * (100 - percent) // (100 + percent) + 1
        # sorted hashes fall into groups one after the other
        ends = np.searchsorted(own >> np.uint64(32), np.arange(1, groups + 1, dtype=np.uint64) * np.uint64(1 << 32) // np.uint64(groups))
        part = np.diff(sums[np.concatenate([[0], ends])]) if groups else sums[:0]
        key = (part ^ np.uint64(b)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(groups, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append(key ^ (key >> np.uint64(32)))
    return np.concatenate(out).view(np.int64)


def profile(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A row for each document: its set's size, a key that equal word sequences share, and its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, low = WordHash(), bands(1000, percent)
        for batch in batches:
            sizes, keys, blocks = [], [], []
            for value in batch.column(1):
                words = split_words(value.as_py())
                n = set_size(words, width)
                if n >= low[-3]:
                    low = bands(2 * n, percent)
                sizes.append(n)
                keys.append(words_key(words) if n else None)
                blocks.append(block_keys(shingle_hashes(words, width, hashes), n, percent, low) if n else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(blocks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "words_key", "blocks"])

    return map_texts(docs, run, ROWS)


def similar_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id``: a row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = store(profile(docs, width, percent))
    classes = cut(rows.filter("words_key is not null and doc_id is not null").groupBy("words_key").agg(F.min("doc_id").alias("rep")))
    whole = by_size(classes.select(F.col("rep").alias("doc_id")), BROADCAST_IDS)
    reps = rows.filter("words_key is not null").select("doc_id", "n_shingles", "blocks").join(whole, "doc_id", "left_semi")
    keyed = reps.select("doc_id", F.explode("blocks").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count("*").alias("n")).filter("n > 1"))
    members = cut(keyed.join(by_size(shared, BROADCAST_IDS), "key").distinct())
    stars = members.filter("doc_id > centre").groupBy("doc_id", "centre").agg(F.count("*").alias("n"))
    stars = stars.groupBy("doc_id").agg(F.max(F.struct("n", F.col("centre").alias("u"))).alias("most")).select("most.u", F.col("doc_id").alias("v"))
    links = cut(confirm(cut(stars), docs, width, percent))
    groups = cut(connected_components(links))

    named = members.select("key", "doc_id").join(groups, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    ends = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).filter("x < y")
    sizes = reps.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    still = cut(named.join(ends.select("key", "n"), "key").join(sizes, "doc_id"))
    small = still.filter(F.col("n") <= FEW)
    other = small.select("key", F.col("doc_id").alias("v"), F.col("component").alias("of"), F.col("n_shingles").alias("m"))
    near = f"doc_id < v and component != of and 100 * least(n_shingles, m) >= {percent} * greatest(n_shingles, m)"
    pairs = small.join(other, "key").filter(near).select(F.col("doc_id").alias("u"), "v").distinct()
    more = confirm(cut(pairs), docs, width, percent)
    large = still.filter(F.col("n") > FEW)
    if large.limit(1).count():
        more = more.unionByName(product(tile_pairs(cut(families(large))), docs, width, percent))
    more = cut(more)
    if more.limit(1).count():
        groups = cut(connected_components(links.unionByName(more)))

    of = classes.join(groups, F.col("rep") == F.col("node"), "left").select("words_key", F.coalesce("component", "rep").alias("class_id"))
    out = rows.select("doc_id", "n_shingles", "words_key").join(of, "words_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("component_id"))
