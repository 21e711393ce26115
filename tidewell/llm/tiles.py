"""Products of tiles of a sparse incidence matrix, documents by shingles: exact overlaps in blocks of documents, and links between components.

A block is a set of documents any two of which may be similar. Blocks that share documents are put together as a family where that is
less work, and blocks are cut into tiles whose rows and shingles are bounded. Each two tiles are one task's product: overlap counts are
added up column by column, pairs below the size-derived bounds are discarded, and what remains gives at most one link for two
components. So no pair of documents is a row before it is known to be a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import by_size, cut, map_texts, store
from tidewell.llm.components import connected_components
from tidewell.llm.shingling import WordHash, shingle_hashes, split_words

#: Ids, and families, up to which their list is broadcast.
BROADCAST_IDS = 1_000_000
#: Rows of a tile: as many as hold so many shingles at least, between the two bounds.
TILE_SHINGLES, LEAST_ROWS, MOST_ROWS = 1 << 20, 64, 1024
#: Columns of a tile that are multiplied at once, and rows a column must have for that; others add up their pairs.
COLUMNS, DENSE = 2048, 16


def tile_rows(largest: str) -> Column:
    """Rows of a tile whose largest set has so many shingles."""
    return F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(MOST_ROWS), F.floor(F.lit(TILE_SHINGLES) / F.greatest(F.col(largest), F.lit(1)))))


def incidence(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``doc_id, columns``: the shingles of the documents in ``ids``, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            sets = [shingle_hashes(split_words(t.as_py()), width, hashes).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "columns"])

    return map_texts(docs.join(by_size(ids, BROADCAST_IDS), "doc_id", "left_semi"), run, "doc_id long, columns binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The product of the sparse incidence matrix with its transpose: for each two rows how many columns they share."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    column, row = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    first = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
    rows_of = np.diff(np.append(first, len(column)))
    number = np.repeat(np.arange(len(first)), rows_of)
    many = rows_of >= DENSE
    # columns of few rows: entries that stand d apart in a column
    few = np.flatnonzero(~many[number])
    c, r = number[few], row[few]
    for d in range(1, DENSE):
        same = np.flatnonzero(c[d:] == c[:-d])
        if not same.size:
            break
        out += np.bincount(r[same] * n + r[same + d], minlength=n * n).reshape(n, n)
    out += out.T
    # columns of many rows: dense products; single precision is exact for such numbers of columns
    place = np.cumsum(many) - 1
    entries = np.flatnonzero(many[number])
    p, r = place[number[entries]], row[entries]
    for a in range(0, int(many.sum()), COLUMNS):
        x, y = np.searchsorted(p, [a, a + COLUMNS])
        m = np.zeros((n, COLUMNS), np.float32)
        m[r[x:y], p[x:y] - a] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def tile_links(doc: np.ndarray, component: np.ndarray, size: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components in two tiles (sides 0 and 1; 2 if there is one tile): one for two components that meet at most."""
    small, large = np.minimum(size[:, None], size), np.maximum(size[:, None], size)
    on = (100 * small >= percent * large) & (component[:, None] != component) & ((side[:, None] == 2) | (side[:, None] < side))
    on &= (doc[:, None] < doc) | (side[:, None] != 2)
    if not on.any():
        return []
    shared = overlaps(sets)
    on &= (shared > 0) & (100 * shared >= percent * (size[:, None] + size - shared))
    i, j = np.nonzero(on)
    if not i.size:
        return []
    ends = np.sort(np.column_stack([component[i], component[j]]), axis=1)
    once = np.unique(ends, axis=0, return_index=True)[1]
    return list(zip(doc[i[once]].tolist(), doc[j[once]].tolist()))


def families(members: DataFrame) -> DataFrame:
    """``members`` with blocks that share documents put together as one, where that copies fewer rows than the blocks do.

    Near copies share many blocks; as a family each row is copied once for each tile of the family, and not for each of its blocks.
    """
    blocks = members.groupBy("key").agg(F.min("doc_id").alias("v"), F.count("*").alias("n"), F.max("n_shingles").alias("largest"))
    placed = members.select("key", "doc_id", "component", "n_shingles").join(blocks, "key")
    found = cut(connected_components(placed.select(F.col("doc_id").alias("u"), "v"))).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    placed = cut(placed.join(found, "doc_id"))
    by_block = placed.groupBy("family").agg(F.sum(F.ceil(F.col("n") / tile_rows("largest"))).alias("by_block"), F.max("largest").alias("largest"))
    cost = found.groupBy("family").agg(F.count("*").alias("docs")).join(by_block, "family")
    whole = cut(cost.select("family", (F.col("docs") * F.ceil(F.col("docs") / tile_rows("largest")) <= F.col("by_block")).alias("whole")))
    named = placed.join(by_size(whole, BROADCAST_IDS), "family").withColumn("key", F.when(F.col("whole"), F.concat(F.lit("family "), "family")).otherwise(F.concat(F.lit("block "), "key")))
    return named.select("key", "doc_id", "component", "n_shingles").distinct()


def tile_pairs(members: DataFrame) -> DataFrame:
    """``key, a, b, doc_id, component, side`` of large blocks' members, for each two tiles that may hold links.

    A component that fills a tile has tiles of its own, which aren't paired with one another.
    """
    of = members.groupBy("key", "component").agg(F.count("*").alias("own"))
    largest = members.groupBy("key").agg(F.max("n_shingles").alias("largest")).select("key", tile_rows("largest").alias("rows"))
    of = of.join(largest, "key").withColumn("pure", F.when(F.col("own") >= F.col("rows"), F.col("component").cast("string")).otherwise(F.lit("mixed")))
    sizes = of.groupBy("key", "pure").agg(F.ceil(F.sum("own") / F.max("rows")).alias("tiles"))
    placed = members.join(of.select("key", "component", "pure"), ["key", "component"]).join(sizes, ["key", "pure"])
    placed = cut(placed.withColumn("tile", F.concat_ws(":", "pure", F.pmod(F.xxhash64("doc_id"), F.col("tiles")))))
    tiles = placed.select("key", "pure", "tile").distinct()
    other = tiles.select("key", F.col("pure").alias("pure_b"), F.col("tile").alias("b"))
    pairs = tiles.withColumnRenamed("tile", "a").join(other, "key").filter("a <= b and not (pure = pure_b and pure != 'mixed')").select("key", "a", "b")
    left = placed.join(pairs.withColumnRenamed("a", "tile"), ["key", "tile"]).withColumnRenamed("tile", "a").withColumn("side", F.when(F.col("a") == F.col("b"), 2).otherwise(0))
    right = placed.join(pairs.filter("a < b").withColumnRenamed("b", "tile"), ["key", "tile"]).withColumnRenamed("tile", "b").withColumn("side", F.lit(1))
    columns = ["key", "a", "b", "doc_id", "component", "n_shingles", "side"]
    return left.select(*columns).unionByName(right.select(*columns))


def product(tiles: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) that the products of ``tile_pairs`` give."""

    def run(t: pa.Table) -> pa.Table:
        doc, component, size, side = (t[c].to_numpy() for c in ("doc_id", "component", "n_shingles", "side"))
        found = tile_links(doc, component, size, side, [np.frombuffer(c.as_buffer(), np.uint64) for c in t["columns"]], percent)
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    tiles = cut(tiles)
    sets = store(incidence(docs, cut(tiles.select("doc_id").distinct()), width))
    return tiles.join(sets, "doc_id").groupBy("key", "a", "b").applyInArrow(run, "u long, v long")
