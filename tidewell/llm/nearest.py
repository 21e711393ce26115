"""Exact nearest neighbours by a block matrix join.

Queries and candidates are dealt into tiles of bounded size; each pair of tiles is one task's work. A tile is stored as int8
numbers with a scale for each vector, and the product of two tiles gives approximate distances whose error is at most the sum
of the two vectors' quantisation residuals. A candidate survives if its lower bound isn't above the k-th smallest upper bound
of its query; survivors are recomputed from the original numbers in double precision, so the result is exact. Each tile pair
yields at most k rows for each query, kept in a heap; the heaps of all tile pairs are merged by query.

Defined cases: vectors that are null, all zero, or hold null or non-finite numbers take no part; vectors of different length
aren't compared; ties go to the smaller id; an id stands for one vector: repeated rows count once, and of an id's different vectors
the first in array order is taken; equal vectors of other ids are candidates; numbers of any size are compared, also where their
squares leave doubles;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import by_size, cut

#: Repeated ids up to which their list is broadcast.
BROADCAST_IDS = 1_000_000
QUERY_TILE, CANDIDATE_TILE = 16_384, 16_384
#: Rows of a product that are in memory at once, and numbers of recomputed pairs.
STRIP, NUMBERS = 128, 1 << 21
OUT = "query_id long, vec_id long, score double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, scales, and the norms of what is left, for the rows of ``x`` (doubles)."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, 1e-300)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows, added up from the first number to the last; rows whose squares would leave doubles are scaled first."""
    with np.errstate(over="ignore"):
        apart = x - y
        far = np.abs(apart).max(axis=1)
        out = np.sqrt(np.cumsum(apart**2, axis=1)[:, -1])
    odd = np.flatnonzero((far > 2.0**500) | ((far < 2.0**-450) & (far > 0)))
    if odd.size:
        power = np.frexp(np.maximum(np.abs(x[odd]).max(axis=1), np.abs(y[odd]).max(axis=1)) if np.isinf(far[odd]).any() else far[odd])[1] + 2
        part = np.ldexp(x[odd], -power[:, None]) - np.ldexp(y[odd], -power[:, None])
        with np.errstate(over="ignore"):
            out[odd] = np.ldexp(np.sqrt(np.cumsum(part**2, axis=1)[:, -1]), power)
    return out


def tile_pair(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, distance) of each query's k nearest among the candidates, exactly."""
    if not len(q) or not len(c):
        return []
    with np.errstate(over="ignore"):
        (qc, qs, qe), (cc, cs, ce) = quantise(q), quantise(c)
    # products of int8 tiles in single precision are whole numbers; they are exact below 2**24, so long vectors go by parts
    parts = range(0, q.shape[1], 1024)
    qf, cf = qc.astype(np.float32), cc.astype(np.float32)
    with np.errstate(over="ignore"):
        qn, cn = (qc.astype(np.float64) ** 2).sum(axis=1) * qs**2, (cc.astype(np.float64) ** 2).sum(axis=1) * cs**2
    out, step = [], max(1, NUMBERS // q.shape[1])
    for low in range(0, len(q), STRIP):
        rows = slice(low, low + STRIP)
        product = sum((qf[rows, p : p + 1024] @ cf[:, p : p + 1024].T).astype(np.float64) for p in parts)
        with np.errstate(over="ignore", invalid="ignore"):
            near = qn[rows, None] + cn - 2 * product * (qs[rows, None] * cs)
            near = np.sqrt(np.maximum(near, 0))
            slack = qe[rows, None] + ce + 1e-6 * near + 1e-7 * np.sqrt(qn[rows, None] + cn)  # the last two cover rounding
            lower, upper = near - slack, near + slack
        known = np.isfinite(lower) & np.isfinite(upper)  # squares of numbers beyond 1e150 leave doubles; such pairs survive
        same = q_ids[rows, None] == c_ids
        upper = np.where(same | ~known, np.inf, upper)
        bound = np.partition(upper, k - 1, axis=1)[:, k - 1] if k <= upper.shape[1] else np.full(len(upper), np.inf)
        r, j = np.nonzero((np.where(known, lower, 0.0) <= bound[:, None]) & ~same)
        score = np.empty(len(r))
        for a in range(0, len(r), step):  # many survivors (ties) are recomputed by parts
            score[a : a + step] = exact(q[low + r[a : a + step]], c[j[a : a + step]])
        ends = np.searchsorted(r, np.arange(len(upper) + 1))
        for i in range(len(upper)):
            found = zip(score[ends[i] : ends[i + 1]].tolist(), c_ids[j[ends[i] : ends[i + 1]]].tolist())
            out += [(int(q_ids[low + i]), v, s) for s, v in heapq.nsmallest(k, found)]
    return out


def once_each(rows: DataFrame) -> DataFrame:
    """A row for each id. Only rows of repeated ids are shuffled; of an id's vectors the first in order stands."""
    again = cut(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"))
    if not again.limit(1).count():
        return rows
    some = by_size(again, BROADCAST_IDS)
    first = rows.join(some, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return cut(rows.join(some, "vec_id", "left_anti").unionByName(first))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, vector: str = "embedding", query_tile: int = QUERY_TILE, candidate_tile: int = CANDIDATE_TILE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of each row whose ``vec_id`` is divisible by ``every``."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & usable)
    rows = once_each(rows).withColumn("dim", F.size("v"))
    queries = rows.filter(F.col("vec_id") % every == 0)
    n, m = rows.count(), queries.count()
    across, down = max(1, -(-n // candidate_tile)), max(1, -(-m // query_tile))
    # every query meets every candidate once: both are copied along the other's tiles, some dozen times at most for each
    # million rows; ids are spread by their hash, so no tile is hot
    spread = lambda tiles: F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")
    every_tile = lambda tiles: F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    left = queries.withColumn("down", spread(down)).withColumn("across", every_tile(across))
    right = rows.withColumn("across", spread(across)).withColumn("down", every_tile(down))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = [(t["vec_id"].to_numpy(), np.array(t["v"].combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1)) if t.num_rows else (np.empty(0, np.int64), np.empty((0, 0))) for t in (a, b)]
        found = tile_pair(*parts[0], *parts[1], k)
        columns = list(zip(*found)) or [[]] * 3
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    keys = ("dim", "down", "across")
    heaps = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return heaps.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
