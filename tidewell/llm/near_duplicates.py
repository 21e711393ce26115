"""Near-duplicate classes by one-permutation hashing.

Each text's set of word shingles is hashed once; the hash's upper bits name one of 256 bins, and each bin keeps its smallest
hash. Empty bins borrow from filled ones by optimal densification: a fixed pseudo-random sequence of bins, the same for all
texts, is followed to the first filled one. Bands of five bins are bucket keys. A pair at the similarity limit of 0.8 misses all
51 bands with a probability of about 2e-9.

Texts of equal word sequences are one class from the start. Within a bucket, candidates form a star round its smallest member, so a
bucket of n gives n - 1 pairs. Star pairs that share several buckets are confirmed first, on the full sets of words.
Components of confirmed links settle nearly all buckets. Documents of buckets that still hold several components are compared
exactly: shingles are ordered by how many of these documents hold them, rarest first, and two documents can only be similar if
the first shingle that they have in common stands near the front of both and leaves enough behind it. So pages of one template,
which differ in their own rare words, never meet, and what does meet is ruled out by four whole numbers a row before any text
is read. What is left is confirmed on the full sets, against large components chunk by chunk within a task. Shingles near the front of many
documents, as pages about the limit have them, give no pairs: their documents are cut into tiles, and tiles are multiplied (see
:mod:`tidewell.llm.tiles`), so what is shipped grows with the documents and tiles. No link is lost to the star's choice of centre, no
estimate discards a pair, no bucket is capped, and large groups never give all pairs as rows.

Defined cases: null and blank texts have no shingles and are linked with nothing; with fewer words than a shingle has, the
whole sequence is one shingle; repeated rows give repeated results; rows without an id take no part (no class, kept); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import by_size, cut, map_texts, store, words
from tidewell.llm.components import connected_components
from tidewell.llm.shingling import WordHash, set_size, shingle_hashes, shingles, split_words, words_key
from tidewell.llm.tiles import BROADCAST_IDS, families, product, tile_pairs

BINS, BAND, SEED = 256, 5, 11
BANDS = BINS // BAND
#: Buckets shared for a star pair to be confirmed in the first turn; what pairs with fewer hold is found in the second.
FIRST_SHARED = 4
#: Rows of one shingle that one task compares with as many others; more go by pairs of such parts.
PART = 4096
#: Rows of a shingle up to which its pairs are looked at one by one; the documents of others are multiplied in tiles.
FEW = 24
#: Components of more members are asked about as a whole; their members and the askers are cut into chunks.
SMALL, CHUNK_MEMBERS = 8, 256
#: A shingle in more than one of this many rows is frequent; so there are at most as many frequent ones, 16 bytes each.
FREQUENT = 50_000


@lru_cache(maxsize=1)
def borrow_order() -> np.ndarray:
    """For each attempt and each bin the bin to borrow from."""
    return np.random.default_rng(SEED).integers(0, BINS, size=(64 * BINS, BINS), dtype=np.int16)


def signature(hashes: np.ndarray) -> np.ndarray:
    """One-permutation signature with optimal densification, from sorted hashes (one at least)."""
    bins = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    sig, filled = np.zeros(BINS, dtype=np.uint64), np.zeros(BINS, dtype=bool)
    sig[bins[first]] = hashes[first]
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    order = borrow_order()
    for attempt in order:
        if not empty.size:
            return sig
        source = attempt[empty]
        found = filled[source]
        sig[empty[found]] = sig[source[found]]
        empty = empty[~found]
    sig[empty] = hashes[0]  # not met in practice: as many attempts as make a miss impossible but in theory
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band; its lower six bits are the band's number."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(BAND):
        keys = (keys ^ sig[k : BANDS * BAND : BAND]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return (keys & ~np.uint64(63) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


SKETCH = "doc_id long, n_shingles long, words_key binary, bands array<long>"


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document: its set's size, a key that equal word sequences share, and bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            sizes, keys, bands = [], [], []
            for value in batch.column(1):
                words = split_words(value.as_py())
                if not words:
                    sizes.append(0)
                    keys.append(None)
                    bands.append(None)
                    continue
                own = shingle_hashes(words, width, hashes)
                sizes.append(set_size(words, width))
                keys.append(words_key(words))
                bands.append(band_keys(signature(own)))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "words_key", "bands"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SKETCH)


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. Only texts that stand in a pair are shuffled."""
    ids = cut(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(by_size(ids, BROADCAST_IDS), "doc_id", "left_semi")
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in ("u", "v"))
    both = pairs.join(right, "v").join(left, "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            keep = []
            for k, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
                a = a.as_py()
                if a != last:
                    last, own = a, shingles(split_words(a), width)
                other = shingles(split_words(b.as_py()), width)
                common = len(own & other)
                if common and 100 * common >= percent * (len(own) + len(other) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["u", "v"])

    return map_texts(both.select("u", "v", "text_u", "text_v"), run, "u long, v long")


def needed_overlap(percent: int) -> tuple[str, str]:
    """SQL for the least number of shingles that a set of ``n_shingles`` has in common with a similar smaller set, and larger one."""
    up = lambda a, b: f"((n_shingles * {a} + {b} - 1) div {b})"
    return up(percent, 100), up(2 * percent, 100 + percent)


def front_shingles(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """For each of ``members`` (``doc_id, n_shingles`` and more) the shared shingles near the front of its set, as ``key``.

    Sets are ordered by frequency among ``members``, rarest first; ``place`` counts from 0. Shingles that no other member has
    take places but are left out. ``first`` tells whether a similar set of this size or more must have its first common shingle
    with this set here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            sets = [shingle_hashes(split_words(t.as_py()), width, hashes).view(np.int64) for t in batch.column(1)]
            if sets:
                ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], names=["doc_id", "key"])

    rows = store(map_texts(docs.join(by_size(members.select("doc_id"), BROADCAST_IDS), "doc_id", "left_semi"), run, "doc_id long, key long"))
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    many = max(1000, rows.count() // FREQUENT)
    frequent = F.broadcast(counts.filter(F.col("n") > many))  # no more than FREQUENT rows, as their counts add up to all rows
    # frequent shingles, the hot keys, get their counts from the broadcast list; no other key has more than `many` rows
    shared = rows.join(frequent, "key").unionByName(rows.join(frequent, "key", "left_anti").join(counts.filter(F.col("n") <= many), "key"))
    own = Window.partitionBy("doc_id")
    placed = shared.repartition("doc_id").dropDuplicates(["doc_id", "key"]).join(members, "doc_id")
    back = F.count("*").over(own) - F.row_number().over(own.orderBy("n", "key"))
    placed = placed.withColumn("place", F.col("n_shingles") - 1 - back)
    smaller, larger = needed_overlap(percent)
    placed = placed.filter(f"n_shingles - place >= {smaller}")
    return placed.withColumn("first", F.expr(f"n_shingles - place >= {larger}")).drop("n")


MEMBERS = ["key", "part", "side", "doc_id", "component", "comp_size", "n_shingles", "place", "first"]


def cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``u, v, component``: pairs from different components, in one row of a shingle they share, that its places don't rule out.

    If the shingle is the first that two sets share, they have at most as many in common as the shorter rest of the two holds.
    The larger component, if it isn't small, stands for its members: ``v`` is then null and ``component`` names it.
    ``rows`` are dealt by shingle and part and sorted by size, so groups are runs of rows.
    """

    def compare(group, side, doc, comp, comp_size, size, place, first):
        """``group`` numbers runs of rows; rows ``d`` apart are compared for each ``d`` that a run is long enough for."""
        rows, d, out = np.flatnonzero(first), 0, []
        while True:
            d += 1
            rows = rows[rows + d < len(group)]
            # sizes grow along a run, so what is too small here is too small for all that follow
            rows = rows[(group[rows] == group[rows + d]) & (100 * size[rows] >= percent * size[rows + d])]
            if not rows.size:
                break
            i, j = rows, rows + d
            room = np.minimum(size[i] - place[i], size[j] - place[j])
            # of two different parts, only pairs across them: those within come up in the part's own group
            on = (comp[i] != comp[j]) & ((100 + percent) * room >= percent * (size[i] + size[j])) & ((side[i] != side[j]) | (side[i] == 2))
            x, y = i[on], j[on]
            swap = comp_size[x] > comp_size[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            whole = comp_size[y] > SMALL
            out.append((doc[x], np.where(whole, comp[y], doc[y]), whole))
        found = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        if len(found[0]):
            large = np.flatnonzero(found[2])  # one row stands for all members of a large component
            once = large[np.unique(np.column_stack([found[0][large], found[1][large]]), axis=0, return_index=True)[1]]
            keep = np.concatenate([np.flatnonzero(~found[2]), once])
            found = [c[keep] for c in found]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def result(columns, upto: int) -> pa.RecordBatch:
            key, part, *other = (c[:upto] for c in columns)
            change = np.r_[False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])] if upto else np.zeros(0, bool)
            u, v, whole = compare(np.cumsum(change), *other)
            v, comp = pa.array(v, pa.int64(), mask=whole), pa.array(v, pa.int64(), mask=~whole)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), v, comp], names=["u", "v", "component"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns)]
            same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            upto = len(same) - int(same.sum())  # the last group may go on
            if upto:
                yield result(columns, upto)
            rest = [c[upto:] for c in columns]
        if rest is not None:
            yield result(rest, len(rest[0]))

    dealt = rows.select(*MEMBERS).repartition("key", "part").sortWithinPartitions("key", "part", "n_shingles", "doc_id")
    return dealt.mapInArrow(run, "u long, v long, component long")


def confirm_large(asked: DataFrame, groups: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) of each document ``u`` with the first similar member of ``component``, if there is one, in each chunk.

    A component's members and the documents that ask about it are cut into chunks, and each chunk of the one meets each of the
    other. So no row stands for a pair, and neither side of a large component is in one task.
    """
    wanted = asked.groupBy("component").agg(F.ceil(F.count("*") / CHUNK_MEMBERS).alias("down"))
    size = groups.join(wanted, "component").groupBy("component", "down").agg(F.ceil(F.count("*") / CHUNK_MEMBERS).alias("across"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    asked = cut(asked.join(size, "component").select("u", "component", deal("u", "down").alias("down"), each("across").alias("across")))
    inside = cut(groups.join(size, "component").select(F.col("node").alias("v"), "component", deal("node", "across").alias("across"), each("down").alias("down")))
    ids = cut(asked.select(F.col("u").alias("doc_id")).unionByName(inside.select(F.col("v").alias("doc_id"))).distinct())
    texts = docs.join(by_size(ids, BROADCAST_IDS), "doc_id", "left_semi")
    named = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    keys = ("component", "down", "across")
    left = asked.join(named("u"), "u").select("u", *[F.col(k).alias(f"{k}_u") for k in keys], "text_u")
    right = inside.join(named("v"), "v").select("v", *[F.col(k).alias(f"{k}_v") for k in keys], "text_v")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        members = [(v, shingles(split_words(t), width)) for v, t in zip(b["v"].to_pylist(), b["text_v"].to_pylist())]
        found = []
        for u, t in zip(a["u"].to_pylist(), a["text_u"].to_pylist()):
            own = shingles(split_words(t), width)
            for v, other in members:
                if 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)):
                    common = len(own & other)
                    if common and 100 * common >= percent * (len(own) + len(other) - common):
                        found.append((u, v))
                        break
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    asking, members = left.groupBy(*[f"{k}_u" for k in keys]), right.groupBy(*[f"{k}_v" for k in keys])
    return asking.cogroup(members).applyInArrow(run, "u long, v long")


def _open_documents(shared: DataFrame, reps: DataFrame, groups: DataFrame) -> DataFrame:
    """``doc_id, component, comp_size, n_shingles`` of the documents in buckets that hold several components."""
    named = groups.join(groups.groupBy("component").agg(F.count("*").alias("comp_size")), "component").withColumnRenamed("node", "doc_id")
    placed = shared.select("doc_id", "key").join(named, "doc_id", "left")
    placed = placed.withColumns({"component": F.coalesce("component", "doc_id"), "comp_size": F.coalesce("comp_size", F.lit(1).cast("long"))})
    open_keys = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("key")
    open_docs = placed.join(open_keys, "key", "left_semi").select("doc_id", "component", "comp_size").distinct()
    return open_docs.join(reps.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id")


def _in_parts(rows: DataFrame) -> DataFrame:
    """``rows`` of the shingles that several components share, in pairs of parts."""
    keys = rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.ceil(F.count("*") / PART).alias("parts"))
    members = rows.join(keys.filter("a < b").select("key", "parts"), "key")
    own = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(F.lit(0))
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    members = members.withColumn("part", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    return members.withColumn("side", side).select(*MEMBERS)


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: a row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(sketch(docs, width))
    classes = cut(rows.filter("words_key is not null and doc_id is not null").groupBy("words_key").agg(F.min("doc_id").alias("rep")))
    whole = by_size(classes.select(F.col("rep").alias("doc_id")), BROADCAST_IDS)
    reps = rows.filter("words_key is not null").join(whole, "doc_id", "left_semi")
    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count("*").alias("size")).filter("size > 1")
    shared = cut(banded.join(buckets, "key"))
    stars = shared.filter("doc_id > centre").groupBy(F.col("centre").alias("u"), F.col("doc_id").alias("v")).agg(F.count("*").alias("n"))
    links = cut(confirm(cut(stars.filter(F.col("n") >= FIRST_SHARED).select("u", "v")), docs, width, percent))
    groups = cut(connected_components(links))
    fronts = cut(front_shingles(cut(_open_documents(shared, reps, groups)), docs, width, percent))
    # shingles that several components share, and how many documents have each
    keys = fronts.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b")
    met = cut(fronts.join(by_size(cut(keys.select("key", "n")), BROADCAST_IDS), "key"))
    dense = met.filter(F.col("n") > FEW).select("key", "doc_id", "component", "n_shingles")
    rest = cut(cross_pairs(_in_parts(met.filter(F.col("n") <= FEW).drop("n")), percent).distinct())
    pairs = rest.filter("v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    asked = rest.filter("v is null").select("u", "component")
    more = confirm(cut(pairs), docs, width, percent)
    if asked.limit(1).count():
        more = more.unionByName(confirm_large(asked, groups, docs, width, percent))
    if dense.limit(1).count():
        more = more.unionByName(product(tile_pairs(cut(families(dense))), docs, width, percent))
    more = cut(more)
    if more.limit(1).count():
        groups = cut(connected_components(links.unionByName(more)))

    named = classes.join(groups, F.col("rep") == F.col("node"), "left").select("words_key", F.coalesce("component", "rep").alias("class_id"))
    out = rows.select("doc_id", "n_shingles", "words_key").join(named, "words_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without the near copies: of each class the document with the smallest id, once.

    Where ids repeat, an id and its text together are a document. Rows without an id or without words all stay.
    """
    own = F.col("doc_id").cast("long")
    if not docs.filter(own.isNotNull()).groupBy(own).count().filter("count > 1").limit(1).count():
        gone = link(docs, width, percent).filter(~F.col("kept")).select("doc_id")
        return docs.join(by_size(cut(gone), BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
    rows = docs.select(F.struct("*").alias("_doc"), own.alias("_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_text"))
    # numbers of pairs of id and text, in the order of the ids
    names = rows.filter("_id is not null").select("_id", "_text").distinct().orderBy("_id", "_text")
    names = cut(names.withColumn("doc_id", F.monotonically_increasing_id()))
    rows = rows.join(names, ["_id", "_text"], "left").select("doc_id", F.col("_doc.text").alias("text"), "_doc")
    gone = link(rows, width, percent).filter(~F.col("kept")).select("doc_id").distinct()
    rows = rows.join(by_size(cut(gone), BROADCAST_IDS), "doc_id", "left_anti")
    once = F.col("doc_id").isNotNull() & (F.size(words(F.col("text"))) > 0)
    out = rows.filter(once).dropDuplicates(["doc_id"]).unionByName(rows.filter(~once))
    return out.select(*[F.col("_doc")[n].alias(n) for n in docs.columns])
