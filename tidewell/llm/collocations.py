"""Phrase collocations by mergeable Misra-Gries summaries and an exact second pass.

Texts are lower-cased (A-Z) and cut into pieces at punctuation and line ends, pieces into words. Every n-gram of up to
``longest`` words is hashed with its language; the hash's upper bits name one of as many hash partitions as the mass asks for, the
lower 32 bits its cell there. Tasks count the cells of a block of text and send each partition its counts; a partition merges
them into one Misra-Gries summary whose capacity exceeds its mass divided by the threshold. So a summary is short by less than
the threshold, and each n-gram that is frequent survives, whatever else there is. A partition that is heavier than the others
keeps more cells instead of erring by the threshold.

Survivors are marked in a bit map of fixed size (32 MB), the only thing that is broadcast. The second pass counts the marked
n-grams by their words, not by hashes, first within a block of text, then by language and phrase. What the map marks by chance is
counted as well and goes with the infrequent. Where the map is full, more is shuffled, and the counts are the same.

Scores, the best cut and the phrases inside longer ones come from the table of frequent phrases by joins and aggregates.

Defined cases: a null text is empty; a null language is ``und`` (as if it were written so); texts without words give nothing;
repeated rows count again; texts have no length limit (a block ends at the next piece's end after its size is met); ties go by
occurrences, then by phrase in UTF-8 byte order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, map_texts

#: Bytes of text that are taken as one block, and words whose hashes a worker keeps.
BLOCK, KEEP = 6 << 20, 300_000
#: Mass of a hash partition, in n-grams; smaller tables have as many partitions as the session shuffles to.
MASS = 1 << 26
#: Cells that wait before they are merged into a summary, at least.
WAITING = 1 << 20
#: Slots of the bit map, and of one part of it.
SLOTS, SLICE = 1 << 28, 1 << 20
#: Groups of equal size that a language's phrases are ranked in first.
SALTS = 16
END = b"\xff"  # stands for a piece's end; no UTF-8 text holds it
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"


def _table() -> bytes:
    to = bytearray(range(256))
    to[65:91] = range(97, 123)
    to[9] = 32
    for b in b".,;:!?\x0a\x0b\x0c\x0d":
        to[b] = END[0]
    return bytes(to)


TO = _table()


class Words(dict):
    """Numbers for words, from 1 on; 0 is a piece's end. ``hashes`` holds their hashes."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.clear()
        self[END] = 0
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """``lang, words``: the words of some rows' texts of one language, with END between pieces and around texts."""
    waiting, size = {}, 0

    def flush():
        for lang, texts in waiting.items():
            data, at = b"".join(texts), 0
            while at < len(data):
                end = len(data) if len(data) - at <= 2 * BLOCK else data.find(END, at + BLOCK) + 1 or len(data)
                yield lang, data[at:end].replace(END, b" \xff ").split()
                at = end
        waiting.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(TO)
            waiting.setdefault(lang, []).append(text + END)
            size += len(text)
            if size >= BLOCK:
                yield from flush()
                size = 0
    yield from flush()


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Spread bits; ``seed`` keeps languages apart."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def longer(g: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams that go on by a word."""
    g = g * np.uint64(0x9E3779B97F4A7C15) ^ word
    return g ^ (g >> np.uint64(29))


def block_cells(ids: np.ndarray, hashes: np.ndarray, lang: str, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a block's n-grams of 1 to ``longest`` words within pieces, and how often each occurs."""
    seed, word, out = xxhash.xxh64_intdigest(lang), hashes[ids], []
    at, g = np.flatnonzero(ids), None
    for n in range(longest):
        if n:
            inside = at + n < len(ids)
            at, g = at[inside], g[inside]
            inside = ids[at + n] != 0
            at, g = at[inside], g[inside]
            g = longer(g, word[at + n])
        else:
            g = word[at]
        out.append(mixed(g, seed))
    return np.unique(np.concatenate(out), return_counts=True)


class Summary:
    """A Misra-Gries summary of cells: a count is short by at most ``error``, which stays below ``least``."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least, self.error = capacity, least, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.waiting, self.n = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n += len(keys)
        if self.n >= max(WAITING, self.capacity):
            self.merge()

    def merge(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip((self.keys, self.counts), *self.waiting))
        self.waiting, self.n = [], 0
        if counts.size and counts.max() < 1 << 32:  # sorted as one number each, which is fast
            both = np.sort(keys.astype(np.uint64) << np.uint64(32) | counts.astype(np.uint64))
            keys, counts = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        else:
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.empty(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if first.size else counts
        if len(keys) > self.capacity:
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            off = min(off, self.least - 1 - self.error)
            self.error += off
            keys, counts = keys[counts > off], counts[counts > off] - off
        self.keys, self.counts = keys, counts

    def survivors(self) -> np.ndarray:
        """Cells that may have occurred ``least`` times."""
        self.merge()
        return self.keys[self.counts + self.error >= self.least]


def survivor_map(texts: DataFrame, mass: int, least: int, longest: int) -> np.ndarray:
    """The bit map of the cells that may hold an n-gram with ``least`` occurrences. ``mass`` is at least the number of n-grams."""
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mass // MASS))
    capacity = mass // (least * parts) * 5 // 4 + 1024  # partitions differ a little in mass

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for lang, tokens in blocks(batches):
            ids = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
            cells, counts = block_cells(ids, np.array(words.hashes, np.uint64), lang, longest)
            part = ((cells >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            found, first = np.unique(part, return_index=True)
            ends = np.append(first[1:], len(part))
            low, counts = cells.astype(np.uint32), counts.astype(np.uint32)
            cut_up = lambda x: [x[a:b].tobytes() for a, b in zip(first, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(cut_up(low), pa.binary()), pa.array(cut_up(counts), pa.binary())], names=["part", "cells", "counts"])
            if len(words) > KEEP:
                words.reset()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries: dict[int, Summary] = {}
        for batch in batches:
            for part, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                summary = summaries.setdefault(part, Summary(capacity, least))
                summary.add(np.frombuffer(cells.as_buffer(), np.uint32), np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64))
        for summary in summaries.values():
            slots = np.unique(summary.survivors() & np.uint32(SLOTS - 1))
            found, first = np.unique(slots // SLICE, return_index=True)
            own = [(slots[a:b] % SLICE).astype(np.uint32).tobytes() for a, b in zip(first, np.append(first[1:], len(slots)))]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(own, pa.binary())], names=["slice", "slots"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, name = np.zeros(SLICE, bool), None
        for batch in batches:
            for k, slots in zip(batch.column(0), batch.column(1)):
                name = k.as_py()
                bits[np.frombuffer(slots.as_buffer(), np.uint32)] = True
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    counted = map_texts(texts, count, "part int, cells binary, counts binary").repartitionById(parts, "part")
    slices = counted.mapInArrow(merge, "slice int, slots binary").groupBy("slice").applyInArrow(mark, "slice int, bits binary")
    out = np.zeros(SLOTS // 8, np.uint8)
    for row in slices.toLocalIterator():  # no more than SLOTS / SLICE rows of SLICE / 8 bytes
        out[row["slice"] * SLICE // 8 : (row["slice"] + 1) * SLICE // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def phrase_counts(ids: np.ndarray, tokens: list[bytes], hashes: np.ndarray, lang: str, bits: np.ndarray, longest: int) -> Iterator[tuple[str, int, int]]:
    """``phrase, words, occurrences`` of a block's marked n-grams. An n-gram counts as marked only if its beginnings are."""
    seed, word = xxhash.xxh64_intdigest(lang), hashes[ids]
    at, g, name = np.flatnonzero(ids), None, None
    for n in range(longest):
        if n:
            inside = at + n < len(ids)
            inside[inside] = ids[at[inside] + n] != 0
            at, g, name = at[inside], g[inside], name[inside]
            g, name = longer(g, word[at + n]), name << np.int64(32) | ids[at + n]
        else:
            g, name = word[at], ids[at]
        slot = (mixed(g, seed) & np.uint64(SLOTS - 1)).astype(np.int64)
        on = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
        at, g, name = at[on], g[on], name[on]
        if not at.size:
            return
        _, first, name, counts = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
        for i, c in zip(at[first].tolist(), counts.tolist()):
            yield b" ".join(tokens[i : i + n + 1]).decode("utf-8", "surrogatepass"), n + 1, c


def frequent_phrases(texts: DataFrame, bits: np.ndarray, least: int, longest: int) -> DataFrame:
    """``lang, phrase, words, a``: the phrases with ``least`` occurrences or more, counted exactly."""
    spread = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, marked = Words(), spread.value
        for lang, tokens in blocks(batches):
            ids = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
            rows = list(zip(*phrase_counts(ids, tokens, np.array(words.hashes, np.uint64), lang, marked, longest))) or [[]] * 3
            langs = pa.array([lang] * len(rows[0]), pa.string())
            yield pa.RecordBatch.from_arrays([langs, pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64())], names=["lang", "phrase", "words", "a"])
            if len(words) > KEEP:
                words.reset()

    counted = map_texts(texts, count, "lang string, phrase string, words int, a long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def _inside(frequent: DataFrame) -> DataFrame:
    """``lang, phrase, most``: for each phrase within longer frequent ones the most occurrences of one of these."""
    w = F.split("phrase", " ")
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    rows = frequent.filter("words > 2").withColumn("w", w).select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase"))
    return rows.groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def score_phrases(frequent: DataFrame, contained: int) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the candidates that no longer one stands for. ``frequent`` is stored."""
    w = F.split("phrase", " ")
    cuts = frequent.filter("words > 1").withColumn("w", w).select("lang", "phrase", "words", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("tail"))
    head = frequent.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tail = frequent.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    cuts = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).withColumn("score", score.cast("long"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("b"))
    out = best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.score").join(_inside(frequent), ["lang", "phrase"], "left")
    return out.filter(~F.coalesce(100 * F.col("most") >= contained * F.col("a"), F.lit(False))).drop("most")


def mine(docs: DataFrame, least: int = 30, longest: int = 4, contained: int = 80, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    totals = cut(texts.groupBy("lang").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))).cast("long").alias("n")))
    mass = longest * (totals.agg(F.sum("n")).first()[0] or 0)
    bits = survivor_map(texts, mass, least, longest)
    scored = score_phrases(cut(frequent_phrases(texts, bits, least, longest)), contained)
    # a language's phrases are ranked in groups first, so no task gets all of them
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    scored = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    numbers = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *numbers)
