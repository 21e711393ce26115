"""Temperature mixing of sources to a target, realised as budgeted block permutations. DataFrame functions only.

A source's share of all tokens, raised to an exponent and normalised, is its weight; 1 keeps the shares, 0 makes sources
equal, more than 1 sharpens them. The exponent is the smallest (most even) one at which the weights' entropy is at most the target
and no source is repeated more often than the limit; both fall as it grows, so it is bisected, four bits of it in each pass over
the table of sources. The target is a part of the largest entropy or, by default, lies halfway from the present entropy to the
largest, so unequal shares always move; a target below the present entropy is looked for above 1, in a range that doubles until it
is met. Without a given budget each document is copied once at least. A source's budget is its weight's part of the whole budget. Each source is dealt into blocks; blocks in the order of
their keys, documents within in the order of theirs, are a permutation of the source. Every pass over the budget that covers
the source gives each document a copy; the rest of the budget gives one more to the blocks at the front and to the front of
the block at the border. So a decision needs a few numbers for each source and no sorted source; texts are
shuffled only where the permutation itself is asked for.

Defined cases: a null source is a source of its own; null texts have no tokens; sources without tokens have weight 0 and no
copies; repeated rows (equal ids) are counted each and decided alike; extra columns with clashing names don't matter; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import by_size, cut, words

#: Documents in a block (about) and sources up to which their table is broadcast, some hundred bytes each.
BLOCK_ROWS = 20_000
BROADCAST_SOURCES = 50_000
#: Digits of a key that make a slot; 16 to their power slots for each source.
SLOT_DIGITS = 2
#: How far from the present entropy to the largest the default target lies.
LIFT = 0.5
MOST_REPEATS = 4.0
ROUNDS, BITS, MOST_EXPONENT = 8, 4, 64.0


def n_words(text: str = "text") -> Column:
    return F.size(words(F.col(text))).cast("long")


def bisect_exponent(sources: DataFrame, evenness: float | None, most_repeats: float, budget: float | None) -> tuple[float, float, float]:
    """Exponent, sum of powered shares, and the budget in tokens. ``sources`` has ``tokens``; one aggregated row a round."""
    live = sources.filter("tokens > 0")
    got = live.agg(F.sum("tokens"), F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not got[1]:
        return 1.0, 1.0, 0.0
    total, n, least, most = float(got[0]), got[1], got[2] / float(got[0]), got[3] / float(got[0])
    log_share = F.log(F.col("tokens") / F.lit(total))

    def measure(exponents: list[float]) -> list[tuple[float, float, float]]:
        """For each exponent the sum of powers, the entropy and the most repetitions."""
        power = [F.exp(F.lit(t) * log_share) for t in exponents]
        row = live.agg(*[c for p in power for c in (F.sum(p), F.sum(p * log_share))]).first()
        out = []
        for k, t in enumerate(exponents):
            z, weighted = row[2 * k], row[2 * k + 1]
            entropy = math.log(z) - t * weighted / z
            repeats = (most / least) ** abs(1 - t) if budget is None else least ** (t - 1) / z * budget / total
            out.append((z, entropy, repeats))
        return out

    z, present, _ = measure([1.0])[0]
    target = present + LIFT * (math.log(n) - present) if evenness is None else evenness * math.log(n)
    fits = lambda m: m[1] <= target + 1e-12 and m[2] <= most_repeats + 1e-12
    low, high, even = 0.0, 1.0, measure([0.0])[0]
    if fits(even):
        high, z = 0.0, even[0]
    else:
        while high < MOST_EXPONENT and not measure([high])[0][1] <= target + 1e-12:
            low, high = high, 2 * high
        z = measure([high])[0][0]
        for _ in range(ROUNDS):
            step = (high - low) / (1 << BITS)
            inner = [low + step * k for k in range(1, 1 << BITS)]
            found = next(((t, m[0]) for t, m in zip(inner, measure(inner)) if fits(m)), None)
            if found:
                high, z = found
                low = high - step
            else:
                low = high - step
    # without a given budget the source that weighs least against its share is used exactly once, so no document is lost
    return high, z, budget if budget is not None else total * max(most ** (1 - high), least ** (1 - high)) * z


def plan(sized: DataFrame, evenness: float | None = None, most_repeats: float = MOST_REPEATS, budget: float | None = None, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each source: weight, budget, block count, whole passes, and the keys up to which one more copy is given.

    ``sized`` has ``doc_id, source, n_tokens`` and is read three times.
    """
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    sources = cut(totals)
    exponent, z, whole = bisect_exponent(sources, evenness, most_repeats, budget)
    total = sources.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(total))) / F.lit(z)).otherwise(0.0)
    tokens = F.round(weight * F.lit(whole)).cast("long")
    if budget is None:
        tokens = F.greatest(tokens, "tokens")
    sources = sources.select("source", "tokens", weight.alias("weight"), tokens.alias("budget"), F.ceil(F.col("rows") / block_rows).cast("long").alias("blocks"))
    sources = sources.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
    sources = cut(sources)
    dealt = deal(sized, sources, seed)
    blocks = dealt.groupBy("source", "block_key").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    border = first_beyond(blocks.withColumnRenamed("rest", "room"), "block_key").withColumnsRenamed({"key": "border_key", "source": "_s"})
    # one block of each source; rows of one id, or without, are one
    on = F.col("source").eqNullSafe(F.col("_s"))
    inside = dealt.join(by_size(border, BROADCAST_SOURCES), on & (F.col("block_key") == F.col("border_key")))
    inside = inside.groupBy("source", "doc_key").agg(F.sum("n_tokens").alias("n"), F.first("room").alias("room"))
    stop = first_beyond(inside, "doc_key").select(F.col("source").alias("_s"), F.col("key").alias("stop_key"))
    out = sources.join(border.drop("room"), on, "left").drop("_s")
    return out.join(stop, on, "left").drop("_s")


def first_beyond(items: DataFrame, key: str) -> DataFrame:
    """For each source the first ``key`` up to which ``n`` adds up to more than ``room``, and the room left before it.

    Keys are hexadecimal digests. Sums by their first digits find the slot first, so that a task ranks a source's slots and then
    one slot's keys (1 in 256), whatever part of the rows the source has.
    """
    slotted = cut(items.withColumn("slot", F.substring(key, 1, SLOT_DIGITS)))
    slots = slotted.groupBy("source", "slot").agg(F.sum("n").alias("n"), F.first("room").alias("room"))
    found = cut(_crossing(slots, "slot").withColumnsRenamed({"source": "_s", "key": "_slot", "room": "_left"}))
    within = slotted.join(by_size(found, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_s")) & (F.col("slot") == F.col("_slot")))
    return cut(_crossing(within.select("source", key, "n", F.col("_left").alias("room")), key))


def _crossing(items: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    behind = items.withColumn("end", F.sum("n").over(order)).filter("end > room")
    first = behind.groupBy("source").agg(F.min_by(F.struct(F.col(key).alias("key"), (F.col("room") - F.col("end") + F.col("n")).alias("room")), key).alias("b"))
    return first.select("source", "b.key", "b.room")


def deal(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``rows`` with the columns of their source, their block and the keys that order blocks and documents."""
    small = by_size(sources.withColumnRenamed("source", "_s"), BROADCAST_SOURCES)
    name, doc = F.coalesce("source", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    out = rows.join(small, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    out = out.withColumn("doc_key", F.md5(F.concat_ws(":", F.lit(seed), doc)))
    out = out.withColumn("block", F.conv(F.substring("doc_key", 25, 8), 16, 10).cast("long") % F.greatest("blocks", F.lit(1)))
    return out.withColumn("block_key", F.md5(F.concat_ws(":", F.lit(seed), name, F.col("block"))))


def copies() -> Column:
    ahead = F.col("border_key").isNull() | (F.col("block_key") < F.col("border_key"))
    ahead |= (F.col("block_key") == F.col("border_key")) & (F.col("doc_key") < F.col("stop_key"))
    return F.col("passes") + F.when((F.col("rest") > 0) & F.coalesce(ahead, F.lit(False)), 1).otherwise(0)


def mix(docs: DataFrame, evenness: float | None = None, most_repeats: float = MOST_REPEATS, budget: float | None = None, seed: int = 42) -> DataFrame:
    """A row for each document: source, tokens, the source's weight, the document's copies, and keys that order each pass."""
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words().alias("n_tokens")))
    dealt = deal(sized, cut(plan(sized, evenness, most_repeats, budget, seed)), seed)
    return dealt.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), copies().alias("copies"), "block", "block_key", "doc_key")


def realise(docs: DataFrame, evenness: float | None = None, most_repeats: float = MOST_REPEATS, budget: float | None = None, seed: int = 42, number: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its copies, with their columns, in the order of the permutation.

    All of the first pass come first; within a pass, blocks of all sources follow each other by their keys, and documents within
    a block by theirs. ``number`` names a further column with the pass, from 1.
    """
    names = docs.columns
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words().alias("n_tokens")))
    given = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("doc_id"), "source")
    dealt = deal(given, cut(plan(sized, evenness, most_repeats, budget, seed)), seed)
    repeated = dealt.withColumn("_copies", copies()).filter("_copies > 0").select("_doc", "block_key", "doc_key", F.explode(F.expr("sequence(1L, _copies)")).alias("_pass"))
    order = ["_pass", "block_key", "doc_key"]
    # equal rows of one id are told apart by chance, so that many of them are spread as well
    placed = repeated.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(*order, "_any").sortWithinPartitions(*order)
    return placed.select(*[F.col("_doc")[n].alias(n) for n in names], *([F.col("_pass").alias(number)] if number else []))
