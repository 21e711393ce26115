"""Quality rules with thresholds that adapt to each language and source. DataFrame functions only.

Signals are computed inside each row. Their quantiles come from mergeable sketches: a signal's value falls into a bucket of a
fixed grid (steps of 2**-16, and above 2**12 of them a relative width of 2**-11 at most), and a sketch is its buckets' counts.
Sketches merge by adding up counts, so they don't depend on the order of rows, files or tasks, and two runs agree. There is one
for each language and source, merged upward to one for each language and one for all; a group with few rows takes the
thresholds of the next larger one. A fence is the median plus or minus a multiple of the lower half's spread, so up to half of
a group may be junk without moving it far. Fences and documents are then joined and compared.

Defined cases: a null text has no words and fails the base rules; a null language or source is a group of its own; repeated
rows count and are judged each; documents that fail the base rules don't enter the sketches; a group that is as hot as a third
of all rows is pre-aggregated to its buckets in each task; an empty table gives an empty result. Clashing extra columns are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import by_size, cut, store, words

#: A grid step is 2**-STEP_BITS; a bucket keeps the upper MANTISSA bits of a value's number of steps.
STEP_BITS, MANTISSA = 16, 12
#: Groups with fewer rows that pass the base rules take the next larger group's fences.
LEAST_ROWS = 30
#: Groups (of language and source) up to which the table of fences is broadcast, some hundred bytes each.
BROADCAST_GROUPS = 50_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Fence:
    """Keep from median - low * spread to median + high * spread; spread: median less first quartile, ``least`` at least."""

    value: str
    least: float
    high: float
    low: float | None = None


#: By signal; ``least`` is about the noise that a clean group shows.
FENCES = {
    "symbol_share": Fence("n_symbols / greatest(word_chars, 1)", 0.01, 4),
    "repeat_share": Fence("n_repeat_words / greatest(n_words, 1)", 0.06, 6),
    "dup_line_share": Fence("n_dup_lines / greatest(n_words, 1)", 0.01, 6),
    "word_length": Fence("word_chars / greatest(n_words, 1)", 0.3, 6, 6),
}


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base columns and ``base_failed``.

    Repeated windows: each three-word window becomes a number with 33 bits of hash above 31 bits of position. Sorted, windows
    of equal hash are neighbours; only those are compared as words, so the count is exact.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    place = lambda x: x.bitwiseAND((1 << 31) - 1).cast("int")
    window = lambda i: F.struct(F.get("_w", i).alias("a"), F.get("_w", i + 1).alias("b"), F.get("_w", i + 2).alias("c"))
    coded = lambda i: F.shiftleft(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)), 31).bitwiseOR(i.cast("long"))
    same = lambda a, b: F.shiftright(a, 31) == F.shiftright(b, 31)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_w": words(F.col(text)), "_lines": lines})
    out = out.withColumns({"n_words": F.size("_w"), "_s": F.sort_array(F.transform(upto(F.size("_w") - 2), coded))})
    out = out.withColumn("_near", F.filter(upto(F.size("_s") - 1), lambda j: same(F.get("_s", j), F.get("_s", j + 1))))
    at = F.array_distinct(F.flatten(F.transform("_near", lambda j: F.array(place(F.get("_s", j)), place(F.get("_s", j + 1))))))
    out = out.withColumn("_c", F.sort_array(F.transform(at, lambda i: F.struct(window(i).alias("w"), i.alias("i")))))
    twins = F.filter(upto(F.size("_c") - 1), lambda j: F.get("_c", j)["w"] == F.get("_c", j + 1)["w"])
    starts = F.flatten(F.transform(twins, lambda j: F.array(F.get("_c", j)["i"], F.get("_c", j + 1)["i"])))
    covered = F.array_distinct(F.flatten(F.transform(F.array_distinct(starts), lambda i: F.array(i, i + 1, i + 2))))
    out = out.withColumns(
        {
            "n_words": F.col("n_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.char_length(value) - F.char_length(F.regexp_replace(value, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.size(covered).cast("long"),
        }
    )
    out = out.drop("_w", "_lines", "_s", "_near", "_c")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def bucket(value: str) -> str:
    """SQL for the lower end of the bucket that ``value`` (not negative) falls into, in grid steps."""
    steps = f"cast(floor(({value}) * {1 << STEP_BITS}) as bigint)"
    spare = f"greatest(length(bin({steps})) - {MANTISSA}, 0)"
    return f"shiftleft(shiftright({steps}, {spare}), {spare})"


def sketches(rows: DataFrame) -> DataFrame:
    """``level, lang, source, signal, bucket, n``: the sketches of each language and source (level 0), language (1) and all (2)."""
    seen = F.array(*[F.struct(F.lit(n).alias("signal"), F.expr(bucket(f.value)).alias("bucket")) for n, f in FENCES.items()])
    leaf = rows.filter(~F.col("base_failed")).select("lang", "source", F.inline(seen)).groupBy("lang", "source", "signal", "bucket").agg(F.count("*").alias("n"))
    levels = cut(leaf).select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("level"))
    key = lambda c, upto: F.when(F.col("level") <= upto, F.col(c)).alias(c)
    merged = levels.select("level", key("lang", 1), key("source", 0), "signal", "bucket", "n")
    return merged.groupBy("level", "lang", "source", "signal", "bucket").agg(F.sum("n").alias("n"))


def fences(rows: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """A row for each language and source of ``rows`` with bounds ``{signal}_low`` and ``{signal}_high``; small to read."""
    group, signal = ["level", "lang", "source"], Window.partitionBy("level", "lang", "source", "signal")
    # a sketch has at most as many buckets as the grid has between its ends, however many rows it stands for
    counted = sketches(rows).withColumns({"upto": F.sum("n").over(signal.orderBy("bucket")), "all": F.sum("n").over(signal)})
    at = lambda n, part: (F.min(F.when((F.col("signal") == n) & (part * F.col("upto") >= F.col("all")), F.col("bucket"))) / F.lit(float(1 << STEP_BITS)))
    points = counted.groupBy(*group).agg(F.max("all").alias("n"), *[at(n, p).alias(f"{n}_{p}") for n in FENCES for p in (2, 4)])
    bounds = []
    for n, f in FENCES.items():
        median = F.col(f"{n}_2")
        spread = F.greatest(median - F.col(f"{n}_4"), F.lit(f.least))
        bounds.append((median - f.low * spread if f.low is not None else F.lit(None).cast("double")).alias(f"_{n}_low"))
        bounds.append((median + f.high * spread).alias(f"_{n}_high"))
    limits = cut(points.select(*group, "n", *bounds))
    # each group looks itself, its language and the whole up, and takes the first with enough rows
    asked = limits.filter("level = 0").select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.explode(F.array(*map(F.lit, range(3)))).alias("_level"))
    on = (F.col("level") == F.col("_level")) & F.col("lang").eqNullSafe(F.when(F.col("_level") < 2, F.col("_lang"))) & F.col("source").eqNullSafe(F.when(F.col("_level") < 1, F.col("_source")))
    names = [f"_{n}_{side}" for n in FENCES for side in ("low", "high")]
    found = asked.join(limits.filter((F.col("n") >= least_rows) | (F.col("level") == 2)), on)
    return found.groupBy("_lang", "_source").agg(F.min_by(F.struct(*names), "_level").alias("b")).select("_lang", "_source", "b.*")


def judge(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (with signals) and ``kept``: the base rules hold and every signal lies within its group's fences."""
    limits = by_size(cut(limits), BROADCAST_GROUPS)
    kept = ~F.col("base_failed")
    for n, f in FENCES.items():
        value = F.expr(f.value).cast("double")
        kept &= F.coalesce(value <= F.col(f"_{n}_high"), F.lit(True)) & F.coalesce(value >= F.col(f"_{n}_low"), F.lit(True))
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.withColumn("kept", kept).drop(*limits.columns)


def assess(docs: DataFrame) -> DataFrame:
    """The contract's columns, a row for each document."""
    rows = cut(signals(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return judge(rows, fences(rows)).select("doc_id", *BASE, "base_failed", "kept", "lang", "source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Documents are written once beside their signals; the sketches then read the signals' columns alone.
    """
    rows = store(signals(docs.select(F.struct("*").alias("_doc"), "lang", "source", "text")).drop("text"))
    judged = judge(rows, fences(rows.drop("_doc")))
    return judged.filter("kept").select(*[F.col("_doc")[n].alias(n) for n in docs.columns])
