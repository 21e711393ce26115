"""A trie of conversation prefixes, its subtree totals by parallel tree contraction.

Each conversation is put together from its thread's opening turns and its own, then every turn gets the name of the prefix that
ends with it: the sum, along the conversation, of a digest of each turn and its place. Sums run over ranges of turns, so a
conversation of any length is nobody's single task. Equal names at equal depths are one node, called by its smallest member and
its depth; a node's parent is the sum without the last turn.

Totals of subtrees are found by contraction. In each round all leaves are raked: their totals are final and are added to their
parents. Then unary chains are compressed: a node with one child is taken out, its child goes to its parent and holds what the
node has so far for it, and the node's total is noted as that plus its child's. Which nodes of a chain go is told by a bit of their depths, one round the lowest,
then the next, so no two neighbours go at once and a chain halves. At the end the noted nodes are expanded again: each looks up its
child's total or, if that is noted as well, takes over what the child points at, so they all resolve in a few doublings. Rounds
grow with the logarithm of the number of nodes; a node with very many children is summed up before it is shuffled.

The ids of conversations that end at a node are joined in runs within ranges of ids, then digested run by run, never held as one.

Defined cases: null roles and texts are empty; null turns come first, ties by role and text (null as empty); repeated rows are
turns of their own; rows without a conversation id take no part; a conversation without turns of its own that remain is a member of
the nodes of its thread's opening; for negative ids the rest of the division has the id's sign; an empty table gives no node, not
even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut

THREAD, OPENINGS = 5, 9
#: Bits of depths that choose what a chain loses, one in each round; depths beyond 2**40 don't occur.
BITS = 40
#: Ids in a run.
RUN = 4096
NODE = ("conv_id", "depth")


def along(df: DataFrame, group: str, order: list, value, name: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``name``, the sum of ``value`` over the group's rows up to this one, by ranges of groups and rows."""
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie")
    at = F.monotonically_increasing_id()
    rows = cut(rows.select(*keep, value.alias("_value"), F.spark_partition_id().alias("_part"), at.alias("_at")))
    parts = rows.groupBy(group, "_part").agg(F.sum("_value").alias("_sum"), F.max("_part").alias("_last"))
    over = Window.partitionBy(group)
    before = F.sum("_sum").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # only groups that go on in another range have anything to carry, two rows a range at most
    carried = parts.withColumns({"_carry": before, "_parts": F.count("*").over(over)}).filter("_parts > 1 and _carry is not null")
    own = F.sum("_value").over(Window.partitionBy("_part", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(F.broadcast(carried.select(group, "_part", "_carry")), [group, "_part"], "left").withColumn("_own", own)
    return out.select(*keep, F.expr("_own + coalesce(_carry, 0)").cast(dict(rows.dtypes)["_value"]).alias(name))


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, turn_key, n_bytes`` of all rebuilt turns, and ``conv_id, length`` of all rebuilt conversations."""
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.filter("conv_id is not null").withColumn("n_bytes", F.octet_length("text").cast("long"))
    # the role's length keeps (role, text) apart
    clean = clean.withColumn("turn_key", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    keep = ["conv_id", "turn_key", "n_bytes"]
    placed = cut(along(clean, "conv_id", [F.asc_nulls_first("turn"), "role", "text"], F.lit(1).cast("long"), "place", keep))
    opening = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS).alias("h")
    convs = placed.groupBy("conv_id").agg(F.max("place").alias("turns")).select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % THREAD).alias("thread"), opening)
    lengths = convs.select(F.col("conv_id").alias("thread"), F.col("turns").alias("given"))
    convs = convs.join(lengths, "thread", "left").withColumn("opens", F.least(F.coalesce("given", F.lit(0)), "h"))
    convs = cut(convs.select("conv_id", "thread", "h", "opens", (F.col("opens") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("length")))
    first = placed.filter(F.col("place") < OPENINGS).select(F.col("conv_id").alias("thread"), F.col("place").alias("depth"), "turn_key", "n_bytes")
    first = convs.join(first, "thread").filter("depth <= opens").select("conv_id", "depth", "turn_key", "n_bytes")
    rest = placed.join(convs, "conv_id").filter("place > h").select("conv_id", F.expr("place - h + opens").alias("depth"), "turn_key", "n_bytes")
    return first.unionByName(rest), convs.select("conv_id", "length")


def prefix_nodes(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes (``conv_id, depth, parent_conv_id, n_convs, n_bytes``), and ``conv_id, depth, member`` of those that end there."""
    digest = F.sha2(F.concat_ws(":", "depth", "turn_key"), 256)
    number = lambda a, n: F.conv(F.substring("digest", a, n), 16, 10).cast("decimal(38,0)")
    # 92 bits, so that sums of thousands of millions of turns are exact
    value = (number(1, 11) * F.lit(1 << 48).cast("decimal(16,0)") + number(12, 12)).cast("decimal(38,0)")
    rows = rows.withColumn("digest", digest).withColumn("step", value)
    named = cut(along(rows.select("conv_id", "depth", "n_bytes", "step"), "conv_id", ["depth"], F.col("step"), "prefix", ["conv_id", "depth", "n_bytes", "step"]))
    nodes = named.groupBy("depth", "prefix").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("n_bytes").alias("n_bytes"), F.first("step").alias("step"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("decimal(38,0)").alias("prefix"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("decimal(38,0)").alias("step"))
    nodes = cut(nodes.unionByName(root))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.withColumn("above", (F.col("prefix") - F.col("step")).cast("decimal(38,0)")).join(above, ["depth", "above"], "left")
    last = convs.filter("length > 0").join(named.select("conv_id", F.col("depth").alias("length"), "prefix"), ["conv_id", "length"]).select(F.col("conv_id").alias("member"), F.col("length").alias("depth"), "prefix")
    last = last.unionByName(convs.filter("length = 0").select(F.col("conv_id").alias("member"), F.col("length").alias("depth"), F.lit(0).cast("decimal(38,0)").alias("prefix")))
    ends = last.join(nodes.select("depth", "prefix", "conv_id"), ["depth", "prefix"]).select("conv_id", "depth", "member")
    return cut(tree.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_bytes")), ends


def digests(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256``: the digest of each node's members in ascending order, comma-joined."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order; a run ends with its node, with the partition, or after RUN ids."""
        node, ids, out = None, [], []

        def close():
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids))))
                ids.clear()

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "first", "run"])
            out.clear()
            return batch

        for batch in batches:
            for c, d, m in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (c, d) != node or len(ids) == RUN:
                    close()
                    node = (c, d)
                ids.append(m)
            if len(out) >= 1024:
                yield flush()
        close()
        yield flush()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for c, d, run in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (c, d) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (c, d), hashlib.sha256(run.encode())
                else:
                    state.update(b"," + run.encode())
        if node:
            out.append((*node, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 3, (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends_sha256"])

    rows = ends.select(*NODE, "member").repartitionByRange(*NODE, "member").sortWithinPartitions(*NODE, "member")
    rows = rows.mapInArrow(runs, "conv_id long, depth long, first long, run string")
    return rows.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``conv_id, depth`` and, in ``values``, the sums over each node's subtree, itself included, by rake and compress.

    ``nodes`` has ``conv_id, depth, parent_conv_id`` (the parent is one less deep; null for the root) and ``values`` (long).
    """
    up = ["up_conv", "up_depth"]
    # what the nodes hold that went from between a node and its present parent
    held = [f"held_{v}" for v in values]
    zero = F.lit(0).cast("long")
    start = nodes.select(*NODE, F.col("parent_conv_id").alias("up_conv"), (F.col("depth") - 1).alias("up_depth"), *values, *[zero.alias(h) for h in held])
    live, done, noted, turn = cut(start), [], [], 0
    to_up = lambda df: df.select(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth"), *[c for c in df.columns if c not in up])
    while live.limit(1).count():
        # rake: nodes that are nobody's parent
        below = to_up(live.filter("up_conv is not null").groupBy(*up).agg(F.count("*").alias("kids")))
        marked = cut(live.join(below, list(NODE), "left"))
        leaves = marked.filter("kids is null")
        done.append(leaves.select(*NODE, *values))
        sums = [F.sum(F.col(v) + F.col(h)).alias(f"_{v}") for v, h in zip(values, held)]
        raked = to_up(leaves.filter("up_conv is not null").groupBy(*up).agg(F.count("*").alias("_gone"), *sums))
        rest = marked.filter("kids is not null").join(raked, list(NODE), "left")
        more = [(F.col(v) + F.coalesce(f"_{v}", zero)).alias(v) for v in values]
        rest = rest.select(*NODE, *up, (F.col("kids") - F.coalesce("_gone", zero)).alias("kids"), *more, *held)
        # compress: nodes with one child, whose bit is set and whose parent's isn't, go out of their chain
        bit = lambda c: F.expr(f"shiftright({c}, {turn % BITS}) & 1")  # noqa: E731, B023
        goes = (F.col("kids") == 1) & F.col("up_conv").isNotNull() & (bit("depth") == 1) & (bit("up_depth") == 0)
        rest = cut(rest.withColumn("goes", goes))
        gone = [F.col(v).alias(f"_{v}") for v in values] + [F.col(h).alias(f"_{h}") for h in held]
        out = rest.filter("goes").select(F.col("conv_id").alias("up_conv"), F.col("depth").alias("up_depth"), F.col("up_conv").alias("new_conv"), F.col("up_depth").alias("new_depth"), *gone)
        # only its one child points at a node that goes; the child holds it from now on, and the node's total is found from the child's
        rest = rest.join(out, up, "left")
        own = [(F.col(f"_{v}") + F.col(h)).alias(v) for v, h in zip(values, held)]
        child = [F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth"), F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth")]
        noted.append(rest.filter("new_conv is not null").select(*child, *own))
        held_now = [(F.col(h) + F.coalesce(f"_{v}", zero) + F.coalesce(f"_{h}", zero)).alias(h) for v, h in zip(values, held)]
        live = rest.filter("not goes").select(*NODE, F.coalesce("new_conv", "up_conv").alias("up_conv"), F.coalesce("new_depth", "up_depth").alias("up_depth"), *values, *held_now)
        live = cut(live)
        turn += 1
    return _expanded(done, noted, nodes, values)


def _expanded(done: list[DataFrame], noted: list[DataFrame], nodes: DataFrame, values: list[str]) -> DataFrame:
    """Totals of raked nodes, and of the nodes taken out of chains: their own sums plus the totals of what they point at."""
    if not done:
        return nodes.select(*NODE, *values)
    total, wait = done[0], noted[0]
    for more in done[1:]:
        total = total.unionByName(more)
    for more in noted[1:]:
        wait = wait.unionByName(more)
    total, wait = cut(total), cut(wait)
    add = lambda: [(F.col(v) + F.col(f"_{v}")).alias(v) for v in values]
    to = ["to_conv", "to_depth"]
    while wait.limit(1).count():
        ends = total.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), *[F.col(v).alias(f"_{v}") for v in values])
        found = wait.join(ends, to).select(*NODE, *add())
        left = wait.join(ends.select(*to), to, "left_anti")
        hop = wait.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), F.col("to_conv").alias("next_conv"), F.col("to_depth").alias("next_depth"), *[F.col(v).alias(f"_{v}") for v in values])
        total = total.unionByName(cut(found))
        wait = cut(left.join(hop, to).select(*NODE, F.col("next_conv").alias("to_conv"), F.col("next_depth").alias("to_depth"), *add()))
    return total


def conversation_trie(turns: DataFrame) -> DataFrame:
    """A row for each node: its members, children, leaves, the tokens (bytes) that sharing saves, and a digest of what ends there."""
    nodes, ends = prefix_nodes(*rebuild(turns))
    below = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(below, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    start = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")})
    totals = subtree_totals(start, ["n_leaves", "saved_tokens"])
    out = nodes.join(totals, list(NODE)).join(digests(ends), list(NODE), "left")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(*names, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
