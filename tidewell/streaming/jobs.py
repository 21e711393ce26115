"""Structured Streaming jobs: ingestion with validation, event-time windows, cooldown state and latest risk."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators import quality
from tidewell.sources import registry

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def kafka_stream(spark: SparkSession, servers: str, topics: list[str], per_trigger: int = 1_000_000) -> DataFrame:
    """Topic messages as ``topic, key, timestamp, value``; needs Spark's Kafka package on the cluster."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger)}
    return spark.readStream.format("kafka").options(**options).load().select("topic", F.col("key").cast("string"), "timestamp", F.col("value").cast("string"))


def parse_messages(stream: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """The message's fields beside ``malformed``: null, or no JSON of that schema."""
    parsed = stream.withColumn("_m", F.from_json(value, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    malformed = F.col("_m").isNull() | F.col("_m._broken").isNotNull()
    return parsed.select(*stream.columns, "_m.*", malformed.alias("malformed")).drop("_broken")


def ingest(stream: DataFrame, good_path: str, rejected_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Valid rows to one table, rejected rows with reasons to another. A batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        quality.valid_rows(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        quality.quarantined(batch).write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def once_each(stream: DataFrame, keys: list[str], time: str, late: str = "2 hours") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def hourly(stream: DataFrame, time: str, keys: list[str], value: str, late: str = "2 hours") -> DataFrame:
    """Tumbling hourly counts, means and extremes; partial aggregates combine before the shuffle."""
    w = F.window(time, "1 hour")
    out = stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("window.start").alias("hour"), *keys, "n", "mean", "low", "high")


def stays(stream: DataFrame, time: str, key: str, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Session windows: a stay ends when nothing comes for ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def cool_down(alerts: DataFrame, scope: list[str], seconds: str = "cooldown", time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Alerts that pass their scope's cooldown; the state is the last passed time. ``scope`` may add the entity to the rule.

    Alerts later than the watermark are dropped, and a scope's state goes when the watermark has passed its cooldown's end.
    Rows of one batch are taken in time order; a late row of a later batch meets the state as it is then.
    """
    fields = dict(alerts.dtypes)
    schema = ", ".join([f"{c} {fields[c]}" for c in scope] + [f"{time} {fields[time]}"])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, free = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(parts)).sort_values(time)
        kept = []
        for at, wait in zip(rows[time], rows[seconds]):
            if last is None or at.timestamp() - last >= wait:
                last, free = at.timestamp(), at.timestamp() + wait
                kept.append(at)
        state.update((last, free))
        state.setTimeoutTimestamp(max(int(free * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({c: [k] * len(kept) for c, k in zip(scope, key)} | {time: kept})

    timed = alerts.withWatermark(time, late)
    return timed.groupBy(*scope).applyInPandasWithState(step, schema, "last double, free double", "append", GroupStateTimeout.EventTimeTimeout)


def expiring(stream: DataFrame, time: str, late: str) -> DataFrame:
    """A stream for processors with state: watermarked, its state in RocksDB, so values are read and written one by one.

    The session's store is set here if it isn't RocksDB; queries that run, and their checkpoints, keep theirs.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.withWatermark(time, late)


class Expiring(StatefulProcessor):
    """Base of processors whose keys leave the state when the watermark has passed their last row by ``idle`` seconds."""

    def __init__(self, time: str, value: str, idle: float):
        self.time, self.value, self.idle = time, value, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def sorted_rows(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(rows)).sort_values(self.time, kind="stable")

    def keep_until(self, rows: pd.DataFrame) -> None:
        """Moves the key's timer behind its newest row."""
        ms = int(rows[self.time].iloc[-1].timestamp() * 1000 + self.idle * 1000)
        before = self.until.get()[0] if self.until.exists() else None
        if before is None or ms > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ms)
            self.until.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        self.forget()
        return iter(())

    def forget(self) -> None: ...

    def close(self) -> None: ...


class Previous(Expiring):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = self.sorted_rows(rows)
        before = self.last.get()[0] if self.last.exists() else None
        values = rows[self.value].tolist()
        self.last.update((float(values[-1]),))
        self.keep_until(rows)
        yield rows.assign(previous=pd.array([before, *values[:-1]], dtype="Float64"))

    def forget(self) -> None:
        self.last.clear()


class Recent(Expiring):
    """A ring of the newest ``most`` values: a batch writes the slots of its own values, whatever the ring holds."""

    def __init__(self, time: str, value: str, idle: float, most: int, key: str):
        super().__init__(time, value, idle)
        self.most, self.key = most, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getValueState("seen", "rows long")
        self.ring = handle.getMapState("ring", "slot long", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = self.sorted_rows(rows)
        seen = self.seen.get()[0] if self.seen.exists() else 0
        values = rows[self.value].tolist()
        for k, v in list(enumerate(values, seen))[-self.most :]:
            self.ring.updateValue((k % self.most,), (float(v),))
        self.seen.update((seen + len(values),))
        self.keep_until(rows)
        kept = [v[0] for v in self.ring.values()]
        yield pd.DataFrame({self.key: [key[0]], "n": [len(kept)], "mean": [math.fsum(kept) / len(kept)]})

    def forget(self) -> None:
        self.seen.clear()
        self.ring.clear()


def with_previous(stream: DataFrame, key: str, time: str, value: str, late: str = "2 hours", idle: float = 30 * 86_400) -> DataFrame:
    """``key, time, value, previous``: each value beside the entity's one before; the state is one number for each entity.

    An entity that is silent for ``idle`` seconds of event time leaves the state; its next value has no previous one.
    """
    kind = dict(stream.dtypes)
    rows = stream.select(key, time, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    schema = f"{key} {kind[key]}, {time} {kind[time]}, {value} double, previous double"
    return expiring(rows, time, late).groupBy(key).transformWithStateInPandas(Previous(time, value, idle), schema, "Append", "EventTime")


def recent_buffer(stream: DataFrame, key: str, time: str, value: str, most: int = 5000, late: str = "2 hours", idle: float = 30 * 86_400) -> DataFrame:
    """``key, n, mean``, once for each batch that brings the key something: its newest ``most`` values, which are the state.

    A key that is silent for ``idle`` seconds of event time leaves the state with all its values.
    """
    kind = dict(stream.dtypes)
    rows = stream.select(key, time, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    return expiring(rows, time, late).groupBy(key).transformWithStateInPandas(Recent(time, value, idle, most, key), f"{key} {kind[key]}, n long, mean double", "Append", "EventTime")


def late_outcomes(predictions: DataFrame, outcomes: DataFrame, key: str, horizon: str = "12 hours", late: str = "2 hours") -> DataFrame:
    """Predictions (``predicted_at``) with an outcome (``happened_at``) of their entity within the horizon.

    Both watermarks and the bound on times let old rows leave the state.
    """
    p = predictions.withWatermark("predicted_at", late)
    o = outcomes.withColumnRenamed(key, "_key").withWatermark("happened_at", late)
    within = (F.col("happened_at") > F.col("predicted_at")) & (F.col("happened_at") <= F.col("predicted_at") + F.expr(f"interval {horizon}"))
    return p.join(o, (F.col(key) == F.col("_key")) & within).drop("_key")


def silent(heartbeats: DataFrame, key: str, time: str, timeout: str = "90 seconds", late: str = "1 minute") -> DataFrame:
    """``key, since``: whoever sent nothing for ``timeout``, once the watermark has passed its end."""
    spells = heartbeats.withWatermark(time, late).groupBy(F.session_window(time, timeout).alias("s"), key).agg(F.count("*").alias("beats"))
    return spells.select(key, F.col("s.end").alias("since"), "beats")


def route(messages: DataFrame, good_path: str, dead_path: str, checkpoint: str) -> StreamingQuery:
    """Parsed messages to one table, malformed ones as they came to the dead letters. A batch that is run again replaces its files."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.filter(~F.col("malformed")).drop("malformed").write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        batch.filter("malformed").select("value", F.lit("unreadable").alias("reason")).write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        batch.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_by_entity(stream: DataFrame, key: str, time: str, write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch's latest row of each entity to ``write``, which merges it into the table of latest risks."""

    def step(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c != key]
        write(batch.groupBy(key).agg(F.max_by(F.struct(*rest), time).alias("r")).select(key, "r.*"))

    return stream.writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_latest(stream: DataFrame, key: str, time: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of each entity's newest row at ``folder``: every batch is merged into the newest snapshot and saved as the next.

    A row older than what is there changes nothing, so a batch that is run again leaves the same table.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)

    def merge(latest: DataFrame) -> None:
        spark = latest.sparkSession
        rest = [c for c in stream.columns if c != key]
        both = registry.load(spark, folder, schema).unionByName(latest.select(*stream.columns))
        registry.save(both.groupBy(key).agg(F.max_by(F.struct(*rest), time).alias("r")).select(key, "r.*"), folder)

    return latest_by_entity(stream, key, time, merge, checkpoint)


def notify(alerts: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str, severity: str = "severity") -> StreamingQuery:
    """Hands each batch's alerts to the handlers of their severity; ``*`` takes all. A handler that fails doesn't keep others from
    theirs, but fails the batch at its end, which is then given again: handlers should bear an alert twice.
    """

    def step(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        failed = []
        try:
            for level, handle in handlers.items():
                some = batch if level == "*" else batch.filter(F.col(severity) == level)
                if some.limit(1).count():
                    try:
                        handle(some)
                    except Exception as error:  # noqa: BLE001
                        failed.append(error)
        finally:
            batch.unpersist()
        if failed:
            raise failed[0]

    return alerts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def control_loop(spark: SparkSession, decide: Callable[[int], str | None], checkpoint: str, seconds: float = 60.0) -> StreamingQuery:
    """Calls ``decide`` with a round's number every ``seconds``, and goes on from the last finished round after a restart.

    A round that fails fails the query, so that it is seen and started again; what ``decide`` does should bear being done twice.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()

    def step(_: DataFrame, number: int) -> None:
        decide(number)

    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()


def run_to_table(stream: DataFrame, folder: str, name: str, mode: str = "complete") -> DataFrame:
    """Runs over what is there and returns the memory table; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs over what is there and returns the rows from Parquet files in ``folder``; none of them goes through the driver.

    In complete mode each batch replaces what the one before it wrote; else batches are kept side by side.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:  # there was nothing to read
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows/batch=*")
