"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.checkpoints import cut, shared_folder, store  # noqa: F401

#: The word pattern of the quality and near-duplicate contracts: anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of rows that go to a Python worker at a time (a longer row goes alone), where the session doesn't set its own bound.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for rows with whole texts: batches are bounded in bytes, so memory doesn't depend on the texts' lengths.

    The bound is the session's ``spark.sql.execution.arrow.maxBytesPerBatch``; it is set here if the session leaves it unset.
    When a task ends, its worker gives free memory back to the system.
    """
    session, bound = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if session.conf.get(bound, None) is None:
        session.conf.set(bound, str(BATCH_BYTES))

    def bounded(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def by_size(small: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``small`` for broadcast only when a count shows that it is within ``max_rows``; else leave the join to Spark.

    ``small`` should be cheap to read twice (checkpointed or read from a table).
    """
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def words(text):
    """Array of the words of ``text``: split at ASCII white space, no empty strings; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
