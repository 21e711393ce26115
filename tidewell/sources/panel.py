"""Panel sources: the adapter over an event table, and file scans with explicit schemas."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import grid
from tidewell.schemas import ENTITY, HOUR, KEYS, LABS, STATIC, VITALS, panel_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_to_panel(events: DataFrame) -> DataFrame:
    """Ten-hour slots of a month of events become the hours of a stay; each event type becomes a signal, so it is sparse."""
    slot = F.floor(((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")) / 10.0).cast("long")
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("value")))
    return events.groupBy(F.col("user_id").cast("long").alias(ENTITY), slot.alias(HOUR)).agg(
        (60.0 + of("view") * 0.6).alias("heart_rate"),
        (10.0 + of("click") * 0.2).alias("respiratory_rate"),
        (100.0 - of("error") * 0.1).alias("spo2_pct"),
        (36.0 + of("purchase") * 0.02).alias("temperature_c"),
        (140.0 - of("signup") * 0.5).alias("systolic_bp"),
        (85.0 - of("signup") * 0.2).alias("diastolic_bp"),
        (0.5 + of("error") * 0.03).alias("lactate"),
        (60.0 + F.max("value") * 0.6).alias("hr_dense"),
        (130.0 - F.min("value") * 0.5).alias("sbp_dense"),
    )


def with_statics(panel: DataFrame) -> DataFrame:
    """Attributes that the event table lacks, derived from the entity's number."""
    k = F.col(ENTITY)
    return panel.withColumns(
        {
            "age": (18 + k % 70).cast("int"),
            "gender": F.when(k % 2 == 0, "F").otherwise("M"),
            "comorbidity_index": (k % 9).cast("int"),
            "admission_type": F.when(k % 3 == 0, "ED").when(k % 3 == 1, "Elective").otherwise("Transfer"),
            "deterioration_hour": F.when(k % 4 == 0, k % 72).otherwise(-1).cast("long"),
            "mobility_score": ((k + F.col(HOUR)) % 5).cast("int"),
            "nurse_alert": F.when((k + F.col(HOUR)) % 7 == 0, 1).otherwise(0),
        }
    )


def read_panel_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The named columns (all, if none are named) of a file with a header, in any order; what doesn't fit is null.

    Columns are found by name, so the file is read as text and cast; a column that the file lacks is null.
    """
    schema = panel_type(columns)
    raw = spark.read.csv(path, header=True)
    pick = lambda f: F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") if f.name in raw.columns else F.lit(None).cast(f.dataType)
    return raw.select(*[pick(f).alias(f.name) for f in schema.fields])


def read_three_files(spark: SparkSession, folder: str, aligned: bool = False) -> DataFrame:
    """``vitals.csv`` and ``labs.csv`` joined on entity and hour, with the attributes of ``patients.csv``; ``aligned``: on the hour grid."""
    vitals = read_panel_csv(spark, f"{folder}/vitals.csv", [*KEYS, *VITALS, "oxygen_device", "oxygen_flow", "mobility_score", "nurse_alert"])
    labs = read_panel_csv(spark, f"{folder}/labs.csv", [*KEYS, *LABS, "sepsis_risk_score"])
    patients = read_panel_csv(spark, f"{folder}/patients.csv", [ENTITY, *STATIC, "deterioration_hour"])
    facts = grid.merge_facts(vitals, labs)
    return align(facts, patients) if aligned else grid.add_dimension(facts, patients)


def align(facts: DataFrame, patients: DataFrame) -> DataFrame:
    """Facts on the hour grid: every hour from an entity's first to its last below the stay's limit, with its attributes in each of them."""
    whole = grid.continuous_grid(grid.clip_stay(facts))
    return grid.fill_static(grid.add_dimension(whole, patients), [*STATIC, "deterioration_hour"])


def load(spark: SparkSession, folder: str, joined: str = "hourly_panel.csv", aligned: bool = False) -> DataFrame:
    """The pre-joined panel file, or, where it isn't there, the three files it is made of, ``aligned`` on the hour grid if asked for."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{joined}")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return read_panel_csv(spark, f"{folder}/{joined}") if there else read_three_files(spark, folder, aligned)


def first_entities(panel: DataFrame, n: int, order: Column | None = None) -> DataFrame:
    """The rows of the first ``n`` entities; by number unless an order (of arrival, say) is given."""
    first = panel.groupBy(ENTITY).agg(F.min(F.col(ENTITY) if order is None else order).alias("_at"))
    return panel.join(first.orderBy("_at", ENTITY).limit(n).select(ENTITY), ENTITY, "left_semi")


def of_entities(panel: DataFrame, ids: DataFrame) -> DataFrame:
    return panel.join(ids.select(ENTITY).distinct(), ENTITY, "left_semi")


def read_splits(spark: SparkSession, path: str, names: tuple[str, ...] = ("train", "val", "test")) -> dict[str, DataFrame]:
    """The processed splits that are there, by name; each is a partition of one dataset, pruned at the scan. What is missing is warned about."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {s.getPath().getName().removeprefix("split=") for s in files.listStatus(root) if s.isDirectory()} if files.exists(root) else set()
    for name in names:
        if name not in there:
            warnings.warn(f"no split {name} at {path}", stacklevel=2)
    return {n: spark.read.parquet(path).filter(F.col("split") == n) for n in names if n in there}


def latest(panel: DataFrame) -> DataFrame:
    """Each entity's last row."""
    rest = [c for c in panel.columns if c not in KEYS]
    last = panel.groupBy(ENTITY).agg(F.max_by(F.struct(HOUR, *rest), HOUR).alias("_row"))
    return last.select(ENTITY, "_row.*")
