"""HL7 v2 messages and FHIR observations as tables, by string and array functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.schemas import LOINC, VITALS


def segments(message: Column) -> Column:
    """Segments of a message: frame bytes stripped, all line ends alike, blanks dropped."""
    text = F.regexp_replace(F.regexp_replace(message, "^\\x0B", ""), "\\x1C\\r?$", "")
    return F.filter(F.split(F.regexp_replace(text, "\\r\\n|\\n", "\r"), "\r"), lambda s: F.trim(s) != "")


def _segment(all_segments: Column, name: str) -> Column:
    return F.split(F.get(F.filter(all_segments, lambda s: s.startswith(f"{name}|")), F.lit(0)), r"\|")


def parse_hl7(messages: DataFrame, column: str = "message") -> DataFrame:
    """Header and patient fields, and ``obx``: array of (code, text, value, number)."""
    out = messages.withColumn("_s", segments(F.col(column)))
    msh, pid, pv1 = (_segment(F.col("_s"), name) for name in ("MSH", "PID", "PV1"))
    field = lambda a, k: F.nullif(F.get(a, F.lit(k)), F.lit(""))
    part = lambda c, k: F.get(F.split(c, r"\^"), F.lit(k))

    # a transform for each step, so that a segment is split once and not once a field
    fields = F.transform(F.filter("_s", lambda s: s.startswith("OBX|")), lambda s: F.split(s, r"\|"))
    pairs = F.transform(fields, lambda f: F.struct(F.split(field(f, 3), r"\^").alias("code"), field(f, 5).alias("value")))
    obx = F.transform(
        pairs,
        lambda o: F.struct(F.get(o["code"], F.lit(0)).alias("code"), F.get(o["code"], F.lit(1)).alias("text"), o["value"].alias("value"), o["value"].try_cast("double").alias("number")),
    )

    return out.select(
        *messages.columns,
        field(msh, 8).alias("message_type"),
        field(msh, 9).alias("control_id"),
        part(field(pid, 3), 0).alias("mrn"),
        birth_date(field(pid, 7)).alias("birth_date"),
        F.when(F.upper(field(pid, 8)) == "M", "M").otherwise("F").alias("gender"),
        admission_type(field(pv1, 4)).alias("admission_type"),
        obx.alias("obx"),
    )


def birth_date(text: Column) -> Column:
    """A date written with dashes or as eight digits first; null for anything else."""
    dashed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return F.when(text.contains("-"), dashed).otherwise(F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd"))).cast("date")


def admission_type(code: Column) -> Column:
    """Admission by the visit segment's code; emergency for unknown codes and without one."""
    code = F.upper(F.trim(code))
    return F.when(code.isin("EL", "ELECTIVE"), "Elective").when(code.isin("T", "TRANSFER"), "Transfer").otherwise("ED")


def acknowledgement(parsed: DataFrame) -> DataFrame:
    """AA for a known message type with its parts, AE for a broken message, AR for other types."""
    known = F.col("message_type").startswith("ORU") | F.col("message_type").startswith("ADT")
    return parsed.withColumn("ack", F.when(F.col("control_id").isNull() | F.col("message_type").isNull(), "AE").when(known, "AA").otherwise("AR"))


def code_column(code: Column, codes: dict[str, str] = LOINC) -> Column:
    """The panel column of a code, from a literal map; null for unknown codes."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), code)


def pivot_hl7(parsed: DataFrame, key: str = "control_id", fields: list[str] | None = None, complete: bool = True) -> DataFrame:
    """A row for each message with its numeric observations by column, the last of a field winning; messages without any go.

    A code is looked up first, then the identifier's text. Inside the row: messages that share a control id, or have none,
    stay apart, and nothing is shuffled. One fold over the observations gives all fields; rows are chosen inside the generator,
    since a filter would move below the fold and read the observations twice.
    """
    fields = fields or VITALS
    named = F.transform("obx", lambda o: F.struct(F.coalesce(code_column(o["code"]), code_column(o["text"])).alias("field"), o["number"].alias("number")))
    seen = F.filter(named, lambda o: o["number"].isNotNull())
    empty = F.struct(*[F.lit(None).cast("double").alias(f) for f in fields])
    last = F.aggregate(seen, empty, lambda row, o: F.struct(*[F.when(o["field"] == f, o["number"]).otherwise(row[f]).alias(f) for f in fields]))
    keep = lambda row: reduce((lambda a, b: a & b) if complete else (lambda a, b: a | b), [row[f].isNotNull() for f in fields])
    return parsed.select(key, F.inline(F.filter(F.array(last), keep)))


OBSERVATION = (
    "struct<resourceType:string,id:string,effectiveDateTime:string,category:array<struct<coding:array<struct<system:string,code:string>>>>,subject:struct<reference:string>,code:struct<coding:array<struct<system:string,code:string>>>,"
    "valueQuantity:struct<value:double>,component:array<struct<code:struct<coding:array<struct<system:string,code:string>>>,valueQuantity:struct<value:double>>>>"
)


def observations(bundles: DataFrame, column: str = "bundle") -> DataFrame:
    """Rows of a JSON bundle's observations; other resources are left out."""
    entries = F.from_json(column, f"struct<entry:array<struct<resource:{OBSERVATION}>>>")["entry"]
    return bundles.select(F.explode(entries).alias("e")).select("e.resource.*").filter(F.col("resourceType") == "Observation")


def pivot_fhir(obs: DataFrame, fields: list[str] | None = None, strict: bool = False) -> DataFrame:
    """A row for each patient with observed values; components count like observations of their own.

    ``strict``: an observation whose own code is unknown goes with all its components (so blood-pressure panels do), and one with
    components has no value of its own.
    """
    fields = fields or VITALS
    loinc = lambda code: F.coalesce(F.get(F.filter(code["coding"], lambda c: F.lower(c["system"]).contains("loinc")), F.lit(0))["code"], F.get(code["coding"], F.lit(0))["code"])
    own = F.array(F.struct(loinc(F.col("code")).alias("code"), F.col("valueQuantity.value").alias("value")))
    if strict:
        obs = obs.filter(code_column(loinc(F.col("code"))).isNotNull())
        own = F.when(F.coalesce(F.size("component"), F.lit(0)) > 0, F.slice(own, 1, 0)).otherwise(own)
    parts = F.transform(F.coalesce("component", F.array().cast(dict(obs.dtypes)["component"])), lambda c: F.struct(loinc(c["code"]).alias("code"), c["valueQuantity"]["value"].alias("value")))
    rows = obs.select(F.element_at(F.split("subject.reference", "/"), -1).alias("patient_id"), "id", F.explode(F.concat(own, parts)).alias("o"))
    rows = rows.select("patient_id", "id", code_column(F.col("o.code")).alias("field"), F.col("o.value").alias("value")).filter("value is not null")
    return rows.groupBy("patient_id").agg(*[F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("id"))).alias(f) for f in fields])


#: The fields of a flat row, in order.
FLAT_VITALS = ("heart_rate", "respiratory_rate", "spo2_pct", "temperature_c", "systolic_bp", "diastolic_bp", "oxygen_device", "oxygen_flow", "mobility_score", "nurse_alert")
FLAT_LABS = ("wbc_count", "lactate", "creatinine", "crp_level", "hemoglobin", "sepsis_risk_score")
FLAT_DEMOGRAPHICS = ("age", "gender", "comorbidity_index", "admission_type")


def complete_labs(labs: DataFrame) -> DataFrame:
    """Lab rows with all required results; a missing sepsis score is 0."""
    needed = [c for c in FLAT_LABS if c != "sepsis_risk_score"]
    score = F.coalesce(F.col("sepsis_risk_score").cast("double"), F.lit(0.0)) if "sepsis_risk_score" in labs.columns else F.lit(0.0)
    return labs.dropna(subset=needed).withColumn("sepsis_risk_score", score)


def flat_rows(vitals: DataFrame, labs: DataFrame, people: DataFrame | None = None, keys: tuple[str, ...] = ("patient_id", "hour_from_admission")) -> DataFrame:
    """A flat row for each key that has mapped vitals and labs; demographics where there are any."""
    out = vitals.select(*keys, *FLAT_VITALS).join(complete_labs(labs).select(*keys, *FLAT_LABS), list(keys))
    if people is not None:
        out = out.join(people.select(keys[0], *FLAT_DEMOGRAPHICS), keys[0], "left")
    return out


PATIENT = "struct<resourceType:string,id:string,gender:string,birthDate:string>"


def patients(bundles: DataFrame, column: str = "bundle") -> DataFrame:
    """Rows of a JSON bundle's patients: id, gender, birth_date."""
    entries = F.from_json(column, f"struct<entry:array<struct<resource:{PATIENT}>>>")["entry"]
    rows = bundles.select(F.explode(F.filter(entries, lambda e: e["resource"]["resourceType"] == "Patient")).alias("e")).select("e.resource.*")
    return rows.select("id", F.when(F.lower("gender") == "female", "F").otherwise("M").alias("gender"), F.try_to_timestamp("birthDate", F.lit("yyyy-MM-dd")).cast("date").alias("birth_date"))


def demographics(rows: DataFrame, on: Column, keep: list[str]) -> DataFrame:
    """``keep``, age, gender, comorbidity_index and admission_type of messages or patients; rows with ages over 120 go.

    What the source doesn't tell has its default: no comorbidity, an emergency admission, an age of 50. The sex of a message that
    isn't M is F, that of a patient resource that isn't female is M.
    """
    admission = F.coalesce("admission_type", F.lit("ED")) if "admission_type" in rows.columns else F.lit("ED")
    out = rows.select(*keep, age_years(F.col("birth_date"), on).alias("age"), "gender", F.lit(0).alias("comorbidity_index"), admission.alias("admission_type"))
    return out.filter("age <= 120")


def age_years(birth: Column, on: Column) -> Column:
    """Completed years, 0 at least; 50 without a birth date."""
    before = F.date_format(on, "MMdd") < F.date_format(birth, "MMdd")
    return F.coalesce(F.greatest(F.year(on) - F.year(birth) - F.when(before, 1).otherwise(0), F.lit(0)), F.lit(50))
