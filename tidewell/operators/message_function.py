"""``parse_message``: a table function for messages in SQL, as in ``FROM feed, LATERAL parse_message(feed.message)``.

Its columns follow from its second argument when the query is analysed: ``'observations'`` (the default) gives a row for each
observation, ``'header'`` one row for each message.

Rows go to Python in pickled batches: with Arrow a lateral call makes a table of columns for each single message, which costs
many times the parse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Columns by name and type; analysis runs without a session, so they aren't parsed from a string.
HEADER = {"message_type": StringType(), "control_id": StringType(), "mrn": StringType(), "gender": StringType(), "n_observations": IntegerType()}
OBSERVATIONS = {"control_id": StringType(), "mrn": StringType(), "position": IntegerType(), "code": StringType(), "text": StringType(), "value": StringType(), "number": DoubleType()}
_END = re.compile("\x1c\r?$")
_NUMBER = re.compile(r"\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?[df]?|inf|infinity|nan)\s*", re.I)


def fields(message: str) -> tuple[dict[str, list[str]], list[list[str]]]:
    """The first segment of each name, and all observation segments, cut at bars."""
    text = message.removeprefix("\x0b")
    if "\x1c" in text:
        text = _END.sub("", text)
    first: dict[str, list[str]] = {}
    obx = []
    for s in text.replace("\r\n", "\r").replace("\n", "\r").split("\r"):
        cut = s.split("|")
        if len(cut) > 1:
            first.setdefault(cut[0], cut)
            if cut[0] == "OBX":
                obx.append(cut)
    return first, obx


def number(value: str | None) -> float | None:
    if value is None or not _NUMBER.fullmatch(value):
        return None
    text = value.strip().lower()
    return float(text if text.endswith("inf") else text.rstrip("df"))


class ParseMessage:
    def __init__(self, analyzed: AnalyzeResult):
        self.header = "n_observations" in analyzed.schema.names

    @staticmethod
    def analyze(message: AnalyzeArgument, form: AnalyzeArgument | None = None) -> AnalyzeResult:
        if message.dataType != StringType():
            raise ValueError("parse_message takes a string")
        if form is not None and not form.isConstantExpression:
            raise ValueError("the form of parse_message is a constant")
        kind = "observations" if form is None else form.value
        if kind not in ("observations", "header"):
            raise ValueError("parse_message knows 'observations' and 'header'")
        return AnalyzeResult(StructType([StructField(n, t) for n, t in (HEADER if kind == "header" else OBSERVATIONS).items()]))

    def eval(self, message: str | None, form: str | None = None) -> Iterator[tuple]:
        if message is None:
            return
        first, obx = fields(message)
        field = lambda segment, k: (segment[k] or None) if len(segment) > k else None
        part = lambda value, k: None if value is None or k >= len(p := value.split("^")) else p[k]
        msh, pid = first.get("MSH", []), first.get("PID", [])
        control, mrn = field(msh, 9), part(field(pid, 3), 0)
        if self.header:
            yield field(msh, 8), control, mrn, "M" if (field(pid, 8) or "").upper() == "M" else "F", len(obx)
            return
        for k, s in enumerate(obx, 1):
            code, value = field(s, 3), field(s, 5)
            yield control, mrn, k, part(code, 0), part(code, 1), value, number(value)


def register(spark: SparkSession, name: str = "parse_message") -> None:
    spark.udtf.register(name, udtf(ParseMessage, useArrow=False))
