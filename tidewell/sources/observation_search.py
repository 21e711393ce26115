"""A batch source of observations from a server's search: ``spark.read.format("observations")``.

Equality filters on ``patient_id``, ``category`` and ``code`` go to the server as its own search parameters (a list of patients as one
search each), the rest stays with Spark. A search is asked for its total first and cut into ranges of pages, one to a partition;
executors fetch their pages, newest observations first, and try again when a request fails.

Options: ``url`` (the server's base), ``pageSize`` (50), ``pagesPerPartition`` (20), ``count`` (each patient's newest so many; all
without it), ``retries`` (3), ``waitSeconds`` (0.5, doubled with each try), ``timeoutSeconds`` (30).

``category`` and ``code`` hold the filter's value where one was given, else the first of the observation's own. Pushing filters needs
``spark.sql.python.filterPushdown.enabled``; without it all observations are fetched and Spark filters by these columns.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tidewell.sources.feeds import LOINC_SYSTEM

SCHEMA = "patient_id string, category string, code string, id string, effective string, resource string"
PUSHED = ("patient_id", "category", "code")


class Pages(InputPartition):
    """Pages ``low`` to ``high`` - 1 of a search."""

    def __init__(self, search: dict[str, str], low: int, high: int):
        self.search, self.low, self.high = search, low, high


def first_code(concepts, system: str | None = None) -> str | None:
    codes = [k.get("code") for c in concepts or [] for k in c.get("coding") or [] if system is None or k.get("system") == system]
    return codes[0] if codes else None


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.wanted = options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the first filter on each column that the server knows; yields what Spark has to do."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            values = None if column not in PUSHED else [f.value] if isinstance(f, EqualTo) else list(f.value) if column == "patient_id" else None
            if values is None or column in self.wanted or not all(isinstance(v, str) for v in values):
                yield f
            else:
                self.wanted[column] = values

    def _get(self, search: dict[str, str]) -> dict:
        o = self.options
        wait = float(o.get("waitSeconds", 0.5))
        for left in range(int(o.get("retries", 3)), -1, -1):
            try:
                with urllib.request.urlopen(f"{o['url'].rstrip('/')}/Observation?{urllib.parse.urlencode(search)}", timeout=float(o.get("timeoutSeconds", 30))) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as error:
                if not left or error.code < 500 and error.code != 429:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError):
                if not left:
                    raise
            time.sleep(wait)
            wait *= 2
        raise AssertionError

    def partitions(self) -> list[InputPartition]:
        common = {"_sort": "-date"}
        if "category" in self.wanted:
            common["category"] = self.wanted["category"][0]
        if "code" in self.wanted:
            common["code"] = f"{LOINC_SYSTEM}|{self.wanted['code'][0]}"
        size, most, out = int(self.options.get("pageSize", 50)), self.options.get("count"), []
        if most is not None and "patient_id" not in self.wanted:
            raise ValueError("count is each patient's: filter by patient_id, with filters pushed")
        per = int(self.options.get("pagesPerPartition", 20))
        for patient in dict.fromkeys(self.wanted.get("patient_id", [None])):
            search = common | ({"patient": patient} if patient is not None else {})
            total = int(self._get(search | {"_summary": "count"}).get("total", 0))
            total = total if most is None else min(total, int(most))
            pages = -(-total // size)
            out += [Pages(search | {"_total": str(total)}, a, min(pages, a + per)) for a in range(0, pages, per)]
        return out or [Pages({}, 0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        search, size = dict(partition.search), int(self.options.get("pageSize", 50))
        total = int(search.pop("_total", 0))
        for page in range(partition.low, partition.high):
            bundle = self._get(search | {"_count": str(min(size, total - page * size)), "_offset": str(page * size)})
            for entry in bundle.get("entry") or []:
                r = entry.get("resource") or {}
                if r.get("resourceType") != "Observation":
                    continue
                category = self.wanted["category"][0] if "category" in self.wanted else first_code(r.get("category"))
                code = self.wanted["code"][0] if "code" in self.wanted else first_code([r.get("code") or {}], LOINC_SYSTEM)
                patient = ((r.get("subject") or {}).get("reference") or "").split("/")[-1] or None
                yield patient, category, code, r.get("id"), r.get("effectiveDateTime"), json.dumps(r)


class ObservationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "observations"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SearchReader:
        names = ("url", "pageSize", "pagesPerPartition", "count", "retries", "waitSeconds", "timeoutSeconds")
        return SearchReader({k: self.options[k] for k in names if k in self.options})
