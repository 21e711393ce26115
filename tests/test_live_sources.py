"""Sources that talk to clients and servers: framed messages through a restart, searches with filters pushed to the server."""

from __future__ import annotations

import json
import re
import socket
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidewell.operators import clinical_docs
from tidewell.sources import feeds
from tidewell.sources.mllp import FrameLog, MllpReader, MllpSource, acknowledgement, frames_of
from tidewell.sources.observation_search import ObservationSource


def hl7(k):
    return f"MSH|^~\\&|A|B|C|D|20240101||ORU^R01|id{k}|P|2.5\rPID|1||{k}\rOBX|1|NM|8867-4^HR||{k}\r"


def framed(k):
    return feeds.START.encode() + hl7(k).encode() + feeds.END.encode()


def free_port():
    with socket.create_server(("127.0.0.1", 0)) as s:
        return s.getsockname()[1]


def connected(port):
    for _ in range(300):
        try:
            return socket.create_connection(("127.0.0.1", port), timeout=20)
        except OSError:
            time.sleep(0.1)
    raise AssertionError("nobody listens")


def answers(client, n):
    got = b""
    while got.count(feeds.END.encode()) < n:
        chunk = client.recv(65536)
        assert chunk
        got += chunk
    return re.findall(rb"MSA\|(\w+)\|(\w*)", got)


def test_frames_are_cut_and_answered():
    assert frames_of(b"junk" + framed(1) + framed(2)[:20]) == ([hl7(1).encode()], framed(2)[:20])
    assert b"MSA|AA|id3\r" in acknowledgement(hl7(3)) and b"ACK^R01" in acknowledgement(hl7(3))
    assert b"MSA|AE|\r" in acknowledgement("no header")


def test_log_keeps_its_numbers(tmp_path):
    log = FrameLog(str(tmp_path / "log"))
    one = {"connection": "c", "received_ms": 1, "message": "m"}
    for k in range(4):
        log.append(2 * k, [one, one | {"message": f"m{k}"}])
    reader = MllpReader({"log": str(tmp_path / "log"), "framesPerPartition": "4"})
    parts = reader.partitions({"next": 1}, {"next": 7})
    assert len(parts) == 2 and [r[0] for p in parts for r in reader.read(p)] == [1, 2, 3, 4, 5, 6]
    reader.commit({"next": 8})
    assert [s[:2] for s in log.segments()] == [(6, 2)]  # the last one tells where numbers go on


def test_two_connections_with_a_split_frame_through_a_restart(spark, tmp_path):
    spark.dataSource.register(MllpSource)
    port = free_port()
    stream = spark.readStream.format("mllp").option("log", str(tmp_path / "log")).option("port", port).option("host", "127.0.0.1").load()

    def start():
        return stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()

    def wait(n):
        for _ in range(300):
            if (tmp_path / "out").exists() and spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).count() >= n:
                return
            assert query.exception() is None
            time.sleep(0.2)
        raise AssertionError("rows didn't come")

    query = start()
    try:
        a, b = connected(port), connected(port)
        a.sendall(framed(1) + framed(2)[:15])
        b.sendall(b"noise" + framed(3) + framed(4))
        assert answers(a, 1) == [(b"AA", b"id1")] and answers(b, 2) == [(b"AA", b"id3"), (b"AA", b"id4")]
        time.sleep(0.3)
        a.sendall(framed(2)[15:])
        assert answers(a, 1) == [(b"AA", b"id2")]
        wait(4)
        a.sendall(framed(5)[:10])  # never whole, so never acknowledged
    finally:
        query.stop()
    query = start()
    try:
        a = connected(port)
        a.sendall(framed(5) + framed(6))
        assert answers(a, 2) == [(b"AA", b"id5"), (b"AA", b"id6")]
        wait(6)
    finally:
        query.stop()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["seq"] for r in rows.collect()) == list(range(6))
    assert sorted(r["control_id"] for r in clinical_docs.parse_hl7(rows).collect()) == [f"id{k}" for k in range(1, 7)]


def observation(k):
    code = lambda system, c: {"coding": [{"system": system, "code": c}]}
    return {
        "resourceType": "Observation",
        "id": f"o{k:03d}",
        "subject": {"reference": f"Patient/{k % 3}"},
        "category": [code("c", "vital-signs" if k % 2 else "laboratory")],
        "code": code(feeds.LOINC_SYSTEM, "8867-4" if k % 4 == 1 else "2708-6"),
        "effectiveDateTime": f"2024-01-{k % 28 + 1:02d}T00:00:00Z" if k % 7 else None,
        "valueQuantity": {"value": float(k)},
    }


@pytest.fixture
def server():
    stored, seen, fail = [observation(k) for k in range(120)], [], [2]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            seen.append(q)
            if "_offset" in q and fail[0]:  # the first pages asked for fail
                fail[0] -= 1
                self.send_error(503)
                return
            found = [o for o in stored if q.get("patient") in (None, o["subject"]["reference"].split("/")[1]) and q.get("category") in (None, o["category"][0]["coding"][0]["code"]) and q.get("code") in (None, f"{feeds.LOINC_SYSTEM}|{o['code']['coding'][0]['code']}")]
            found.sort(key=lambda o: (o["effectiveDateTime"] or "", o["id"]), reverse=True)
            page = found[int(q.get("_offset", 0)) :][: int(q.get("_count", 0))]
            body = json.dumps({"resourceType": "Bundle", "total": len(found), "entry": [{"resource": o} for o in page]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", stored, seen
    http.shutdown()


def test_the_server_sees_the_filters_and_rows_are_the_searchs(spark, server):
    url, stored, seen = server
    spark.dataSource.register(ObservationSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bundle = spark.createDataFrame([(json.dumps({"entry": [{"resource": o} for o in stored]}),)], "bundle string")
    landed = clinical_docs.observations(bundle)
    read = spark.read.format("observations").option("url", url).option("pageSize", 7).option("pagesPerPartition", 1).option("waitSeconds", 0.01)
    ids = lambda df: sorted((r["patient_id"], r["id"]) for r in df.select("patient_id", "id").collect())

    one = read.option("count", 10).load().filter((F.col("patient_id") == "1") & (F.col("category") == "vital-signs") & (F.col("code") == "8867-4"))
    assert ids(one) == ids(feeds.search(landed, "vital-signs", "8867-4", "1", 10))
    asked = [q for q in seen if "_offset" in q]
    assert asked and all((q["patient"], q["category"], q["code"], q["_sort"]) == ("1", "vital-signs", f"{feeds.LOINC_SYSTEM}|8867-4", "-date") for q in seen)
    assert sorted(int(q["_offset"]) + int(q["_count"]) for q in asked)[-1] == 10 and len({q["_offset"] for q in asked}) == 2

    some = read.option("count", 15).load().filter(F.col("patient_id").isin("0", "2") & (F.col("category") == "laboratory"))
    wanted = feeds.search(landed, "laboratory", None, None, 15).filter(F.col("patient_id").isin("0", "2"))
    assert ids(some) == ids(wanted)
    whole = spark.read.format("observations").option("url", url).load()
    assert whole.count() == 120 and whole.rdd.getNumPartitions() >= 1
    late = whole.filter((F.col("code") == "2708-6") & (F.col("effective") >= "2024-01-20"))  # the date stays with Spark
    assert late.count() == sum(o["code"]["coding"][0]["code"] == "2708-6" and (o["effectiveDateTime"] or "") >= "2024-01-20" for o in stored)
    with pytest.raises(Exception, match="filter by patient_id"):
        read.option("count", 10).load().count()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
