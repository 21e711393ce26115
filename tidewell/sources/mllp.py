"""A streaming source of framed messages that clients send over TCP: ``spark.readStream.format("mllp")``.

A listener on the driver takes connections, cuts what comes in into frames and writes them to a log, a folder of immutable segments
that driver and executors share. A frame is acknowledged when its segment is written and not before, so a client that hears nothing
sends it again and nothing that was acknowledged is lost. Offsets are the frames' numbers in the log. Partitions are runs of
segments, read by executors; after a restart the log is read on from the offset in the query's checkpoint, and segments below a
committed offset are deleted.

Options: ``log`` (a folder, by any path that pyarrow's file systems know), ``port``, ``host`` (all interfaces by default),
``framesPerPartition`` (10,000), ``maxFrameBytes`` (16 MB; a connection that sends a longer one is closed), ``idleSeconds`` (300).

Bytes before a frame's start are dropped. A message without a header is acknowledged as broken (AE) and kept: what is wrong with it
is told by the parser. Bytes that aren't UTF-8 become replacement characters.
"""

from __future__ import annotations

import json
import queue
import socket
import threading
import time
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewell.sources.feeds import END, START

SCHEMA = "seq long, connection string, received_ms long, message string"
_START, _END = START.encode(), END.encode()


class FrameLog:
    """Segments of frames, named by their first frame's number and how many they hold."""

    def __init__(self, folder: str):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)

    def segments(self) -> list[tuple[int, int, str]]:
        """``first, frames, path`` in order."""
        found = self.fs.get_file_info(fs.FileSelector(self.folder))
        names = [(i.base_name.removesuffix(".jsonl").split("-"), i.path) for i in found if i.base_name.endswith(".jsonl")]
        return sorted((int(first), int(n), path) for (first, n), path in names)

    def append(self, first: int, frames: list[dict]) -> None:
        """A segment appears whole or not at all."""
        part = f"{self.folder}/{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(part) as out:
            out.write("".join(json.dumps(f) + "\n" for f in frames).encode())
        self.fs.move(part, f"{self.folder}/{first:019d}-{len(frames):09d}.jsonl")

    def read(self, path: str, first: int, low: int, high: int) -> Iterator[tuple]:
        with self.fs.open_input_stream(path) as file:
            for k, line in enumerate(file.read().decode().splitlines()):
                if low <= first + k < high:
                    f = json.loads(line)
                    yield first + k, f["connection"], f["received_ms"], f["message"]

    def drop_below(self, seq: int) -> None:
        """Deletes segments whose frames are all below ``seq``, but for the last one, which tells where numbers go on."""
        for first, n, path in self.segments()[:-1]:
            if first + n <= seq:
                self.fs.delete_file(path)


def frames_of(buffer: bytes) -> tuple[list[bytes], bytes]:
    """The messages of the whole frames in ``buffer``, and what is left of it."""
    *whole, rest = buffer.split(_END)
    return [w.split(_START, 1)[1] for w in whole if _START in w], rest


def acknowledgement(message: str) -> bytes:
    """A framed answer that names the message's control id: AA, or AE for a message without a header."""
    first = message.replace("\n", "\r").split("\r", 1)[0].split("|")
    known = first[0] == "MSH" and len(first) > 9
    control, kind = (first[9], first[8]) if known else ("", "")
    trigger = kind.split("^")[1] if "^" in kind else ""
    at = time.strftime("%Y%m%d%H%M%S", time.gmtime())
    answer = f"MSH|^~\\&|||||{at}||ACK^{trigger}|{uuid.uuid4().hex[:20]}|P|2.5\rMSA|{'AA' if known and control else 'AE'}|{control}\r"
    return _START + answer.encode() + _END


class Listener:
    """Takes connections and writes their frames; frames that wait while a segment is written share the next one."""

    def __init__(self, log: FrameLog, host: str, port: int, most: int, idle: float):
        self.log, self.most, self.idle = log, most, idle
        last = log.segments()[-1:]
        self.next = last[0][0] + last[0][1] if last else 0
        self.waiting: queue.Queue = queue.Queue(maxsize=10_000)
        self.running = True
        self.server = socket.create_server((host, port), reuse_port=False)
        for run in (self._accept, self._write):
            threading.Thread(target=run, daemon=True).start()

    def _accept(self) -> None:
        while self.running:
            try:
                connection, peer = self.server.accept()
            except OSError:
                return
            threading.Thread(target=self._receive, args=(connection, f"{peer[0]}:{peer[1]}"), daemon=True).start()

    def _receive(self, connection: socket.socket, name: str) -> None:
        connection.settimeout(self.idle)
        buffer = b""
        with connection:
            while self.running:
                try:
                    chunk = connection.recv(65536)
                except OSError:
                    return
                if not chunk:
                    return
                found, buffer = frames_of(buffer + chunk)
                for raw in found:
                    written = threading.Event()
                    message = raw.decode("utf-8", "replace")
                    self.waiting.put(({"connection": name, "received_ms": int(time.time() * 1000), "message": message}, written))
                    while not written.wait(1.0):
                        if not self.running:
                            return
                    try:
                        connection.sendall(acknowledgement(message))
                    except OSError:
                        return
                if len(buffer) > self.most:
                    return

    def _write(self) -> None:
        while self.running:
            try:
                group = [self.waiting.get(timeout=0.2)]
            except queue.Empty:
                continue
            while len(group) < 1000 and not self.waiting.empty():
                group.append(self.waiting.get())
            self.log.append(self.next, [frame for frame, _ in group])
            self.next += len(group)
            for _, written in group:
                written.set()

    def close(self) -> None:
        self.running = False
        self.server.close()


class Frames(InputPartition):
    """Segments (``first, path``) and the numbers of the frames that are wanted of them."""

    def __init__(self, segments: list[tuple[int, str]], low: int, high: int):
        self.segments, self.low, self.high = segments, low, high


class MllpReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.listener: Listener | None = None

    def __getstate__(self) -> dict:
        return {"options": self.options, "listener": None}  # executors read segments only

    def _log(self) -> FrameLog:
        return FrameLog(self.options["log"])

    def _listening(self) -> Listener:
        if self.listener is None:
            o = self.options
            self.listener = Listener(self._log(), o.get("host", ""), int(o["port"]), int(o.get("maxFrameBytes", 16 << 20)), float(o.get("idleSeconds", 300)))
        return self.listener

    def initialOffset(self) -> dict:
        self._listening()
        first = self._log().segments()[:1]
        return {"next": first[0][0] if first else 0}

    def latestOffset(self) -> dict:
        return {"next": self._listening().next}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high, most = start["next"], end["next"], int(self.options.get("framesPerPartition", 10_000))
        out: list[InputPartition] = []
        group, held = [], 0
        for first, n, path in self._log().segments():
            if first < high and first + n > low:
                group.append((first, path))
                held += n
                if held >= most:
                    out.append(Frames(group, low, high))
                    group, held = [], 0
        return out + [Frames(group, low, high)] if group or not out else out

    def read(self, partition: Frames) -> Iterator[tuple]:
        log = self._log()
        for first, path in partition.segments:
            yield from log.read(path, first, partition.low, partition.high)

    def commit(self, end: dict) -> None:
        self._log().drop_below(end["next"])

    def stop(self) -> None:
        if self.listener is not None:
            self.listener.close()
            self.listener = None


class MllpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mllp"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> MllpReader:
        return MllpReader({k: self.options[k] for k in ("log", "port", "host", "framesPerPartition", "maxFrameBytes", "idleSeconds") if k in self.options})
