"""A stream of live audio chunks from a folder of messages, as a Python data source.

A file is one or more lines of JSON, each a message of a client: ``audio_data`` (base64 of little-endian float32 samples), ``sample_rate``, ``session_id`` ("default" where it is
missing) and, if the client sends it, ``time`` in seconds. Files are named by growing whole numbers (``1700000000123.json``), appear whole, and never change. The offset is the largest
number read, so a query that starts again from its checkpoint reads each file once more or not at all, as its batches were committed.

A message that can't be used has a row too, with ``error`` and null audio, so that nothing vanishes.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = re.compile(r"^(\d+)\.jsonl?$")
LINE_BITS = 20
SCHEMA = "session string, ord long, s double, e double, sample_rate int, samples array<float>, error string, file string"
_ARROW = pa.schema([("session", pa.string()), ("ord", pa.int64()), ("s", pa.float64()), ("e", pa.float64()), ("sample_rate", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string()), ("file", pa.string())])


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[int, str, int, float]]:
    """(number, path, bytes, time of arrival) of all messages of a folder, by number. A folder that isn't there yet has none."""
    from pyarrow import fs

    system, folder = _system(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((int(m[1]), f.path, f.size, f.mtime_ns / 1e9) for f in found if f.is_file and (m := NAME.match(f.base_name)))


def decoded(line: str) -> tuple[str, int | None, np.ndarray | None, float | None, str | None]:
    """(session, sample_rate, samples, time, error) of a message."""
    try:
        message = json.loads(line)
    except ValueError:
        return "default", None, None, None, "not JSON"
    if not isinstance(message, dict):
        return "default", None, None, None, "not an object"
    session = message.get("session_id")
    session = "default" if session is None else str(session)
    time = message.get("time")
    time = float(time) if isinstance(time, int | float) and not isinstance(time, bool) and abs(time) < 1e12 else None
    if message.get("audio_data") is None:
        return session, None, None, time, "no audio_data"
    try:
        rate = int(message.get("sample_rate"))
    except (TypeError, ValueError):
        rate = 0
    if not 0 < rate < 1 << 31:
        return session, None, None, time, "sample_rate is not a positive whole number"
    try:
        raw = base64.b64decode(message["audio_data"], validate=True)
    except (binascii.Error, TypeError, ValueError):
        return session, rate, None, time, "audio_data is not base64"
    if len(raw) % 4:
        return session, rate, None, time, "audio_data is not whole float32 samples"
    return session, rate, np.frombuffer(raw, dtype="<f4"), time, None


class Files(InputPartition):
    def __init__(self, files: list[tuple[int, str, int, float]]):
        super().__init__(len(files))
        self.files = files


def _dealt(files: list[tuple[int, str, int, float]], parts: int) -> list[Files]:
    """Neighbouring files in up to ``parts`` partitions of about equal bytes."""
    each = max(1, sum(f[2] for f in files) // parts)
    out: list[list] = []
    size = each
    for f in files:
        if size >= each:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f[2]
    return [Files(x) for x in out]


def _read(path: str, partition: Files, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    system, _ = _system(path)
    rows, size = [], 0
    for number, name, _, arrived in partition.files:
        with system.open_input_stream(name) as f:
            lines = pa.BufferReader(f.read()).read().decode("utf-8", errors="replace").split("\n")
        for k, line in enumerate(x for x in lines if x.strip()):
            if k >> LINE_BITS:
                raise ValueError(f"{name} has over {1 << LINE_BITS} messages")
            session, rate, samples, time, error = decoded(line)
            s = arrived if time is None else time
            rows.append((session, number << LINE_BITS | k, s, s + (len(samples) / rate if samples is not None else 0.0), rate, samples, error, name.rsplit("/", 1)[-1]))
            size += len(line)
            if size >= most:
                yield _batch(rows)
                rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("numPartitions", 8))

    def initialOffset(self) -> dict:
        return {"after": -1}

    def latestOffset(self) -> dict:
        return {"after": max((f[0] for f in _files(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _dealt([f for f in _files(self.path) if start["after"] < f[0] <= end["after"]], self.parts)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("numPartitions", 8))

    def partitions(self) -> list[Files]:
        return _dealt(_files(self.path), self.parts) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class ChunkMessages(DataSource):
    """``spark.readStream.format("chunk_messages").load(folder)``, or ``spark.read`` for what is there now. Options: ``path``, ``numPartitions`` (8)."""

    @classmethod
    def name(cls) -> str:
        return "chunk_messages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)

    def reader(self, schema) -> _Batch:
        return _Batch(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkMessages)
