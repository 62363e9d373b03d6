"""Recorded files as a data source: ``spark.read.format("recording")`` and ``spark.readStream.format("recording")``.

Options: ``path`` (a folder or file, on any file system that Arrow knows by its URI), ``kind`` (frames, events or documents) and
``suffix`` (.json). A file is a partition, listed on the driver and read by a task. A file or an entry that can't be read is a row
with a ``reason`` and nothing else but its place, so one bad file stops no stream; ``reason is null`` are the good rows.
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Columns of each kind, after path and pos.
KINDS = {
    "frames": "id string, ts_ms long, data binary, width int, height int, frame_no long",
    "events": "id string, type string, ts_ms long, x double, y double, element string",
    "documents": "raw string",
}


@dataclass
class File(InputPartition):
    path: str
    changed: int


def _file_system(path: str):
    """(file system, path on it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str, suffix: str) -> list[File]:
    """The files of a folder and its folders, hidden ones left out, by the time of their last change, then name."""
    from pyarrow import fs

    system, at = _file_system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
    head = path[: len(path) - len(at)] if "://" in path else ""
    own = [f for f in found if f.is_file and f.path.endswith(suffix) and not any(p[0] in "._" for p in f.path[len(at) :].split("/") if p)]
    return sorted((File(head + f.path, f.mtime_ns or 0) for f in own), key=lambda f: (f.changed, f.path))


def _number(value, kind):
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{value!r:.40} is no number")
    return kind(value)


def _frame(e: dict) -> tuple:
    size = e.get("dimensions") or {}
    whole = lambda v: None if v is None else _number(v, int)
    return e.get("id"), _number(e.get("timestamp"), int), base64.b64decode(e["data"], validate=True), whole(size.get("width")), whole(size.get("height")), whole(e.get("frameNumber"))


def _event(e: dict) -> tuple:
    at = e.get("target") or {}
    place = [None if at.get(c) is None else _number(at[c], float) for c in "xy"]
    return e.get("id"), e.get("type"), _number(e.get("timestamp"), int), *place, at.get("elementId")


def rows_of(kind: str, path: str, raw: bytes) -> Iterator[tuple]:
    """(path, pos, columns of the kind, reason) of a file's contents."""
    width = len(KINDS[kind].split(", "))
    bad = lambda pos, why: (path, pos, *[None] * width, why[:200])
    try:
        text = raw.decode("utf-8")
        found = json.loads(text)
    except ValueError as e:
        yield bad(None, f"no JSON: {e}")
        return
    if kind == "documents":
        yield (path, 0, text, None) if isinstance(found, dict) else bad(0, "no document")
        return
    for pos, entry in enumerate(found if isinstance(found, list) else [found]):
        try:
            yield path, pos, *(_frame if kind == "frames" else _event)(entry), None
        except (KeyError, TypeError, ValueError, AttributeError, binascii.Error) as e:
            yield bad(pos, f"{type(e).__name__}: {e}")


class _Reading:
    def __init__(self, options):
        self.path, self.kind, self.suffix = options["path"], options.get("kind", "documents"), options.get("suffix", ".json")
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")

    def read(self, partition: File) -> Iterator[tuple]:
        system, at = _file_system(partition.path)
        try:
            with system.open_input_stream(at) as f:
                raw = f.read()
        except OSError as e:
            yield (partition.path, None, *[None] * len(KINDS[self.kind].split(", ")), f"unreadable: {e}"[:200])
            return
        yield from rows_of(self.kind, partition.path, raw)


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[File]:
        return listed(self.path, self.suffix)


class _Stream(_Reading, DataSourceStreamReader):
    """Offsets are times of change: a batch has the files changed after the last one and up to the newest. A file must come with a
    later time than those before it, as it does when it is written elsewhere and moved in, or written at once."""

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        files = listed(self.path, self.suffix)
        return {"changed": files[-1].changed if files else -1}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [f for f in listed(self.path, self.suffix) if start["changed"] < f.changed <= end["changed"]]


class Recording(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        kind = self.options.get("kind", "documents")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        return f"path string, pos int, {KINDS[kind]}, reason string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Recording)
