"""A stream source of log records by their sequence numbers: `spark.readStream.format("log_tail")`.

Logs are segments of JSON lines, each file named after the first and the last number that it holds. Where the stream stands is a
number; what is there follows from the names alone, so a new batch lists a folder and opens only the segments that hold
records beyond the last one. Each segment is read by a task of its own. Options: path (any file system that Arrow knows),
since (records up to that number are left out), and segments (of a batch, at most; a run of what is available is one batch). Segments don't change once they have their
name. Files of other names are left alone; lines that aren't records, or lie outside of the batch, give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "seq long, request_id string, level string, step_name string, ms double"
NAME = re.compile(r"(\d+)-(\d+)\.jsonl")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def segments(uri: str) -> list[tuple[int, int, str]]:
    """(first, last, path) of all segments, by their numbers."""
    store, path = _open(uri)
    found = ((NAME.fullmatch(f.base_name), f.path) for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)))
    return sorted((int(m[1]), int(m[2]), p) for m, p in found if m)


@dataclass
class Segment(InputPartition):
    path: str
    after: int
    to: int


class _Reader:
    def __init__(self, options: dict):
        self.uri, self.since, self.most = options["path"], int(options.get("since", 0)), int(options.get("segments", 1 << 30))

    def within(self, after: int, to: int) -> list[Segment]:
        return [Segment(path, after, to) for first, last, path in segments(self.uri) if last > after and first <= to]

    def read(self, part: Segment) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.uri)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["seq", "request_id", "level", "step_name", "ms"])

        with store.open_input_stream(part.path) as raw, pa.input_stream(raw) as lines:
            rest = b""
            while block := lines.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                for line in [*whole]:
                    self._add(rows, line, part)
                if len(rows) >= 4096:
                    yield batch()
                    rows = []
            self._add(rows, rest, part)
        if rows:
            yield batch()

    @staticmethod
    def _add(rows: list[tuple], line: bytes, part: Segment) -> None:
        try:
            r = json.loads(line)
            if part.after < (seq := int(r["seq"])) <= part.to:
                text = lambda k: None if r.get(k) is None else str(r[k])
                rows.append((seq, text("request_id"), text("level"), text("step_name"), None if r.get("ms") is None else float(r["ms"])))
        except (ValueError, KeyError, TypeError):
            return


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[Segment]:
        return self.within(self.since, 1 << 62)


class _Stream(_Reader, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.at = self.since

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        new = [last for _, last, _ in segments(self.uri) if last > self.at][: self.most]
        self.at = max([self.at, *new])
        return {"seq": self.at}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        self.at = max(self.at, end["seq"])
        return self.within(start["seq"], end["seq"])

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["seq"])


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)


def write_segments(logs: DataFrame, uri: str, many: int) -> None:
    """Writes records (seq, request_id, level, step_name, ms) as `many` segments of consecutive numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(uri)
        store.create_dir(path, recursive=True)
        first = last = None
        temp, out = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    first, temp = r["seq"], f"{path}/_{r['seq']}.part"
                    out = store.open_output_stream(temp)
                last = r["seq"]
                out.write(json.dumps(r).encode() + b"\n")
        if out is not None:
            out.close()
            store.move(temp, f"{path}/{first}-{last}.jsonl")  # a segment is there as a whole or not at all
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64())], ["first"])

    logs.select("seq", "request_id", "level", "step_name", "ms").repartitionByRange(many, "seq").sortWithinPartitions("seq").mapInArrow(run, "first long").write.format("noop").mode("overwrite").save()
