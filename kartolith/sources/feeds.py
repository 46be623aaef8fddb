"""Sequence-numbered feeds as a Python data source: bounded reads by sequence ranges, streams by offsets.

A feed is a folder of files ``<sequence>.json`` with one JSON row a line.  Options: path, start_sequence,
end_sequence (exclusive), batch_size (sequences a micro-batch), partitions.  The driver lists the folder to find the end of a
run; tasks open the files of their range by number, a missing number is an empty sequence.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

COLUMNS = "sequence long, type string, id long, version long, minor_version long, visible boolean, lon double, lat double, timestamp string, changeset long, uid long"


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def _place(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def available(path: str) -> list[int]:
    files, folder = _place(path)
    names = (x.base_name for x in files.get_file_info(FileSelector(folder, allow_not_found=True)))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _rows(path: str, part: _Range, names: list[str]) -> Iterator[tuple]:
    files, folder = _place(path)
    for sequence in range(part.start, part.end):
        try:
            stream = files.open_input_stream(f"{folder}/{sequence}.json")
        except FileNotFoundError:
            continue
        with stream as f:
            for line in f.read().decode().split("\n"):
                if line.strip():
                    row = json.loads(line)
                    yield tuple(sequence if n == "sequence" else row.get(n) for n in names)


class _Common:
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.path = options["path"]
        have = available(self.path)
        self.first = int(options.get("start_sequence", have[0] if have else 0))
        self.last = int(options["end_sequence"]) if "end_sequence" in options else None
        self.batch = int(options.get("batch_size", 0))
        self.parts = int(options.get("partitions", 4))

    def split(self, start: int, end: int) -> list[_Range]:
        n = max(1, min(self.parts, end - start))
        cuts = [start + (end - start) * i // n for i in range(n + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:])]

    def end(self) -> int:
        have = available(self.path)
        end = have[-1] + 1 if have else self.first
        return min(end, self.last) if self.last is not None else end

    def read(self, partition: _Range) -> Iterator[tuple]:
        return _rows(self.path, partition, self.names)


class _Reader(_Common, DataSourceReader):
    def partitions(self):
        return self.split(self.first, max(self.first, self.end()))


class _Stream(_Common, DataSourceStreamReader):
    def __init__(self, schema, options):
        super().__init__(schema, options)
        self.at = None

    def initialOffset(self) -> dict:
        return {"sequence": self.first}

    def latestOffset(self) -> dict:
        end = max(self.first, self.end())
        if self.batch:
            self.at = min(end, (self.first if self.at is None else self.at) + self.batch)
            end = self.at
        return {"sequence": end}

    def partitions(self, start: dict, end: dict):
        self.at = max(self.at or 0, end["sequence"])
        return self.split(start["sequence"], end["sequence"])


def bounds(path: str, start: int | None = None, end: int | None = None, saved: int | None = None) -> tuple[int, int]:
    """[start, end) of a run: an explicit start, else after the saved checkpoint, else the feed's last; the end is inclusive as given."""
    have = available(path)
    current = have[-1] if have else 0
    first = start if start is not None else saved + 1 if saved is not None else current
    return first, (end if end is not None else current) + 1


class SequenceFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sequence_feed"

    def schema(self) -> str:
        return self.options.get("columns", COLUMNS)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SequenceFeed)


def write_feed(lines: DataFrame, path: str) -> None:
    """A feed of (sequence, line) rows: one file a sequence, written by the task that holds the sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _place(path)
        files.create_dir(folder, recursive=True)
        now, held = None, []

        def flush() -> None:
            if now is not None:
                with files.open_output_stream(f"{folder}/{now}.json") as f:
                    f.write("\n".join(held).encode())

        for batch in batches:
            for sequence, line in zip(batch.column("sequence").to_pylist(), batch.column("line").to_pylist()):
                if sequence != now:
                    flush()
                    now, held = sequence, []
                held.append(line)
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["n"])

    lines.select("sequence", "line").repartition("sequence").sortWithinPartitions("sequence", "line").mapInArrow(run, "n long").count()
