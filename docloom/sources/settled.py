"""A stream of the files of a folder, each taken once it has stopped changing.

The folder is one that the driver and all executors see under the same path. Its offset names every settled file with its size and the time of
its last change, so a file that changes later is taken again when it has settled, and a stream started again takes nothing twice.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FILES = "path string, modificationTime timestamp, length bigint, content binary"
#: Bytes and files of a partition.
PART_BYTES, PART_FILES = 64 << 20, 1000


def listing(folder: str) -> dict[str, tuple[int, int]]:
    """Size and time of the last change (of content, name or place; in nanoseconds) of each file below a folder; hidden ones are none."""
    found, folders = {}, [folder]
    while folders:
        with os.scandir(folders.pop()) as entries:
            for entry in entries:
                try:
                    if entry.name.startswith((".", "_")):
                        continue
                    if entry.is_dir():
                        folders.append(entry.path)
                    elif entry.is_file():
                        stat = entry.stat()
                        found[entry.path] = (stat.st_size, max(stat.st_mtime_ns, stat.st_ctime_ns))
                except FileNotFoundError:  # gone since it was listed
                    continue
    return found


def settled(now: dict[str, tuple[int, int]], before: dict[str, tuple[int, int]] | None, clock: float, seconds: float) -> dict[str, tuple[int, int]]:
    """Files that have not changed for so long, by their own times, nor since the listing before, if there was one (a clock may be wrong)."""
    return {p: f for p, f in now.items() if f[1] <= (clock - seconds) * 1e9 and (before is None or before.get(p) == f)}


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class SettledReader(DataSourceStreamReader):
    def __init__(self, folder: str, seconds: float):
        self.folder, self.seconds, self.before = folder, seconds, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """The settled files by one listing."""
        now = listing(self.folder)
        found = settled(now, self.before, time.time(), self.seconds)
        self.before = now
        return {p: list(f) for p, f in sorted(found.items())}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        out, held = [], 0
        for path, (size, changed) in sorted(end.items()):
            if start.get(path) == [size, changed]:
                continue
            if not out or held + size > PART_BYTES or len(out[-1].files) >= PART_FILES:
                out.append(Files([]))
                held = 0
            out[-1].files.append((path, size, changed))
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """A file that is gone, or has changed since it was seen, is left out: it is taken when it has settled again."""
        for path, size, changed in partition.files:
            try:
                with open(path, "rb") as file:
                    content = file.read()
                    stat = os.stat(path)
            except FileNotFoundError:
                continue
            if (len(content), max(stat.st_mtime_ns, stat.st_ctime_ns)) == (size, changed):
                columns = [[f"file:{path}"], [stat.st_mtime_ns // 1000], [size], [content]]
                types = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "modificationTime", "length", "content"])

    def commit(self, end: dict) -> None:
        pass


class SettledFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "settled"

    def schema(self) -> str:
        return FILES

    def streamReader(self, schema) -> SettledReader:  # noqa: N802
        return SettledReader(self.options["path"], float(self.options.get("seconds", 1.0)))


def watch_settled(spark: SparkSession, folder: str, seconds: float = 1.0) -> DataFrame:
    """A stream of files (path, modificationTime, length, content) under a folder that have not changed for so many seconds."""
    spark.dataSource.register(SettledFiles)
    return spark.readStream.format("settled").option("seconds", str(seconds)).load(folder.removeprefix("file://").removeprefix("file:"))
