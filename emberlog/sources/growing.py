"""Files that grow while they are read, as a streaming source.

The offset of the stream is a place in every file. Named files are followed from their last
line break on, files of a watched folder from their first byte. A line counts once it is ended; what is behind the last line break is held back. A file that has become
shorter, or whose first bytes have changed, is a new file under an old name and is read from its start. (A file that is
emptied and grows beyond its old length with the same first bytes between two batches can't be told from one that grew.)

Ranges are cut into pieces of ``splitBytes`` that tasks read on their own: a piece holds the lines that begin in it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_files"
SUFFIXES = (".log", ".txt", ".json")
SCHEMA = "log_file string, position bigint, value string"
#: Bytes at the start of a file that tell it from another one.
HEAD = 256
STEP = 1 << 16
BATCH_LINES = 8192


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def size_of(path: str) -> int | None:
    """Bytes of a file, or None if there is none."""
    system, inside = opened(path)
    info = system.get_file_info(inside)
    return info.size if info.type == fs.FileType.File else None


def listed(folder: str) -> list[str]:
    """The log files right inside a folder, as addresses like the folder's."""
    system, inside = opened(folder)
    found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
    return sorted(f"{folder.rstrip('/')}/{f.base_name}" for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(SUFFIXES))


def head_of(path: str, length: int) -> int:
    system, inside = opened(path)
    with system.open_input_file(inside) as file:
        return zlib.crc32(file.read(length))


def last_line_end(path: str, low: int, high: int) -> int:
    """The place after the last line break in a range of a file; ``low`` if there is none."""
    system, inside = opened(path)
    with system.open_input_file(inside) as file:
        while high > low:
            begin = max(low, high - STEP)
            file.seek(begin)
            at = file.read(high - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            high = begin
    return low


def next_line_end(path: str, low: int, high: int) -> int | None:
    """The place after the first line break in a range of a file."""
    system, inside = opened(path)
    with system.open_input_file(inside) as file:
        while low < high:
            file.seek(low)
            data = file.read(min(STEP, high - low))
            if (at := data.find(b"\n")) >= 0:
                return low + at + 1
            low += len(data)
    return None


class Piece(InputPartition):
    """Lines of a file that begin in a range; ``whole`` says that a line begins at its start."""

    def __init__(self, path: str, begin: int, end: int, whole: bool):
        self.path, self.begin, self.end, self.whole = path, begin, end, whole


def lines_of(piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of each line that begins in the piece; the last one is read to its end."""
    system, inside = opened(piece.path)
    with system.open_input_file(inside) as file:
        at = piece.begin if piece.whole else piece.begin - 1
        file.seek(at)
        rest, skip = b"", not piece.whole
        while True:
            data = file.read(STEP)
            rest += data
            begin = 0
            while (end := rest.find(b"\n", begin)) >= 0:
                if not skip:
                    if at + begin >= piece.end:
                        return
                    yield at + begin, rest[begin:end]
                skip, begin = False, end + 1
            at, rest = at + begin, rest[begin:]
            if not data or not skip and at >= piece.end:
                return


class GrowingFilesReader(DataSourceStreamReader):
    """Offsets are {file: {"place", "head", "length"}}: how far it is read, and what its first bytes were."""

    def __init__(self, options: dict):
        given = {name.lower(): value for name, value in options.items()}
        self.paths = json.loads(given["paths"])
        self.per_trigger = int(given.get("bytespertrigger", 0))
        self.split = int(given.get("splitbytes", 32 << 20))
        self.seen: dict[str, dict] | None = None

    def _mark(self, path: str, place: int) -> dict:
        length = min(place, HEAD)
        return {"place": place, "head": head_of(path, length) if length else 0, "length": length}

    @staticmethod
    def _same(path: str, mark: dict, size: int) -> bool:
        """Whether the file still begins with what was read."""
        return size >= mark["place"] and (not mark["length"] or head_of(path, mark["length"]) == mark["head"])

    def initialOffset(self) -> dict:
        self.seen = {path: self._mark(path, last_line_end(path, 0, size)) for path in self.paths if (size := size_of(path)) is not None}
        return self.seen

    def _files(self) -> list[str]:
        return sorted({*(p for p in self.paths if size_of(p) is not None), *(f for p in self.paths if size_of(p) is None for f in listed(p))})

    def latestOffset(self) -> dict:
        """The ends of the last whole lines. After a restart the place reached before is Spark's to know, so the limit of
        bytes starts with the second batch; a batch of any size is read in pieces."""
        known, limit = self.seen or {}, self.per_trigger if self.seen is not None else 0
        latest = dict(known)
        for path in self._files():
            size, mark = size_of(path), known.get(path)
            if size is None:
                continue
            start = mark["place"] if mark and self._same(path, mark, size) else 0
            end = last_line_end(path, start, min(size, start + limit) if limit else size)
            if limit and end == start and size > start + limit:  # a line longer than the limit
                end = next_line_end(path, end + limit, size) or start
            if end != (mark or {}).get("place", 0) or mark and not self._same(path, mark, size):
                latest[path] = self._mark(path, end)
        self.seen = latest
        return latest

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.seen = end
        pieces = []
        for path, mark in sorted(end.items()):
            before, size = start.get(path), size_of(path)
            if size is None or before == mark:
                continue
            begin = before["place"] if before and self._same(path, before, size) else 0
            for low in range(begin, mark["place"], self.split):
                pieces.append(Piece(path, low, min(low + self.split, mark["place"]), low == begin))
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, str]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["log_file", "position", "value"])

        for place, data in lines_of(partition):
            for part in re.split(rb"\r", data):  # a lone return ends a line too
                held.append((partition.path, place, part.decode("utf-8", errors="ignore")))
                place += len(part) + 1
            if len(held) >= BATCH_LINES:
                yield batch()
                held.clear()
        if held:
            yield batch()


class GrowingFiles(DataSource):
    """``spark.readStream.format("growing_files")``; option ``paths``: a JSON list of files and folders."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingFilesReader:
        return GrowingFilesReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(GrowingFiles)
