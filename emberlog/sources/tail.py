"""A rotating log as a stream (``log_tail``): the lines of a folder's files, in the order of their names.

The last file may grow; a file is closed once a later one exists, and new names have to sort behind those already
read (a file that arrives before them, or one that shrinks, is an error, not a loss). The offset is one place: file,
byte, and how many files lie up to it. A batch takes ``most_records`` lines, counted while planning, or about
``most_bytes`` bytes, and is read in pieces of ``piece`` bytes by as many tasks; a batch of fewer pieces than ``tasks``
is cut into as many (of LEAST_PIECE bytes at least), as each task parses what it reads. A line that isn't finished
waits for its end, unless its file is closed. After each batch the engine commits, and the place up to which all is stored is
written to ``position``, so that the log's owner knows what may go.

Options: path (a folder, or the URI of one that driver and executors reach), pattern, most_records, most_bytes, piece, tasks, position.
Compressed files are skipped: those are copies that the rotation made.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LONGEST_LINE = 1 << 20
CHUNK = 1 << 20
LEAST_PIECE = 64 << 10
PACKED = (".gz", ".bz2", ".xz", ".zst", ".lz4")


@dataclass
class Piece(InputPartition):
    """Bytes begin to end of a file; ``whole`` is the end of the batch's part of it, where a line ends."""

    file: str
    start: int
    begin: int
    end: int
    whole: int


def opened(path: str):
    """(file system, path below it) of a folder's path or URI."""
    from pyarrow import fs

    if path.startswith("file:/"):  # Hadoop writes it with one slash or three
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def after_lines(f, at: int, size: int, closed: bool, most: int) -> tuple[int, int]:
    """(byte behind the ``most``-th line from ``at``, lines passed)."""
    import numpy as np

    end, lines, pos = at, 0, at
    while pos < size:
        data = f.read_at(min(CHUNK, size - pos), pos)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        if lines + len(ends) >= most:
            return pos + int(ends[most - lines - 1]) + 1, most
        lines, pos = lines + len(ends), pos + len(data)
        end = pos - len(data) + int(ends[-1]) + 1 if len(ends) else end
    return (size, lines + 1) if closed and end < size else (end, lines)


def after_bytes(f, at: int, size: int, closed: bool, most: int) -> int:
    """The last line end within ``most`` bytes of ``at``; of a line longer than that, its end."""
    stop = min(size, at + most)
    if stop == size and closed:
        return size
    pos = stop
    while pos > at:
        low = max(at, pos - CHUNK)
        found = f.read_at(pos - low, low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        pos = low
    while stop < size:
        data = f.read_at(min(CHUNK, size - stop), stop)
        if (found := data.find(b"\n")) >= 0:
            return stop + found + 1
        stop += len(data)
    return size if closed else at


def lines_of(f, p: Piece) -> Iterator[bytes]:
    """Lines that begin in the piece; the last one is followed beyond it, as far as a line is kept at all."""
    begin = p.begin
    if begin > p.start and f.read_at(1, begin - 1) != b"\n":
        begin = after_bytes(f, begin, p.whole, True, 1) if b"\n" not in (head := f.read_at(p.end - begin, begin)) else begin + head.index(b"\n") + 1
    if begin >= p.end:
        return
    data = f.read_at(p.end - begin, begin)
    if not data.endswith(b"\n"):
        more = f.read_at(min(4 * LONGEST_LINE + 4, p.whole - p.end), p.end)
        data += more.split(b"\n", 1)[0]
    yield from data.removesuffix(b"\n").split(b"\n")


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.pattern, self.position = o["path"].rstrip("/"), o.get("pattern", "*"), o.get("position")
        self.records = int(o["most_records"]) if o.get("most_records") else None
        self.bytes, self.piece = int(o.get("most_bytes", 64 << 20)), int(o.get("piece", 8 << 20))
        self.tasks = int(o.get("tasks", 1))
        if min(self.records or 1, self.bytes, self.piece, self.tasks) < 1:
            raise ValueError("limits of a batch have to be positive")
        self.at: dict | None = None

    def files(self) -> list[tuple[str, int]]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = opened(self.path)
        found = [(i.base_name, i.size) for i in fs.get_file_info(FileSelector(root)) if i.type == FileType.File]
        return sorted((n, s) for n, s in found if fnmatch.fnmatch(n, self.pattern) and not n.startswith(("_", ".")) and not n.endswith(PACKED))

    def initialOffset(self) -> dict:
        return {"file": "", "at": 0, "seen": 0}

    def latestOffset(self) -> dict:
        self.at = self.advance(self.at or self.initialOffset())
        return self.at

    def advance(self, start: dict) -> dict:
        """The place where a batch from ``start`` ends."""
        files = self.files()
        if sum(n <= start["file"] for n, _ in files) > start["seen"]:
            raise ValueError(f"a file arrived in {self.path} that sorts before {start['file']}, which has been read")
        fs, root = opened(self.path)
        file, at, lines, size_left = start["file"], start["at"], self.records, self.bytes
        for k, (name, size) in enumerate(files):
            if name < file:
                continue
            at = at if name == file else 0
            if size < at:
                raise ValueError(f"{name} has {size} bytes, but {at} were read")
            file, closed = name, k + 1 < len(files)
            with fs.open_input_file(f"{root}/{name}") as f:
                if lines is None:
                    end = after_bytes(f, at, size, closed, size_left)
                    size_left -= end - at
                else:
                    end, n = after_lines(f, at, size, closed, lines)
                    lines -= n
            at = end
            if end < size or lines == 0 or size_left <= 0:
                break
        return {"file": file, "at": at, "seen": sum(n <= file for n, _ in files)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if self.at is None:  # after a restart the last batch is planned again before anything else
            self.at = end
        parts = []
        for name, size in self.files():
            if start["file"] <= name <= end["file"]:
                first = start["at"] if name == start["file"] else 0
                last = end["at"] if name == end["file"] else size
                if size < last:
                    raise ValueError(f"{name} has {size} bytes, but {last} were read")
                parts.append((name, first, last))
        share = -(-sum(last - first for _, first, last in parts) // self.tasks)
        piece = min(self.piece, max(share, LEAST_PIECE))
        return [Piece(name, first, a, min(last, a + piece), last) for name, first, last in parts for a in range(first, last, piece)]

    def read(self, partition: Piece):
        import pyarrow as pa

        fs, root = opened(self.path)
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            texts = [b.removesuffix(b"\r").decode("utf-8", "replace") for b in lines_of(f, partition)]
        texts = [t for t in texts if t.strip()]
        if texts:
            long = [len(t) > LONGEST_LINE for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([t[:LONGEST_LINE] for t in texts], pa.string()), pa.array([partition.file] * len(texts), pa.string()), pa.array(long, pa.bool_())], names=["value", "source", "too_long"])

    def commit(self, end: dict) -> None:
        if self.position:
            fs, path = opened(self.position)
            with fs.open_output_stream(f"{path}.next") as f:
                f.write(json.dumps(end).encode())
            fs.move(f"{path}.next", path)


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "value string, source string, too_long boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(LogTail)
