"""A data source of logs that grow: lines appended to known files arrive once, whatever restarts lie between.

The offset is {file: bytes read}. A file is known by its identity, not its name: by its first line
and, on a local or mounted folder, its inode. So a renamed file goes on where it was, a new file
under an old name starts at its beginning, and so does a file that was cut and written anew. Only
whole lines are taken; one still being written waits for its end.

Byte ranges are cut into partitions, so a large file is read by many tasks. What cannot be read is a
row too: `error` says why and `value` is null. Other files are not held up by it.
"""

from __future__ import annotations

import fnmatch
import gzip
import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file string, pos long, error string"
_ARROW = pa.schema([("value", pa.string()), ("file", pa.string()), ("pos", pa.int64()), ("error", pa.string())])
PARTITION_BYTES = 64 << 20
CHUNK = 4 << 20
HEAD = 4096  # bytes in which a first line has to end to tell files apart by it


@dataclass(frozen=True)
class Piece(InputPartition):
    """Lines of `path` that start in [start, stop); `low` and `high` bound what may be read. An error has no range."""

    path: str
    start: int = 0
    stop: int = 0
    low: int = 0
    high: int = 0
    error: str | None = None
    packed: bool = False


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    error: str | None = None


def _open(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder and the folder's place in it."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))


def _files(system: arrow_fs.FileSystem, folder: str, glob: str, packed: bool) -> list[Found]:
    """Files of the folder and below; hidden names and, unless asked for, compressed ones are left out."""
    try:
        infos = system.get_file_info(arrow_fs.FileSelector(folder, recursive=True))
    except OSError as error:
        return [Found(folder, 0, f"cannot list: {error}")]
    out = []
    for info in sorted(infos, key=lambda i: i.path):
        name = info.base_name
        hidden = any(part.startswith((".", "_")) for part in info.path[len(folder):].strip("/").split("/"))
        if hidden or not fnmatch.fnmatch(name, glob) or (name.endswith(".gz") and not packed):
            continue
        if info.type == arrow_fs.FileType.File:
            out.append(Found(info.path, info.size))
        elif info.type != arrow_fs.FileType.Directory:
            out.append(Found(info.path, 0, "cannot read: no such file"))
    return out


def _whole_lines(system: arrow_fs.FileSystem, found: Found) -> tuple[str | None, int]:
    """Identity of a file (None before its first line is whole) and the end of its last whole line."""
    with system.open_input_file(found.path) as f:
        # What is appended from here on waits for the next look.
        size = found.size
        head = f.read_at(min(HEAD, size), 0)
        cut = head.find(b"\n")
        if cut < 0 and size < HEAD:
            return None, 0
        end = size
        while end > 0:
            step = min(1 << 16, end)
            at = f.read_at(step, end - step).rfind(b"\n")
            if at >= 0:
                end = end - step + at + 1
                break
            end -= step
    first = hashlib.sha256(head[: cut if cut >= 0 else HEAD]).hexdigest()[:24]
    place = str(os.stat(found.path).st_ino) if isinstance(system, arrow_fs.LocalFileSystem) else found.path
    return f"{first}:{place}", end


def _pieces(path: str, start: int, end: int, size: int) -> list[Piece]:
    return [Piece(path, at, min(at + size, end), start, end) for at in range(start, end, size)]


def _batches(rows: Iterator[tuple[str | None, str, int, str | None]], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _chunks(f, at: int, end: int) -> Iterator[bytes]:
    while at < end:
        data = f.read_at(min(CHUNK, end - at), at)
        if not data:
            raise OSError(f"ends at byte {at}, before byte {end}")
        at += len(data)
        yield data


def _unpacked(f) -> Iterator[bytes]:
    with gzip.open(f) as content:
        # What was unpacked before the damage counts, so no read may wait for more than one block.
        while data := content.read1(CHUNK):
            yield data


def _split(chunks: Iterator[bytes], at: int, stop: int | None, skip: bool) -> Iterator[tuple[int, bytes]]:
    """(place, line) of every line that starts before `stop`; with `skip`, after the first line end."""
    rest = b""
    for data in chunks:
        data = rest + data
        lines = data.split(b"\n")
        rest = lines.pop()
        for line in lines:
            if skip:
                skip = False
            elif stop is not None and at >= stop:
                return
            else:
                yield at, line
            at += len(line) + 1
    if rest and not skip and (stop is None or at < stop):
        yield at, rest


def read_piece(system: arrow_fs.FileSystem, piece: Piece) -> Iterator[tuple[str | None, str, int, str | None]]:
    """Rows of a piece: its lines, a row for every line with bytes that are no text, and one for what ends the reading."""
    if piece.error is not None:
        yield None, piece.path, 0, piece.error
        return
    at = piece.start
    try:
        with system.open_input_file(piece.path) as f:
            if piece.packed:
                lines = _split(_unpacked(f), 0, None, False)
            elif piece.start > piece.low:
                lines = _split(_chunks(f, piece.start - 1, piece.high), piece.start - 1, piece.stop, True)
            else:
                lines = _split(_chunks(f, piece.start, piece.high), piece.start, piece.stop, False)
            for at, line in lines:
                try:
                    text, bad = line.decode(), False
                except UnicodeDecodeError:
                    text, bad = line.decode("utf-8", "replace"), True
                # A return inside a line ends a line, as in text files of any system.
                for part in (text[:-1] if text.endswith("\r") else text).split("\r"):
                    yield part, piece.path, at, None
                if bad:
                    yield None, piece.path, at, "bytes that are no UTF-8"
    except (OSError, EOFError, zlib.error) as error:
        yield None, piece.path, at, f"cannot read: {error}"


class _Options:
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.glob = options.get("glob", "*")
        self.packed = options.get("compressed", "false").lower() == "true"
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.from_end = options.get("start", "begin") == "end"
        self.errors_only = options.get("errorsOnly", "false").lower() == "true"

    def listed(self) -> tuple[arrow_fs.FileSystem, list[Found]]:
        try:
            system, folder = _open(self.folder)
        except (OSError, pa.ArrowInvalid) as error:
            return arrow_fs.LocalFileSystem(), [Found(self.folder, 0, f"cannot list: {error}")]
        return system, _files(system, folder, self.glob, self.packed)


    def rows(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.path:
            rows = read_piece(_open(self.folder)[0] if piece.error is None else None, piece)
            yield from _batches(row for row in rows if row[3] is not None or not self.errors_only)


class _Batch(DataSourceReader):
    """All lines there are, the last one whole or not."""

    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Piece]:
        out = []
        for found in self.options.listed()[1]:
            if found.error:
                out.append(Piece(found.path, error=found.error))
            elif found.path.endswith(".gz"):
                out.append(Piece(found.path, high=found.size, packed=True))
            else:
                out += _pieces(found.path, 0, found.size, self.options.size)
        return out or [Piece("", high=0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from self.options.rows(partition)


class _Tail(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.options = options

    def _now(self) -> dict[str, list]:
        """{identity: [path, bytes]}; what cannot be read is known by its path and has no bytes."""
        system, files = self.options.listed()
        out: dict[str, list] = {}
        for found in files:
            try:
                if found.error:
                    raise OSError(found.error)
                if found.path.endswith(".gz"):
                    out[f"gz:{found.path}:{found.size}"] = [found.path, found.size]
                    continue
                identity, end = _whole_lines(system, found)
                if identity is not None:
                    out[identity] = [found.path, end]
            except OSError as error:
                out[f"error:{found.path}"] = [found.path, -1, str(error)]
        return out

    def initialOffset(self) -> dict:
        return {"files": json.dumps(self._now() if self.options.from_end else {})}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self._now())}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, out = json.loads(start["files"]), []
        for identity, (path, stop, *why) in json.loads(end["files"]).items():
            have = before.get(identity, [path, 0])[1]
            if stop < 0:
                if identity not in before:
                    out.append(Piece(path, error=why[0]))
            elif identity.startswith("gz:"):
                if identity not in before:
                    out.append(Piece(path, high=stop, packed=True))
            else:
                # Fewer bytes than were read: cut and begun anew with the same line.
                out += _pieces(path, have if have <= stop else 0, stop, self.options.size)
        return out or [Piece("")]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from self.options.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint holds the position."""


class GrowingLogs(DataSource):
    """`value`, `file`, `pos` (byte where the line starts) and `error` of the files below `path`.

    Options: glob (file names), start (begin, or end: only what is appended or new after the first
    start of the stream), compressed (also read .gz files, whole), errorsOnly, partitionBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(_Options(self.options))


def register(spark: SparkSession) -> str:
    """Make the source known to the session; returns its name."""
    spark.dataSource.register(GrowingLogs)
    return GrowingLogs.name()
