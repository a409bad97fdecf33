"""Growing line files as a data source (S7, S8, T1): each line is read once.

``growing_lines`` is a Python data source.  Its offset is, per file, how many
bytes have been read, so a stream reads what was appended since its last batch,
and a batch read gives all lines.  Spark keeps the offsets in the stream's
checkpoint; no table of our own is needed.

* A line counts once it ends with a line feed.  The rest of a file that has
  not changed for ``settleSeconds`` counts too.
* A file may be compressed after it was read (``x.jsonl`` -> ``x.jsonl.gz``):
  offsets are in uncompressed bytes and the name's ``.gz`` is left out, so only
  what is new is read.  A compressed file may grow by being written anew.
* Plain files are read in parallel parts of ``splitBytes``; a compressed file is
  one part.  A part is streamed, so memory holds one block and one line.
* A file that is shorter than what was read of it has been replaced: an error.

Files are listed and opened with ``pyarrow.fs`` (local paths and the object
stores and HDFS that it knows), on the driver for names and sizes only.

Rows: ``path``, ``file`` (name), ``at`` (place of the line's first byte in the
uncompressed file), ``value``.
"""

from __future__ import annotations

import fnmatch
import gzip
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, file string, at bigint, value string"
BLOCK = 1 << 20


class Part(InputPartition):
    """Lines that start in [start, stop) of a file whose lines are read from ``first`` to ``end``."""

    def __init__(self, path: str, start: int, stop: int, first: int, end: int, size: int):
        self.path, self.start, self.stop, self.first, self.end, self.size = path, start, stop, first, end, size


def _open_store(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _complete(store, info, settle: float) -> int:
    """How many bytes of a plain file are whole lines."""
    if not info.size or time.time() - info.mtime.timestamp() > settle:
        return info.size
    with store.open_input_file(info.path) as f:
        at = info.size
        while at > 0:
            start = max(0, at - BLOCK // 16)
            f.seek(start)
            k = f.read(at - start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            at = start
    return 0


def _unpacked_size(store, info) -> int:
    """The size that a gzip file's last four bytes tell (one member, below 4 GiB)."""
    with store.open_input_file(info.path) as f:
        f.seek(max(0, info.size - 4))
        return int.from_bytes(f.read(4), "little")


class _Files:
    def __init__(self, options: dict):
        self.root = options["path"]
        self.glob = options.get("glob", "*.jsonl*")
        self.split = int(options.get("splitBytes", 64 << 20))
        self.settle = float(options.get("settleSeconds", 3600))

    def offsets(self) -> dict:
        """``{name: [bytes, size of the file]}`` of all files there are now."""
        from pyarrow import fs

        store, root = _open_store(self.root)
        out: dict = {}
        for info in sorted(store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File or not fnmatch.fnmatch(info.base_name, self.glob):
                continue
            name = info.path[len(root) :].lstrip("/")
            if name.endswith(".gz"):  # a plain file of the same name sorts first and wins
                if name[:-3] not in out:
                    out[name[:-3]] = [_unpacked_size(store, info), info.size]
            else:
                out[name] = [_complete(store, info, self.settle), info.size]
        return out

    def parts(self, start: dict, end: dict) -> list[Part]:
        from pyarrow import fs

        store, root = _open_store(self.root)
        out = []
        for name, (stop, size) in sorted(end.items()):
            first = start.get(name, [0])[0]
            if stop < first:
                raise ValueError(f"{name} has {stop} bytes, {first} were read: the file was replaced")
            if stop == first:
                continue
            path = f"{root.rstrip('/')}/{name}"
            packed = store.get_file_info(path).type != fs.FileType.File
            step = stop - first if packed else self.split
            out += [Part(path + ".gz" * packed, a, min(a + step, stop), first, stop, size) for a in range(first, stop, step)]
        return out

    def rows(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file at all
            return
        store, _ = _open_store(self.root)
        packed = part.path.endswith(".gz")
        name = part.path.rsplit("/", 1)[-1]
        at, values, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part.path] * len(at)), pa.array([name] * len(at)), pa.array(at, pa.int64()), pa.array(values, pa.string())],
                ["path", "file", "at", "value"])

        with store.open_input_file(part.path) as raw:
            f = gzip.GzipFile(fileobj=raw) if packed else raw
            for place, line in _lines(f, part):
                at.append(place)
                values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                held += len(line)
                if held > BLOCK * 8 or len(at) >= 10_000:
                    yield batch()
                    at, values, held = [], [], 0
            if packed and raw.size() == part.size and f.read(1):
                raise ValueError(f"{part.path} has several members or 4 GiB: land it uncompressed")
        if at:
            yield batch()


def _lines(f, part: Part) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that start in the part."""
    at = part.start
    f.seek(at)
    if part.start != part.first:  # the line that begins before this part belongs to the one before
        f.seek(at - 1)
        at -= 1
        while True:
            data = f.read(min(BLOCK, part.end - at))
            if not data:
                return
            k = data.find(b"\n")
            at += len(data) if k < 0 else k + 1
            if k >= 0:
                break
        f.seek(at)
    rest, read = [], at
    while at < part.stop:
        data = f.read(min(BLOCK, part.end - read))
        if not data:
            if read < part.end:
                raise ValueError(f"{part.path} ends at {read}, {part.end} bytes were promised")
            break
        read += len(data)
        lines = data.split(b"\n")
        lines[0] = b"".join([*rest, lines[0]]) if len(lines) > 1 else lines[0]
        rest = [lines.pop()] if len(lines) > 1 else [*rest, lines.pop()]
        for line in lines:
            if at >= part.stop:
                return
            yield at, line
            at += len(line) + 1
    if at < part.stop and any(rest):
        yield at, b"".join(rest)  # a settled file's last line


class _Batch(DataSourceReader):
    def __init__(self, files: _Files):
        self.files = files

    def partitions(self) -> list[Part]:
        return self.files.parts({}, self.files.offsets())

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, files: _Files):
        self.files = files

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.files.offsets()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.files.parts(start, end)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Files(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Files(self.options))


def _prepared(spark: SparkSession) -> SparkSession:
    import sys

    from pyspark import cloudpickle

    # The source's code travels with it, so that Python workers need no copy of this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(GrowingLines)
    return spark


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    """All whole lines under ``folder``."""
    return _prepared(spark).read.format("growing_lines").options(**options).load(folder)


def read_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of the lines that are appended under ``folder``."""
    return _prepared(spark).readStream.format("growing_lines").options(**options).load(folder)
