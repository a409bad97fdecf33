"""Elements of large JSON array documents as a data source (S3).

``json_elements`` gives each top-level element of ``[ ... ]`` as text, one row
each.  A document is streamed block by block (gzip or plain), so memory holds
one block and one element, whatever the size of the file.  Each file is one
task: a dump is landed once as Parquet (``ndjson.land_systems``) and read from
there.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 1 << 20
#: A whole string, or a bracket: all that decides where an element ends.
TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|[\[\]{},]', re.DOTALL)


def elements(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The texts of the top-level elements of one JSON array."""
    data, depth, start, at = b"", 0, 0, 0
    for block in blocks:
        data += block
        while True:
            token = TOKEN.search(data, at)
            # A quote that has no end yet: wait for more.
            quote = data.find(b'"', at, token.start() if token else len(data))
            if token is None or quote >= 0:
                if quote >= 0:
                    at = quote
                else:
                    at = len(data)
                break
            at, c = token.end(), token.group()[:1]
            if c in b"[{":
                depth += 1
                if depth == 1:
                    if c != b"[":
                        raise ValueError("the document is no JSON array")
                    start = at
            elif c in b"]}":
                depth -= 1
            if (c == b"," and depth == 1) or (c == b"]" and depth == 0):
                one = data[start : token.start()].strip()
                if one:
                    yield one
                data, at, start = data[at:], 0, 0
                if depth == 0:
                    return
    if data.strip() or depth:
        raise ValueError("the JSON array has no end")


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def _store(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def partitions(self) -> list[File]:
        from pyarrow import fs

        store, root = self._store()
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [File(root)]
        return [File(i.path) for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        with store.open_input_file(partition.path) as raw:
            f = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw
            held, size = [], 0
            for one in elements(iter(lambda: f.read(BLOCK), b"")):
                held.append(one.decode("utf-8", "replace"))
                size += len(one)
                if size > BLOCK * 8 or len(held) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])


class JsonElements(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the elements of the array document(s) at ``path``."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(JsonElements)
    return spark.read.format("json_elements").load(path)
