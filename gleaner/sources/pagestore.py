"""Captured pages in files, as a Spark data source that reads only the files that a filter leaves.

    spark.dataSource.register(PageStore)
    spark.read.format("pagestore").load(folder).filter("day = DATE'2024-05-01' AND site = 'a'")

A folder holds day=YYYY-MM-DD/site=NAME/ with JSON lines of url and html. Filters on day and site are pushed to the listing; all others, and what is asked of url and html, stay with Spark. Small files are
put together in a partition, up to 32 MB. Spark pushes filters into Python sources only where spark.sql.python.filterPushdown.enabled is set; without, the same rows come of all files.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that no executor needs this package

SCHEMA = "url string, html string, day date, site string"
#: Bytes of files of a partition, and lines of a batch.
PART_BYTES, LINES = 32 << 20, 1000
#: The folder name of a null value, as Spark writes it.
NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class File:
    path: str
    size: int
    day: dt.date | None
    site: str | None


@dataclass(frozen=True)
class Files(InputPartition):
    files: tuple[File, ...]


def listed(folder: str) -> list[File]:
    """All files of a store, from the names of folders; what has other names is none of it."""
    fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    out = []
    for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
        parts = dict(p.split("=", 1) for p in f.path.split("/")[-3:-1] if "=" in p)
        if f.type == pafs.FileType.File and f.size and set(parts) == {"day", "site"} and not f.base_name.startswith(("_", ".")):
            day, site = (None if v == NULL else unquote(v) for v in (parts["day"], parts["site"]))
            out.append(File(f.path, f.size, dt.date.fromisoformat(day) if day else None, site))
    return sorted(out, key=lambda f: f.path)


def _test(f: Filter) -> Callable[[File], bool] | None:
    """A pushed filter as a test of a file, or None where it isn't one on day or site. A null value passes no comparison."""
    if not hasattr(f, "attribute") or f.attribute not in (("day",), ("site",)):
        return None
    get = lambda file: getattr(file, f.attribute[0])
    if isinstance(f, IsNull):
        return lambda file: get(file) is None
    if isinstance(f, IsNotNull):
        return lambda file: get(file) is not None
    if isinstance(f, EqualNullSafe):
        return lambda file: get(file) == f.value
    if isinstance(f, In):
        return lambda file: get(file) is not None and get(file) in f.value
    if isinstance(f, StringStartsWith):
        return lambda file: get(file) is not None and get(file).startswith(f.value)
    order = {EqualTo: lambda x: x == f.value, GreaterThan: lambda x: x > f.value, GreaterThanOrEqual: lambda x: x >= f.value, LessThan: lambda x: x < f.value, LessThanOrEqual: lambda x: x <= f.value}.get(type(f))
    return order and (lambda file: get(file) is not None and order(get(file)))


class PageReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder, self.tests = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> Sequence[InputPartition]:
        out, now, size = [], [], 0
        for f in listed(self.folder):
            if all(test(f) for test in self.tests):
                if now and size + f.size > PART_BYTES:
                    out.append(Files(tuple(now)))
                    now, size = [], 0
                now.append(f)
                size += f.size
        return [*out, Files(tuple(now))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("url", pa.string()), ("html", pa.string()), ("day", pa.date32()), ("site", pa.string())])
        fs = pafs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder or self.folder.startswith("file:") else pafs.LocalFileSystem()

        def batch(rows: list[dict], f: File) -> pa.RecordBatch:
            text = [[r.get(c) if isinstance(r.get(c), str) else None for r in rows] for c in ("url", "html")]
            return pa.RecordBatch.from_arrays([pa.array(text[0], pa.string()), pa.array(text[1], pa.string()), pa.array([f.day] * len(rows), pa.date32()), pa.array([f.site] * len(rows), pa.string())], schema=kind)

        for f in partition.files:
            rows: list[dict] = []
            with fs.open_input_stream(f.path) as raw:
                rest = b""
                while block := raw.read(1 << 20):
                    *lines, rest = (rest + block).split(b"\n")
                    rows += map(_row, filter(None, lines))
                    while len(rows) >= LINES:
                        yield batch(rows[:LINES], f)
                        del rows[:LINES]
                if rest.strip():
                    rows.append(_row(rest))
            if rows:
                yield batch(rows, f)


def _row(line: bytes) -> dict:
    """A line's object; a line that is none has null columns."""
    try:
        row = json.loads(line)
    except ValueError:
        return {}
    return row if isinstance(row, dict) else {}


class PageStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagestore"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options["path"])


def save(pages: DataFrame, folder: str) -> None:
    """Write pages (url, html, day, site) as a store. A null url or html is written as such."""
    pages.select("url", "html", "day", "site").write.partitionBy("day", "site").option("ignoreNullFields", "false").json(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """A store's pages in a session of its own, in which filters are pushed; the caller's session stays as it is.

    Load again for another query: Spark keeps the files that the first one's filters have left for all that is made of the same DataFrame."""
    session = spark.newSession()
    session.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    session.dataSource.register(PageStore)
    return session.read.format("pagestore").load(folder)
