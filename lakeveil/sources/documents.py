"""Folders of files as a Spark data source: ``spark.read.format("documents")``, and the same for streams.

The driver lists names and sizes and deals the files over partitions by bytes;
tasks open their own files. Filters on extension, size, name and time of change
that the query has are applied to the listing, so other files are never
opened; without ``content`` and ``text`` in the query none is. Any store that
pyarrow's file systems reach will do (``file://``, ``s3://``, ``hdfs://``).
"""

from __future__ import annotations

import datetime
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

import lakeveil

from . import files as F

cloudpickle.register_pickle_by_value(lakeveil)  # tasks need no copy of this package

COLUMNS = {"path": pa.string(), "name": pa.string(), "extension": pa.string(), "size": pa.int64(), "modified": pa.timestamp("us", "UTC"), "text": pa.string(), "content": pa.binary()}
SCHEMA = "path string, name string, extension string, size bigint, modified timestamp, text string, content binary"
TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
PUSHED = ("name", "extension", "size", "modified")
ROWS = 64


class Files(InputPartition):
    def __init__(self, rows: list[dict], prefix: str):
        super().__init__(None)
        self.rows, self.prefix = rows, prefix


def listed(options: dict) -> tuple[list[dict], str]:
    """The files below a folder that have a wanted extension, no excluded part in their path and no more than the wanted MB, by path; and the scheme of their store."""
    url = options["path"]
    fs, root = pyarrow.fs.FileSystem.from_uri(url)
    prefix = url[: len(url) - len(root.rstrip("/"))] if url.rstrip("/").endswith(root.rstrip("/")) else "file://"
    kinds = {k.strip().lower() for k in options.get("extensions", ",".join([*F.TEXT_TYPES, "rtf", "docx", "xlsx", "pdf"])).split(",")}
    excluded = [x for x in options.get("excluded", ",".join(F.EXCLUDED)).lower().split(",") if x]
    most = float(options.get("max_mb", 50)) * 1024 * 1024
    out = []
    for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)):
        name = f.base_name
        extension = name.rsplit(".", 1)[1].lower() if "." in name else ""
        below = f.path[len(root.rstrip("/")) :].lower()
        if f.type == pyarrow.fs.FileType.File and extension in kinds and f.size <= most and not any(x in below for x in excluded):
            out.append({"path": f.path, "name": name, "extension": extension, "size": f.size, "modified": f.mtime})
    return sorted(out, key=lambda r: r["path"]), prefix


def text_of(extension: str, content: bytes) -> str:
    """By extension; what can't be read as its own kind, as text; at most as many characters as ``read_any`` takes."""
    import re

    out = None
    try:
        if extension in ("docx", "xlsx"):
            out = (F.docx_text if extension == "docx" else F.xlsx_text)(content)
        elif extension == "pdf":
            out = F.pdf_text(content)
    except Exception:  # a damaged file, or no library: read as text, as others of the folder go on
        out = None
    if out is None:
        out = content.decode("utf-8", "replace")
        if extension == "rtf":
            out = re.sub(r"[{}]", "", re.sub(r"\\[a-z]+-?\d*\s?", "", out)).strip(" ")
    return out[: F.MOST_CHARS]


def batches(rows: list[dict], options: dict, prefix: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    fs, _ = pyarrow.fs.FileSystem.from_uri(options["path"])
    for at in range(0, len(rows), ROWS):
        some = [dict(r) for r in rows[at : at + ROWS]]
        for r in some:
            if {"text", "content"} & set(columns):
                try:
                    with fs.open_input_stream(r["path"]) as f:
                        r["content"] = f.read()
                    r["text"] = text_of(r["extension"], r["content"])
                except OSError:  # gone or closed since it was listed: a row without text
                    r["content"] = r["text"] = None
            r["path"] = prefix + r["path"]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in some], COLUMNS[c]) for c in columns], columns)


def dealt(rows: list[dict], prefix: str, options: dict) -> list[InputPartition]:
    """Files over partitions, by bytes and number."""
    most, files, out, mass = int(options.get("partition_mb", 64)) * 1024 * 1024, int(options.get("partition_files", 2000)), [[]], 0
    for r in rows:
        if out[-1] and (mass + r["size"] > most or len(out[-1]) >= files):
            out.append([])
            mass = 0
        out[-1].append(r)
        mass += r["size"]
    return [Files(part, prefix) for part in out]


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.columns, self.filters = options, schema.fieldNames(), []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.filters.append((type(f).__name__, f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        rows, prefix = listed(self.options)
        tests = {t.__name__: test for t, test in TESTS.items()}
        for kind, column, value in self.filters:
            value = value.astimezone(datetime.UTC) if isinstance(value, datetime.datetime) else value
            rows = [r for r in rows if tests[kind](r[column], value)]
        return dealt(rows, prefix, self.options)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from batches(partition.rows, self.options, partition.prefix, self.columns)


class StreamReader(DataSourceStreamReader):
    """Files by the time of their last change; a changed file comes again. An offset is the last time seen and the paths that had it."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.columns = options, schema.fieldNames()

    def _timed(self) -> tuple[list[tuple[int, dict]], str]:
        rows, prefix = listed(self.options)
        return sorted(((int(r["modified"].timestamp() * 1_000_000), r) for r in rows), key=lambda x: (x[0], x[1]["path"])), prefix

    def initialOffset(self) -> dict:
        return {"time": 0, "paths": []}

    def latestOffset(self) -> dict:
        rows, _ = self._timed()
        last = rows[-1][0] if rows else 0
        return {"time": last, "paths": [r["path"] for t, r in rows if t == last]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows, prefix = self._timed()
        after = lambda t, r: t > start["time"] or (t == start["time"] and r["path"] not in start["paths"])
        upto = lambda t, r: t < end["time"] or (t == end["time"] and r["path"] in end["paths"])
        return dealt([r for t, r in rows if after(t, r) and upto(t, r)], prefix, self.options)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from batches(partition.rows, self.options, partition.prefix, self.columns)

    def commit(self, end: dict) -> None:
        pass


class Documents(DataSource):
    """Options: path, extensions and excluded (comma-separated), max_mb, partition_mb, partition_files."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets its filters be pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)


def write_files(docs, folder: str, name_col: str = "name", text_col: str = "text"):
    """Writes each row's text to a file of its own below the folder (tasks write, by path, so a task that runs again writes the same); returns name and size."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        made = set()
        for b in parts:
            sizes = []
            for name, text in zip(b.column("name").to_pylist(), b.column("text").to_pylist(), strict=True):
                path = posixpath.join(root, name.lstrip("/"))
                if (home := posixpath.dirname(path)) not in made:
                    fs.create_dir(home, recursive=True)
                    made.add(home)
                data = (text or "").encode("utf-8", "replace")
                with fs.open_output_stream(path) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(sizes, pa.int64())], ["name", "size"])

    return docs.selectExpr(f"`{name_col}` as name", f"`{text_col}` as text").mapInArrow(run, "name string, size bigint")
