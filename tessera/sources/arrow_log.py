"""A connector for tables of Arrow files with a log of commits: spark.read/write/readStream/writeStream.format("arrow_log").

Tasks write Arrow files of bounded size, each under a name of its own, with the bounds of its columns.  Nothing of that is seen until the
driver adds one small file to the log, which names them: a commit, and a version of the table.  A write that fails or whose
driver dies adds none, and what its tasks left is deleted by abort, or by the next commit's writer with the same id.

- Batch reads plan partitions from the log: files are left out by their bounds, and the others are grouped by bytes.  Option `version`
  reads an earlier version.  Conditions on whole numbers, strings, booleans, dates and times without zone leave out files and are
  applied to Arrow batches before they reach the JVM.  scan() takes them as values.  Option `pushdown` takes them from the query's own
  filters; Spark 4.1 keeps what one query has pushed in the DataFrame that was loaded, and a second query of that DataFrame
  without such filters would then miss rows, so it is off by default: switch it on where a loaded DataFrame serves one query.
- Streams read versions as offsets, so a restart continues behind the last version that was committed.
- Streaming writes note the stream's name and batch in the commit; a batch that is run again after a failure is not added twice.

Folders are given as paths or URIs that pyarrow.fs knows.  Commits to one table by several drivers at once are safe on local and shared
file systems, where a log file is linked into place only if its number is free.
"""

from __future__ import annotations

import datetime
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FILE_BYTES, SPLIT_BYTES = 128 << 20, 128 << 20
LONGEST = 128  # characters of a string that is kept as a bound


def plain(value):
    """A bound as JSON: none for what has no safe order here."""
    if isinstance(value, str):
        return value if len(value) <= LONGEST else None
    if isinstance(value, (datetime.datetime, datetime.date)):
        return None if getattr(value, "tzinfo", None) else {"at": value.isoformat()}
    return value if isinstance(value, int) else None


def unplain(value):
    if isinstance(value, dict):
        text = value["at"]
        return datetime.datetime.fromisoformat(text) if "T" in text else datetime.date.fromisoformat(text)
    return value


class Log:
    """The commits of one folder."""

    def __init__(self, path: str):
        if "://" in path or path.startswith("file:"):
            self.fs, self.root = pafs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
        else:
            self.fs, self.root = pafs.LocalFileSystem(), os.path.abspath(path)

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == pafs.FileType.File)

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.names("_log") if n.endswith(".json")]

    def commit_of(self, version: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/_log/{version:012d}.json") as f:
            return json.loads(f.read())

    def files(self, upto: int | None = None) -> list[dict]:
        """The data files of a version: those since the last commit that replaced the table."""
        out: list[dict] = []
        for version in reversed([v for v in self.versions() if upto is None or v <= upto]):
            commit = self.commit_of(version)
            out = commit["files"] + out
            if commit["replace"]:
                break
        return out

    def schema(self) -> str:
        if not (versions := self.versions()):
            raise ValueError(f"no commit in {self.root}: give a schema")
        return self.commit_of(versions[-1])["schema"]

    def add(self, commit: dict) -> int:
        """Append a commit under the next free number."""
        self.fs.create_dir(f"{self.root}/_log", recursive=True)
        aside = f"{self.root}/_log/{uuid.uuid4().hex}.new"
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps(commit).encode())
        while True:
            version = max(self.versions(), default=-1) + 1
            path = f"{self.root}/_log/{version:012d}.json"
            if not isinstance(self.fs, pafs.LocalFileSystem):
                self.fs.move(aside, path)
                return version
            try:
                os.link(aside, path)  # fails where another writer took the number
            except FileExistsError:
                continue
            os.unlink(aside)
            return version

    def drop(self, prefix: str, but: Iterable[str] = ()) -> None:
        """Delete data files of one write, except those named."""
        kept = set(but)
        for name in self.names("data"):
            if name.startswith(prefix) and name not in kept:
                self.fs.delete_file(f"{self.root}/data/{name}")


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


@dataclass
class Files(InputPartition):
    paths: list[str]


def bounds(batch: pa.RecordBatch, known: dict[str, list]) -> None:
    """Widen each column's bounds (least, most, nulls) by a batch; a column without safe bounds has none."""
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        kind = column.type
        if not (pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_boolean(kind) or pa.types.is_date(kind) or (pa.types.is_timestamp(kind) and not kind.tz)):
            continue
        least, most, nulls = known.setdefault(name, [None, None, 0])
        known[name][2] = nulls + column.null_count
        if column.null_count < len(column):
            got = pc.min_max(column).as_py()
            known[name][:2] = [got["min"] if least is None else min(least, got["min"]), got["max"] if most is None else max(most, got["max"])]


def write_files(log: Log, prefix: str, batches: Iterator[pa.RecordBatch]) -> list[dict]:
    """Arrow files of at most about FILE_BYTES before compression, with rows and bounds."""
    out: list[dict] = []
    log.fs.create_dir(f"{log.root}/data", recursive=True)
    sink = writer = name = None
    rows = size = 0
    known: dict[str, list] = {}

    def close() -> None:
        writer.close()
        sink.close()
        out.append({"path": name, "rows": rows, "bytes": log.fs.get_file_info(f"{log.root}/data/{name}").size, "bounds": {c: [plain(a), plain(b), n] for c, (a, b, n) in known.items()}})

    for batch in batches:
        if writer is None:
            name, rows, size, known = f"{prefix}-{uuid.uuid4().hex}.arrow", 0, 0, {}
            sink = log.fs.open_output_stream(f"{log.root}/data/{name}")
            writer = pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        writer.write_batch(batch)
        bounds(batch, known)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if size >= FILE_BYTES:
            close()
            writer = None
    if writer is not None:
        close()
    return out


def may_hold(f: Filter, of: dict, rows: int) -> bool:
    """Can a file with these bounds hold a row that the filter takes?"""
    if len(f.attribute) != 1 or f.attribute[0] not in of:
        return True
    least, most, nulls = of[f.attribute[0]]
    least, most = unplain(least), unplain(most)
    if isinstance(f, IsNull):
        return nulls > 0
    if nulls == rows:
        return False
    if isinstance(f, IsNotNull) or least is None or most is None:
        return True
    try:
        if isinstance(f, EqualTo):
            return least <= f.value <= most
        if isinstance(f, In):
            return any(v is not None and least <= v <= most for v in f.value)
        if isinstance(f, GreaterThan):
            return most > f.value
        if isinstance(f, GreaterThanOrEqual):
            return most >= f.value
        if isinstance(f, LessThan):
            return least < f.value
        if isinstance(f, LessThanOrEqual):
            return least <= f.value
    except TypeError:  # a literal of another kind
        return True
    return True


def taken(f: Filter, batch: pa.RecordBatch) -> pa.Array:
    """Which rows of a batch a filter takes."""
    column = batch.column(f.attribute[0])
    if isinstance(f, IsNull):
        return pc.is_null(column)
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, In):
        return pc.is_in(column, value_set=pa.array([v for v in f.value if v is not None], column.type))
    if isinstance(f, StringStartsWith):
        return pc.starts_with(column, f.value)
    compare = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
    return pc.fill_null(compare[type(f)](column, pa.scalar(f.value, column.type)), False)


PUSHED = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNull, IsNotNull, StringStartsWith)
NAMED = {"=": EqualTo, "<": LessThan, "<=": LessThanOrEqual, ">": GreaterThan, ">=": GreaterThanOrEqual, "in": In, "starts": StringStartsWith}
SAFE = ("byte", "short", "integer", "long", "string", "boolean", "date", "timestamp_ntz")


def grouped(files: list[dict], split: int) -> list[Files]:
    """Files in groups of about `split` bytes."""
    out, size = [], split
    for f in files:
        if size + f["bytes"] > split:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(f["path"])
        size += f["bytes"]
    return out


def read_files(log: Log, paths: list[str], filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    for path in paths:
        with log.fs.open_input_file(f"{log.root}/data/{path}") as source:
            reader = pa.ipc.open_file(source)
            for i in range(reader.num_record_batches):
                batch = reader.get_batch(i)
                for f in filters:
                    batch = batch.filter(taken(f, batch))
                if batch.num_rows:
                    yield batch


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, version: int | None, split: int, keep: list[Filter]):
        self.path, self.kinds, self.version, self.split = path, {f.name: f.dataType.typeName() for f in schema.fields}, version, split
        self.keep, self.pushed = keep, []
        if odd := [f.attribute[0] for f in keep if self.kinds.get(f.attribute[0]) not in SAFE]:
            raise ValueError(f"no conditions on {odd}")

    def partitions(self) -> list[Files]:
        files = Log(self.path).files(self.version)
        return grouped([f for f in files if all(may_hold(p, f["bounds"], f["rows"]) for p in self.keep + self.pushed)], self.split) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(Log(self.path), partition.paths, self.keep + self.pushed)


class PushingReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.pushed = []  # of an earlier query
        for f in filters:
            if isinstance(f, PUSHED) and len(f.attribute) == 1 and self.kinds.get(f.attribute[0]) in SAFE:
                self.pushed.append(f)
            else:
                yield f


class StreamReader(DataSourceStreamReader):
    """Offsets are versions; a commit that replaces the table ends a stream with an error, since its earlier rows can't be taken back."""

    def __init__(self, path: str, first: int, split: int):
        self.path, self.first, self.split = path, first, split

    def initialOffset(self) -> dict:
        return {"version": self.first - 1}

    def latestOffset(self) -> dict:
        return {"version": max(Log(self.path).versions(), default=self.first - 1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        log, files = Log(self.path), []
        for version in log.versions():
            if start["version"] < version <= end["version"]:
                commit = log.commit_of(version)
                if commit["replace"] and version > self.first:
                    raise ValueError(f"version {version} replaced the table")
                files += commit["files"]
        return grouped(files, self.split)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(Log(self.path), partition.paths, [])


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, replace: bool):
        self.path, self.schema, self.replace, self.id = path, schema.json(), replace, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(write_files(Log(self.path), self.id, iterator))

    def commit(self, messages: list[Written | None]) -> None:
        log, files = Log(self.path), [f for m in messages if m for f in m.files]
        log.add({"schema": self.schema, "replace": self.replace, "files": files, "stream": None, "batch": None})
        log.drop(self.id, [f["path"] for f in files])  # what tasks that were run twice have left

    def abort(self, messages: list[Written | None]) -> None:
        Log(self.path).drop(self.id)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: StructType, stream: str):
        self.path, self.schema, self.stream, self.id = path, schema.json(), stream, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(write_files(Log(self.path), self.id, iterator))

    def committed(self, log: Log, batch: int) -> bool:
        for version in reversed(log.versions()):
            commit = log.commit_of(version)
            if commit["stream"] == self.stream:
                return commit["batch"] >= batch
        return False

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        log, files = Log(self.path), [f for m in messages if m for f in m.files]
        if self.committed(log, batchId):
            self.abort(messages, batchId)
        else:
            log.add({"schema": self.schema, "replace": False, "files": files, "stream": self.stream, "batch": batchId})

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        log = Log(self.path)
        for f in (f for m in messages if m for f in m.files):
            log.fs.delete_file(f"{log.root}/data/{f['path']}")


class ArrowLog(DataSource):
    """Options: path; version, pushdown, keep (batch reads; see scan), startingVersion (streams), splitBytes, stream (the name that a
    streaming write commits under)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_log"

    def option(self, name: str, default=None):
        return {k.lower(): v for k, v in self.options.items()}.get(name.lower(), default)

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(Log(self.option("path")).schema()))

    def reader(self, schema: StructType) -> Reader:
        version, kind = self.option("version"), PushingReader if self.option("pushdown", "false").lower() == "true" else Reader
        keep = [NAMED[op]((c,), tuple(map(unplain, v)) if op == "in" else unplain(v)) for c, op, v in json.loads(self.option("keep", "[]"))]
        return kind(self.option("path"), schema, None if version is None else int(version), int(self.option("splitBytes", SPLIT_BYTES)), keep)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.option("path"), int(self.option("startingVersion", 0)), int(self.option("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.option("path"), schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        if not self.option("stream"):
            raise ValueError("option stream must name the stream, the same one after a restart")
        return StreamWriter(self.option("path"), schema, self.option("stream"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowLog)


def scan(spark: SparkSession, path: str, *conditions: tuple, version: int | None = None) -> DataFrame:
    """The rows of a table that meet all conditions (column, one of = < <= > >= in starts, value); null values meet none."""
    keep = [(c, op, list(map(plain, v)) if op == "in" else plain(v)) for c, op, v in conditions]
    reader = spark.read.format(ArrowLog.name()).option("keep", json.dumps(keep))
    return (reader if version is None else reader.option("version", version)).load(path)
