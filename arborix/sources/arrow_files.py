"""Arrow IPC files (the form that Feather's second version has) as a Spark source and sink: format ``arrow_ipc``.

Reading: a partition a record batch, or a run of small ones; ``columns`` (names by comma) prunes what is read, as the file keeps columns apart, and the
schema is the first file's.  Writing: a file a task, which appears under its name only when the job commits.  Paths may be files or folders of any store
that pyarrow opens by its URI."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from arborix.functions.workers import with_package

#: Bytes of record batches that a partition reads, about.
BYTES = 32 << 20
SUFFIXES = (".feather", ".arrow")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.path.endswith(SUFFIXES))


@dataclass
class Batches(InputPartition):
    file: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    part: str
    name: str


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        store, _ = _store(self.options["path"])
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no {' or '.join(SUFFIXES)} file in {self.options['path']}")
        with store.open_input_file(files[0]) as f:
            whole = ipc.open_file(f).schema
        names = self._columns()
        return from_arrow_schema(pa.schema([whole.field(n) for n in names]) if names else whole)

    def _columns(self) -> list[str] | None:
        given = self.options.get("columns")
        return [x.strip() for x in given.split(",")] if given else None

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], schema)


class Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names = path, names

    def partitions(self) -> list[Batches]:
        """From the files' footers alone."""
        store, _ = _store(self.path)
        out = []
        for path in _files(self.path):
            size = store.get_file_info(path).size
            with store.open_input_file(path) as f:
                n = ipc.open_file(f).num_record_batches
            step = max(1, n * BYTES // max(size, 1))
            out += [Batches(path, i, min(i + step, n)) for i in range(0, n, step)]
        return out or [Batches("", 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as f:
            schema = ipc.open_file(f).schema
            kept = ipc.IpcReadOptions(included_fields=sorted(schema.get_field_index(n) for n in self.names))
            file = ipc.open_file(f, options=kept)
            for i in range(partition.first, partition.last):
                yield file.get_batch(i).select(self.names)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema, self.job = path, schema, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        store, at = _store(self.path)
        schema = to_arrow_schema(self.schema)
        task = TaskContext.get()
        part = f"{at}/_{self.job}-{task.partitionId()}-{task.taskAttemptId()}.part"
        store.create_dir(at)
        with store.open_output_stream(part) as f, ipc.new_file(f, schema, options=ipc.IpcWriteOptions(compression="lz4")) as out:
            for batch in batches:
                out.write_batch(pa.RecordBatch.from_arrays([x.cast(k.type) for x, k in zip(batch.columns, schema, strict=True)], schema=schema))
        return Written(part, f"{at}/part-{task.partitionId():05d}-{self.job}.feather")

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None:
                store.move(m.part, m.name)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None and store.get_file_info(m.part).type == fs.FileType.File:
                store.delete_file(m.part)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    with_package(spark)
    spark.dataSource.register(ArrowFiles)
