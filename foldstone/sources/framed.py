"""Framed files as Spark data sources.

``framed_log`` and ``framed_vectors`` read one partition per file, since frames can't
be found from the middle of one, a frame at a time, and write one file per task. Paths are
local ones or addresses of any file system that Arrow knows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, FloatType, Row, StructField, StructType

from foldstone.model import MUTATION, RECORD
from foldstone.sources import wire

ENDING = ".frames"


@dataclass
class OneFile(InputPartition):
    path: str
    number: int


class Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


def _magic(options: dict) -> bytes:
    return options["magic"].encode().decode("unicode_escape").encode() if "magic" in options else wire.MAGIC


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(system: fs.FileSystem, path: str) -> list[str]:
    """A file, or those of a folder in order of their names."""
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(ENDING))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, vectors: bool):
        self.path, self.magic, self.vectors = options["path"], _magic(options), vectors

    def partitions(self) -> list[InputPartition]:
        found = _files(*_system(self.path))
        return [OneFile(p, i) for i, p in enumerate(found)] or [OneFile("", 0)]  # no file is an empty log

    def read(self, part: OneFile) -> Iterator[tuple]:
        if not part.path:
            return
        names = RECORD.fieldNames()
        with _system(self.path)[0].open_input_stream(part.path) as f:
            for i, payload in enumerate(wire.frames(f, self.magic)):
                if self.vectors:
                    record, vector = wire.decode_vector_entry(payload)
                    yield (*[record[n] for n in names], vector)
                else:
                    op, record = wire.decode_log_entry(payload)
                    yield ((part.number << 40) + i, op, *[record[n] for n in names])


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, vectors: bool):
        self.path, self.magic, self.vectors = options["path"], _magic(options), vectors

    def write(self, rows: Iterator[Row]) -> Written:
        # a task that is run again writes another file; only committed ones get their name
        system, folder = _system(self.path)
        target, some = f"{folder}/{uuid.uuid4().hex}", False
        system.create_dir(folder)
        with system.open_output_stream(target) as f:
            f.write(self.magic)
            for row in rows:
                r, some = row.asDict(), True
                payload = wire.encode_vector_entry(r, list(r["vector"] or [])) if self.vectors else wire.encode_log_entry(r["op"], r)
                f.write(wire.frame(payload))
        if some:
            return Written(target)
        system.delete_file(target)
        return Written(None)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _system(self.path)
        start = len(_files(system, folder))
        for i, m in enumerate(x for x in messages if x and x.path):
            system.move(m.path, f"{folder}/{start + i:08d}{ENDING}")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        for m in messages:
            if m and m.path and system.get_file_info(m.path).type == fs.FileType.File:
                system.delete_file(m.path)


class FramedLog(DataSource):
    """``seq, op`` and the record fields, in file order. Options: path, magic."""

    vectors = False

    @classmethod
    def name(cls) -> str:
        return "framed_log"

    def schema(self) -> StructType:
        return MUTATION

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, self.vectors)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, self.vectors)


class FramedVectors(FramedLog):
    """The record fields and ``vector``. Options: path, magic."""

    vectors = True

    @classmethod
    def name(cls) -> str:
        return "framed_vectors"

    def schema(self) -> StructType:
        return StructType([*RECORD.fields, StructField("vector", ArrayType(FloatType()))])


def register(spark) -> None:
    spark.dataSource.register(FramedLog)
    spark.dataSource.register(FramedVectors)


def rewrite_text_log(spark, source: str, target: str) -> None:
    """A log of older text rows as a framed one; rows that are malformed are left out (A4)."""
    from foldstone.sources import legacy

    register(spark)
    legacy.read_log(spark, source).sortWithinPartitions("seq").write.format("framed_log").mode("append").save(target)
