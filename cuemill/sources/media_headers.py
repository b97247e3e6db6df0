"""First bytes of many files, read by range: a data source of its own.

The binary file source reads files whole and none over 2 GB. This one lists a folder once, deals its files to tasks, and each task
asks for the first bytes of its files alone."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length bigint, modified timestamp, head binary"


@dataclass
class Files(InputPartition):
    """Some files of one file system, by place, with their sizes and times."""

    found: list[tuple]


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        known = {k.lower(): v for k, v in options.items()}
        self.folder, self.pattern = known["path"], known.get("pathglobfilter", "*")
        self.size, self.each = int(known.get("bytes", 64)), int(known.get("filespertask", 256))
        self.deep = known.get("recursivefilelookup", "false").lower() == "true"
        if self.size < 0 or self.each < 1:
            raise ValueError("bytes: 0 or more; filesPerTask: 1 or more")

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.folder)
        infos = [system.get_file_info(at)]
        if infos[0].type == fs.FileType.Directory:
            infos = system.get_file_info(fs.FileSelector(at, recursive=self.deep))
        elif infos[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(self.folder)
        files = sorted((i.path, i.size, i.mtime) for i in infos if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.pattern))
        return [Files(files[k : k + self.each]) for k in range(0, len(files), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.folder)
        heads = []
        for path, _, _ in partition.found:
            with system.open_input_file(path) as file:  # random access: only what is asked for is read
                heads.append(file.read_at(self.size, 0))
        paths, sizes, times = zip(*partition.found, strict=True) if heads else ((), (), ())
        columns = [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.timestamp("us", "UTC")), pa.array(heads, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "length", "modified", "head"])


class MediaHeaders(DataSource):
    """Format media_headers: (path, length, modified, head) of a folder's files. Options: path; pathGlobFilter, of names; bytes, of the
    head, 64; filesPerTask, 256; recursiveFileLookup. Folders are found by Arrow: local ones, or those of a store it knows."""

    @classmethod
    def name(cls) -> str:
        return "media_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


def media_headers(spark: SparkSession, folder: str, pattern: str = "*.mp4", **options) -> DataFrame:
    spark.dataSource.register(MediaHeaders)
    return spark.read.format("media_headers").options(pathGlobFilter=pattern, **options).load(folder)
