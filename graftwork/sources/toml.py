"""A data source for manifests (OP-02): one row per file, its content as a JSON text."""

from __future__ import annotations

import datetime
import fnmatch
import json
import tomllib
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI (local, HDFS, object store), and the path there."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TomlReader(DataSourceReader):
    """Files are dealt out to partitions; a file that can't be read or parsed is a row with that status."""

    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        fs, root = place(self.uri)
        pattern = options.get("glob", "Cargo.toml")
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            self.paths = sorted(f.path for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))
        else:
            self.paths = [root]
        self.parts = int(options.get("partitions", "8"))

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.parts, len(self.paths)))
        return [_Files(self.paths[i::n]) for i in range(n)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs, _ = place(self.uri)
        for path in partition.paths:
            try:
                with fs.open_input_stream(path) as f:
                    content = tomllib.loads(f.read().decode())
            except OSError:
                yield path, "unreadable", None
            except (tomllib.TOMLDecodeError, UnicodeDecodeError):
                yield path, "syntax", None
            else:
                yield path, "ok", json.dumps(content, default=lambda x: x.isoformat() if isinstance(x, (datetime.date, datetime.time)) else str(x))


class TomlSource(DataSource):
    """spark.dataSource.register(TomlSource); spark.read.format("toml").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "toml"

    def schema(self) -> str:
        return "path string, status string, manifest string"

    def reader(self, schema: StructType) -> TomlReader:
        return TomlReader(self.options)
