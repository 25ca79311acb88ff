"""Archives as a format of spark.read: `spark.read.format("archives").load(folder)`."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .archives import MEMBERS, _members, _row, is_archive
from .files import opened

#: Columns that are known without a member's bytes.
LISTED = ("archive", "path", "size", "mtime", "ext", "folder", "basename")


class Archive(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)
        self.uri = uri


class ArchiveReader(DataSourceReader):
    """A partition for each archive; archives and members that filters rule out aren't opened or read.

    Filters on archive and path by equality, a list or a beginning are taken
    over; Spark keeps the rest. Spark doesn't tell a Python source which
    columns a query uses, so a schema does: with `.schema("archive string, path
    string")` no member's bytes are read.
    """

    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.columns = folder, columns
        self.equal: dict[str, set] = {}
        self.begins: dict[str, list[str]] = {"archive": [], "path": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column not in self.begins:
                yield f
            elif isinstance(f, (EqualTo, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.equal[column] = self.equal.get(column, values) & values
            elif isinstance(f, StringStartsWith):
                self.begins[column].append(f.value)
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        return value in self.equal.get(column, {value}) and all(value.startswith(b) for b in self.begins[column])

    def partitions(self) -> list[Archive]:
        system, path = opened(self.folder)
        prefix = self.folder[: len(self.folder) - len(path)] if self.folder.endswith(path) else ""
        found = sorted((x.path, x.base_name) for x in system.get_file_info(fs.FileSelector(path)) if x.is_file and is_archive(x.base_name))
        return [Archive(f"{prefix}{p}") for p, name in found if self._wanted("archive", name)]

    def read(self, partition: Archive | None) -> Iterator[tuple]:
        if partition is None:  # no archive is left
            return
        archive = partition.uri.rpartition("/")[2]
        left = set(self.equal["path"]) if "path" in self.equal else None
        for path, size, mtime, begin in _members(partition.uri):
            if left is not None and not left:
                break
            if not self._wanted("path", path):
                continue
            if set(self.columns) <= set(LISTED):
                folder, base = os.path.split(path)
                row = {"archive": archive, "path": path, "size": size, "mtime": mtime, "ext": os.path.splitext(base)[1].lower(), "folder": folder, "basename": base}
            else:
                with begin() as stream:
                    row = _row(archive, path, size, mtime, stream)
            yield tuple(row[c] for c in self.columns)


class Archives(DataSource):
    """Members of the tar and zip archives of a folder, as sources.archives.members() gives them."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        unknown = set(schema.names) - {c.split()[0] for c in MEMBERS.split(", ")}
        if unknown:
            raise ValueError(f"members have no columns {sorted(unknown)}")
        return ArchiveReader(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    """Make the format known, and let its filters be pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archives)
