"""Archive members as rows: one task reads one archive once, as a stream."""

from __future__ import annotations

import calendar
import hashlib
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import opened
from .media import Edges, is_media, is_video, probe

#: What archives are called.
SUFFIXES = (".tgz", ".tar.gz", ".tar", ".zip")
#: Media up to WHOLE bytes are probed whole; of larger videos the first and last EDGE bytes.
WHOLE, EDGE = 64 << 20, 16 << 20
_CHUNK = 4 << 20

MEMBERS = "archive string, path string, size long, mtime long, md5 string, ext string, folder string, basename string, json string, width int, height int, duration_s double, own_time string, probe_error string"
CONTENT = "archive string, path string, content binary"


def is_archive(name: str) -> bool:
    return name.lower().endswith(SUFFIXES)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, archive, size) of the archives directly in a folder; names are listed on the driver, contents never."""
    system, path = opened(folder)
    prefix = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
    found = sorted((f"{prefix}{x.path}", x.base_name, x.size) for x in system.get_file_info(fs.FileSelector(path)) if x.is_file and is_archive(x.base_name))
    return spark.createDataFrame(found, "uri string, archive string, size long")


def _members(uri: str) -> Iterator[tuple[str, int, int, object]]:
    """(path, size, mtime, open) of regular files in archive order; zip times are read as UTC."""
    system, path = opened(uri)
    if path.lower().endswith(".zip"):
        with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    yield info.filename, info.file_size, calendar.timegm((*info.date_time, 0, 0, 0)), lambda info=info: archive.open(info)
    else:
        with system.open_input_stream(path, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as archive:
            for info in archive:
                if info.isfile():
                    yield info.name, info.size, int(info.mtime), lambda info=info: archive.extractfile(info)


def _row(archive: str, path: str, size: int, mtime: int, stream) -> dict:
    folder, base = os.path.split(path)
    ext = os.path.splitext(base)[1].lower()
    text, media = ext == ".json", is_media(ext)
    whole = text or (media and (size <= WHOLE or not is_video(ext)))
    digest, head, tail = hashlib.md5(), bytearray(), bytearray()
    while chunk := stream.read(_CHUNK):
        digest.update(chunk)
        if whole:
            head += chunk
        elif media:
            head += chunk[: max(0, EDGE - len(head))]
            tail = (tail + chunk)[-EDGE:]
    row = {"archive": archive, "path": path, "size": size, "mtime": mtime, "md5": digest.hexdigest(), "ext": ext, "folder": folder, "basename": base, "json": head.decode("utf-8", "replace") if text else None}
    facts = {"width": None, "height": None, "duration_s": None, "own_time": None, "probe_error": None}
    if media:
        try:
            facts |= probe(Edges(bytes(head), b"" if whole else bytes(tail), size), ext)
        except Exception as error:  # a file that can't be read is recorded and the rest goes on
            facts["probe_error"] = f"{type(error).__name__}: {error}"[:300]
    return row | facts


def _one_to_a_task(archives: DataFrame) -> DataFrame:
    """Archives are few and large: each becomes a partition of its own."""
    n = max(1, archives.count())
    return archives.repartitionByRange(n, "uri")


def members(archives: DataFrame) -> DataFrame:
    """The index of all members: sums, sizes, sidecar text and what media headers say (see MEMBERS)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(MEMBERS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, archive in zip(batch["uri"].to_pylist(), batch["archive"].to_pylist()):
                rows: list[dict] = []
                for path, size, mtime, begin in _members(uri):
                    with begin() as stream:
                        rows.append(_row(archive, path, size, mtime, stream))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return _one_to_a_task(archives).select("uri", "archive").mapInArrow(read, MEMBERS)


def new_archives(archives: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """Archives that the index hasn't got yet, or all with force."""
    return archives if force else archives.join(indexed.select("archive").distinct(), "archive", "left_anti")


def update_index(spark: SparkSession, folder: str, index: str, force: bool = False) -> DataFrame:
    """Index new archives into a Parquet table partitioned by archive, replacing an archive's rows as a whole."""
    found = list_archives(spark, folder)
    try:
        indexed = spark.read.parquet(index).select("archive")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        indexed = found.select("archive").limit(0)
    todo = new_archives(found, indexed, force)
    members(todo).withColumn("member_of", F.col("archive")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("member_of").parquet(index)
    return spark.read.parquet(index).drop("member_of")


def contents(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """(archive, path, content) of wanted members (archive, path), in archive order; reading stops when all are found.

    Wanted paths are grouped by archive before the read, so an archive is
    opened once and archives without wanted members aren't.
    """
    listed = wanted.select("archive", "path").distinct().groupBy("archive").agg(F.collect_list("path").alias("paths"))
    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, archive, paths in zip(batch["uri"].to_pylist(), batch["archive"].to_pylist(), batch["paths"].to_pylist()):
                left = set(paths)
                for path, _, _, begin in _members(uri):
                    if path in left:
                        left.remove(path)
                        with begin() as stream:
                            yield pa.RecordBatch.from_pylist([{"archive": archive, "path": path, "content": stream.read()}], schema)
                        if not left:
                            break

    return archives.join(listed, "archive").select("uri", "archive", "paths").mapInArrow(read, CONTENT)
