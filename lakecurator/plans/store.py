"""A project's tables as versioned Parquet snapshots, with an append-only event log.

A Parquet table takes no updates, so a merge writes a whole new snapshot and
then swaps the pointer that names the current one; readers see the old or the
new table and nothing between. Migrations are functions from tables to tables,
run in order, once each.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import opened

Migration = Callable[["Store"], None]


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._system, self._path = opened(self.folder)

    def _read(self, name: str) -> dict | None:
        path = f"{self._path}/{name}"
        if self._system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self._system.open_input_stream(path) as source:
            return json.loads(source.read())

    def _put(self, name: str, value: dict) -> None:
        self._system.create_dir(self._path, recursive=True)
        path, temporary = f"{self._path}/{name}", f"{self._path}/.{name}.{uuid.uuid4().hex}"
        with self._system.open_output_stream(temporary) as out:
            out.write(json.dumps(value, sort_keys=True).encode())
        self._system.move(temporary, path)

    def names(self) -> list[str]:
        return sorted((self._read("tables.json") or {}))

    def has(self, name: str) -> bool:
        return name in (self._read("tables.json") or {})

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{(self._read('tables.json') or {})[name]}")

    def write(self, **tables: DataFrame) -> None:
        """Replace tables together: all snapshots are written before one pointer swap makes them current."""
        current = self._read("tables.json") or {}
        for name, df in tables.items():
            snapshot = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{snapshot}")
            current[name] = snapshot
        self._put("tables.json", current)

    def event(self, kind: str, run_id: int | None = None, level: str = "info", item_id: str | None = None, album_id: str | None = None, **detail: object) -> None:
        row = [(run_id, level, kind, item_id, album_id, json.dumps(detail, sort_keys=True, default=str))]
        self.events_from(self.spark.createDataFrame(row, "run_id long, level string, kind string, item_id string, album_id string, detail string"))

    def events_from(self, rows: DataFrame) -> None:
        """Append many events (run_id, level, kind, item_id, album_id, detail) in one job."""
        rows.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(f"{self.folder}/events")

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/events")

    @property
    def version(self) -> int:
        return (self._read("version.json") or {"version": 0})["version"]

    def migrate(self, migrations: list[Migration]) -> list[int]:
        """Run the migrations that are still to come; a store newer than the last of them is refused."""
        if self.version > len(migrations):
            raise ValueError(f"the store has version {self.version}, newer than {len(migrations)}")
        done = []
        for n in range(self.version + 1, len(migrations) + 1):
            migrations[n - 1](self)
            history = (self._read("version.json") or {}).get("history", [])
            self._put("version.json", {"version": n, "history": [*history, n]})
            done.append(n)
        return done
