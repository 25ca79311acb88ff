"""Runs of commands: when they began and ended, how, and what they counted on the way."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

RUNS = "run_id long, command string, args string, started timestamp, finished timestamp, status string, summary string"


class Stopped(Exception):
    """Raised by a command that was asked to stop; its run is stopped, not failed."""


class Run:
    def __init__(self, run_id: int):
        self.run_id, self.summary = run_id, {}
        self._observed: list[tuple[str, Observation]] = []

    def observe(self, name: str, df: DataFrame, **counts: Column) -> DataFrame:
        """df, whose counts are taken by the job that writes it, and stand in the run's summary under the name."""
        self._observed.append((name, found := Observation(f"{name}-{self.run_id}")))
        return df.observe(found, *[c.alias(k) for k, c in counts.items()])

    def finish(self, ok: bool) -> dict:
        """The summary. Counts of jobs that never ran are known only to be missing, so a run that failed doesn't wait for them."""
        return {**self.summary, **({name: dict(found.get) for name, found in self._observed} if ok else {})}


@contextmanager
def recorded(spark: SparkSession, folder: str, command: str, **args: object) -> Iterator[Run]:
    """Within it a command runs; its run row is appended to the folder at the end, with ok, stopped or failed.

    Ids ascend with the time of the start. Stopping isn't an error; failures
    are raised again after the row is written.
    """
    run, started, status, failure = Run(time.time_ns()), datetime.now(timezone.utc), "ok", None
    try:
        yield run
    except (Stopped, KeyboardInterrupt):
        status = "stopped"
    except BaseException as error:
        status, failure = "failed", error
        run.summary["error"] = f"{type(error).__name__}: {error}"[:500]
    text = json.dumps(run.finish(status == "ok"), sort_keys=True, default=str)
    row = (run.run_id, command, json.dumps(args, sort_keys=True, default=str), started, datetime.now(timezone.utc), status, text)
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(folder)
    if failure is not None:
        raise failure


def last_runs(runs: DataFrame, n: int = 5, by: tuple[str, ...] = ("command", "status")) -> DataFrame:
    """The newest n runs of each command and status; a long history is cut before it is sorted."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("run_id")))
    return runs.withColumn("place", place).where(F.col("place") <= n)


def last_notes(runs: DataFrame, command: str) -> str | None:
    """The summary of the last run of a command that ended well."""
    row = runs.where((F.col("command") == command) & (F.col("status") == "ok")).agg(F.max_by("summary", "run_id")).first()
    return row[0]
