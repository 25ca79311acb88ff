"""Files that tasks write themselves: shared folders, temporary names, and shards by key range."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import opened  # noqa: F401  the writers and readers take it from here
from .common import cut, shared_dir

#: Bins that keys are first counted in, and that a heavy bin is cut into at each further level.
_BINS, _FINER = 1 << 12, 16
#: Ranges at most; with more data ranges grow instead.
RANGES = 1 << 14
#: What a null key is written as; it comes first.
NO_KEY = -(2**63)


def new_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def commit(system: fs.FileSystem, temporary: str, final: str) -> None:
    """Give a finished file its name; another attempt's equal file gives way."""
    if system.get_file_info(final).type != fs.FileType.NotFound:
        system.delete_file(final)
    system.move(temporary, final)


def write_json(uri: str, value: object) -> None:
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(f"{path}.tmp") as out:
        out.write(json.dumps(value, sort_keys=True).encode())
    commit(system, f"{path}.tmp", path)


@dataclass(frozen=True)
class Ranges:
    """Consecutive key ranges: upper keys (inclusive), the last left out, and keys that fill several ranges by themselves."""

    bounds: tuple[int, ...]
    split: tuple[tuple[int, int], ...] = ()
    target: int = 0

    def __len__(self) -> int:
        return len(self.bounds) + 1 + sum(n - 1 for _, n in self.split)

    def of(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """The range of each key; ties, unsigned 32-bit numbers, order the rows of a split key."""
        out = np.searchsorted(np.array(self.bounds, np.int64), keys, "left")
        for key, n in self.split:
            out = out + np.where(keys > key, n - 1, np.where(keys == key, ties.astype(np.int64) * n >> 32, 0))
        return out.astype(np.int32)


def key_ranges(df: DataFrame, key: str, weight: str, target: int, ranges: int = RANGES) -> Ranges:
    """Ranges of about `target` weight each, or of more where there would be over `ranges` of them.

    Weights are summed over equal bins of the key's span; bins that weigh more
    than twice the target are cut further, all of one level by one job over
    keys and weights alone. The driver holds a row for each bin, and there are
    at most `ranges` heavy ones. The same table gives the same ranges, however
    it is partitioned. A null key counts as NO_KEY. A key that weighs over
    twice the target by itself is split.
    """
    sized = cut(df.select(F.col(key).alias("key"), F.col(weight).cast("long").alias("weight")))
    low, high, total, nulls = sized.agg(F.min("key"), F.max("key"), F.sum("weight"), F.sum(F.when(F.col("key").isNull(), F.col("weight")))).first()
    target = max(1, target, -(-(total or 0) // ranges))
    found: list[tuple[int, int]] = [] if nulls is None else [(NO_KEY, nulls)]  # (upper key, weight)
    if low is not None:
        wide = "decimal(20,0)" if high - low >= 1 << 63 else "long"
        width, past = -(-(high - low + 1) // _BINS), F.col("key").cast(wide) - F.lit(low).cast(wide)
        last_of, rest = {None: high}, past % F.lit(width).cast(wide)
        part = sized.where("key is not null").withColumn("parent", F.lit(None).cast("long"))
        while True:
            first = (F.col("key").cast(wide) - rest).cast("long")
            binned = part.select("key", "weight", "parent", first.alias("bin"))
            heavy = {}
            for parent, at, sum_ in binned.groupBy("parent", "bin").agg(F.sum("weight")).collect():
                last = min(last_of[parent], at + width - 1)
                if sum_ > 2 * target and last > at:
                    heavy[at] = last
                else:
                    found.append((last, sum_))
            if not heavy:
                break
            chosen = sized.sparkSession.createDataFrame([(x,) for x in heavy], "bin long")
            part = binned.join(F.broadcast(chosen), "bin", "left_semi").select("key", "weight", F.col("bin").alias("parent"))
            last_of, width = heavy, -(-width // _FINER)
            rest = (F.col("key").cast(wide) - F.col("parent").cast(wide)) % F.lit(width).cast(wide)
    bounds, split, held, edge = [], [], 0, None
    for last, sum_ in sorted(found):
        if held and held + sum_ > target:
            bounds.append(edge)
            held = 0
        if sum_ > 2 * target:  # a single key
            split.append((last, -(-sum_ // target)))
        held, edge = held + sum_, last
    return Ranges(tuple(bounds), tuple(split), target)


def dealt(df: DataFrame, shards: int, shard: str, *order: str) -> DataFrame:
    """One partition for each shard number, sorted."""
    return df.repartitionById(shards, F.col(shard)).sortWithinPartitions(shard, *order)
