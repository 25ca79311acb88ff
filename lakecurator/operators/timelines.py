"""Clips and the stills that they belong to, by time, without a table of pairs."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import Scan


def islands(events: DataFrame, keys: list[str], time: str, order: list[str], window: int) -> DataFrame:
    """events with island: rows of a key between which no gap of time is wider than the window.

    `order` makes the order of equal times total. Gaps are found by a scan over
    ranges of time, which hands on a range's last time; see Scan.
    """
    along = Scan(events, keys, [F.asc(c) for c in (time, *order)]).lagged(_last=F.col(time))
    new = F.col("at_first") | (F.col(time) - F.col("_last") > window)
    return along.running("island", new.cast("int")).done().drop("_last", "at_first")


class _Shape:
    """The stills of one ratio: for each time those left, in their order; times without any are skipped."""

    def __init__(self, rows: list[tuple]):  # (time, order, id), sorted
        self.all_times = [r[0] for r in rows]
        self.times = sorted(set(self.all_times))
        at = {t: i for i, t in enumerate(self.times)}
        self.waiting: list[list[tuple]] = [[] for _ in self.times]
        for t, order, id_ in reversed(rows):
            self.waiting[at[t]].append((order, id_))
        n = len(self.times)
        self.right, self.left = list(range(n + 1)), list(range(n + 1))  # left is shifted by one; n and 0 are the ends

    @staticmethod
    def _follow(links: list[int], i: int) -> int:
        end = i
        while links[end] != end:
            end = links[end]
        while links[i] != end:
            links[i], i = end, links[i]
        return end

    def nearest(self, time, window) -> list[tuple]:
        """(gap, order, id, place) of the first still left at the nearest time after, and at that before."""
        at, out = bisect_left(self.times, time), []
        later = self._follow(self.right, at)
        earlier = self._follow(self.left, at) - 1
        for i in (later, earlier):
            if 0 <= i < len(self.times) and abs(self.times[i] - time) <= window:
                out.append((abs(self.times[i] - time), *self.waiting[i][-1], i))
        return out

    def holds(self, place: int, id_) -> bool:
        return bool(self.waiting[place]) and self.waiting[place][-1][1] == id_

    def take(self, place: int) -> None:
        self.waiting[place].pop()
        if not self.waiting[place]:
            self.right[place] = place + 1
            self.left[place + 1] = place

    def count(self, time, window) -> int:
        return bisect_right(self.all_times, time + window) - bisect_left(self.all_times, time - window)


def _rank(x) -> tuple:
    """What values sort by, as Spark sorts them: nulls first, structs by their fields."""
    return (1, tuple(map(_rank, x.values()))) if isinstance(x, dict) else (x is not None, x)


def sweep(clips: list[tuple], stills: list[tuple], window, tolerance: float) -> list[tuple]:
    """(clip, still, gap, candidates) of one island, as the pass over all pairs in their order would take them.

    clips and stills: (id, time, ratio, order). A heap holds the best pair of
    each clip. The still of the least may be gone by then; then the clip's next
    best takes its place. Of stills with one time and ratio the first in order
    is always taken first, so those left are a stack, and memory goes with rows.
    """
    by_ratio = defaultdict(list)
    for id_, time, ratio, order in stills:
        by_ratio[ratio].append((time, _rank(order), id_))
    shapes = {ratio: _Shape(sorted(rows)) for ratio, rows in by_ratio.items() if ratio}
    fitting: dict[float, list[float]] = {}
    for ratio in {c[2] for c in clips}:
        fitting[ratio] = [s for s in shapes if abs(s - ratio) / s <= tolerance]

    def best(n: int) -> tuple | None:
        id_, time, ratio, order = clips[n]
        near = [(gap, _rank(order), still_order, id_, still, n, s, place) for s in fitting[ratio] for gap, still_order, still, place in shapes[s].nearest(time, window)]
        return min(near, default=None)

    heap = [pair for n in range(len(clips)) if (pair := best(n))]
    heapq.heapify(heap)
    out = []
    while heap:
        gap, _, _, id_, still, n, ratio, place = heap[0]
        if shapes[ratio].holds(place, still):
            heapq.heappop(heap)
            shapes[ratio].take(place)
            out.append((id_, still, gap, sum(shapes[s].count(clips[n][1], window) for s in fitting[clips[n][2]])))
        elif pair := best(n):
            heapq.heapreplace(heap, pair)
        else:
            heapq.heappop(heap)
    return out


def pair_clips(clips: DataFrame, stills: DataFrame, window: int = 60, tolerance: float = 0.02, keys: list[str] | None = None) -> DataFrame:
    """clip_id, still_id, gap and candidates: each clip with the still taken nearest to it in time and of its shape.

    clips: clip_id, clip_ts, clip_ratio, clip_order; stills: still_id,
    still_ts, still_ratio, still_order; and the keys. Ids are unique. The
    closest pairs come first, equal gaps by clip order, then still order, and
    each clip and still is taken once. candidates counts a clip's stills before
    any is taken. Rows without a time, ratio or key pair with nothing.

    Pairs are never listed. Times of a key fall into islands with no gap wider
    than the window, and an island's rows meet in one task: see sweep(). A key
    fills as many tasks as it has islands; one dense island is the limit.
    """
    keys = keys or []
    one = [F.lit(0).alias("_key")] if not keys else [F.col(k) for k in keys]
    names = keys or ["_key"]
    blank = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    facts = lambda side, other, df, n: [*one, F.lit(n).alias("_side"), F.col(f"{side}_ts").alias("_ts"), F.col(f"{side}_ratio").cast("double").alias("_ratio"), *[F.col(f"clip_{c}") if side == "clip" else blank(clips, f"clip_{c}") for c in ("id", "order")], *[F.col(f"still_{c}") if side == "still" else blank(stills, f"still_{c}") for c in ("id", "order")]]
    events = stills.select(*facts("still", "clip", stills, 0)).unionByName(clips.select(*facts("clip", "still", clips, 1)))
    for column in (*names, "_ts", "_ratio"):
        events = events.where(F.col(column).isNotNull())
    placed = islands(events, names, "_ts", ["_side", "still_id", "clip_id"], window)
    placed = placed.repartition(*names, "island").sortWithinPartitions(*names, "island", "_side")
    kinds = {"clip_id": clips.schema["clip_id"].dataType.simpleString(), "still_id": stills.schema["still_id"].dataType.simpleString(), "gap": events.schema["_ts"].dataType.simpleString(), "candidates": "long"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, schema = None, ([], []), None
        for batch in batches:
            schema = schema or pa.schema([("clip_id", batch.schema.field("clip_id").type), ("still_id", batch.schema.field("still_id").type), ("gap", batch.schema.field("_ts").type), ("candidates", pa.int64())])
            found = []
            columns = [batch[c].to_pylist() for c in (*names, "island")]
            rows = zip(zip(*columns), *(batch[c].to_pylist() for c in ("_side", "_ts", "_ratio", "still_id", "still_order", "clip_id", "clip_order")))
            for island, side, time, ratio, still, still_order, clip, clip_order in rows:
                if island != now:
                    found += sweep(sides[1], sides[0], window, tolerance) if all(sides) else []
                    now, sides = island, ([], [])
                sides[side].append((clip, time, ratio, clip_order) if side else (still, time, ratio, still_order))
            yield _batch(found, schema)
        if all(sides):
            yield _batch(sweep(sides[1], sides[0], window, tolerance), schema)

    return placed.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
