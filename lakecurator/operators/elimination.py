"""Names that are given whole or by their beginning, each taken once, in the order in which they ask."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged


class FreePlaces:
    """How many of n places are free before each, and which is the first free one from a place on, in log n steps."""

    def __init__(self, n: int):
        self.n, self.free = n, [True] * n
        self.sums = [i & -i for i in range(n + 1)]
        self.top = 1 << n.bit_length()

    def take(self, place: int) -> None:
        self.free[place] = False
        i = place + 1
        while i <= self.n:
            self.sums[i] -= 1
            i += i & -i

    def before(self, place: int) -> int:
        total = 0
        while place:
            total += self.sums[place]
            place &= place - 1
        return total

    def first_from(self, place: int) -> int:
        left, at, step = self.before(place), 0, self.top
        while step:
            if at + step <= self.n and self.sums[at + step] <= left:
                at += step
                left -= self.sums[at]
            step >>= 1
        return at


def _beginnings(rows: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """rows with beginning: the first n characters of a text for each n of lengths that it has."""
    each = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(text))
    return rows.withColumn("_n", F.explode(each)).withColumn("beginning", F.substring(F.col(text), F.lit(1), F.col("_n"))).drop("_n")


def _passes(rows: DataFrame) -> DataFrame:
    """(folder, name, asker) as the sequential rule gives them, for each family by itself.

    Rows of a family stream through one task: its names first, then those that
    ask, in their order. The task holds the family's names and which are free.
    """
    ordered = rows.repartition("folder", "family").sortWithinPartitions("folder", "family", "asks", F.when(~F.col("asks"), F.col("text")), "asker")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, places = None, [], None
        for batch in batches:
            rows, taken = [], []
            for row, (folder, family, asks, text, whole) in enumerate(zip(*(batch[c].to_pylist() for c in ("folder", "family", "asks", "text", "whole")))):
                if (folder, family) != now:
                    now, names, places = (folder, family), [], None
                if not asks:
                    names.append(text)
                    continue
                places = places or FreePlaces(len(names))
                low = bisect_left(names, text)
                if whole:
                    at = low if places.free[low] else None
                else:
                    high = bisect_right(names, text, low, key=lambda name: name[: len(text)])
                    at = places.first_from(low) if places.before(high) - places.before(low) == 1 else None
                if at is not None:
                    places.take(at)
                    rows.append(row)
                    taken.append(names[at])
            gone = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([gone["folder"], pa.array(taken, pa.string()), gone["asker"]], ["folder", "name", "asker"])

    return ordered.mapInArrow(run, f"folder string, name string, asker {rows.schema['asker'].dataType.simpleString()}")


def assign_names(names: DataFrame, askers: DataFrame, eliminations: int = 4) -> DataFrame:
    """(folder, name, asker): who gets which name, as one pass over the askers in their order would give them.

    names: folder, name, distinct and not null. askers: folder, asker (any type
    that sorts, distinct), name, beginning. An asker whose name is in its folder
    gets that if it's still free, else nothing. Any other gets the only name
    left in its folder with its beginning; if none or several are left, nothing;
    nor does one with an empty or null beginning.

    What an asker gets may hang on all before it, but seldom does. Askers by
    whole names that no live beginning touches are settled by an aggregate. An
    asker by beginning is dead if its names outnumber by two or more all who
    could take them, directly or by a shorter or longer beginning; counts by
    beginning tell, and since the dead take nothing, each elimination may find
    more. Beginnings nest or are apart, so what is left falls into families
    below the shortest live beginning of each, and only those go through the
    sequential rule, one family in a task. A family has at most a name more
    than askers.
    """
    asked = askers.select("folder", "asker", "name", "beginning").join(names.select("folder", "name", F.lit(True).alias("whole")), ["folder", "name"], "left")
    asked = staged(asked.withColumn("whole", F.coalesce("whole", F.lit(False))))
    whole, guesses = asked.where("whole"), asked.where("not whole and beginning <> ''")
    nodes = staged(guesses.groupBy("folder", "beginning").agg(F.count("*").alias("own")))
    lengths = sorted(r[0] for r in nodes.select(F.length("beginning")).distinct().collect())  # as many as a file name is long
    first = whole.groupBy("folder", "name").agg(F.min("asker").alias("asker"))
    if not lengths:
        return first
    key = ["folder", "beginning"]
    inside = staged(_beginnings(names.join(first.select("folder", "name", F.lit(1).alias("direct")), ["folder", "name"], "left"), "name", lengths).join(nodes.select(key), key, "left_semi"))
    nested = _beginnings(nodes.select("folder", F.col("beginning").alias("longer"), F.col("own").alias("longer_own")), "longer", lengths)
    nested = staged(nested.join(nodes.withColumnRenamed("own", "shorter_own"), key))
    counted = inside.groupBy(*key).agg(F.count("*").alias("names"), F.count("direct").alias("direct"))
    live = staged(nodes.join(counted, key))
    n = live.count()
    for _ in range(eliminations):
        alive = live.select(key)
        pairs = nested.join(alive, key, "left_semi").join(alive.withColumnRenamed("beginning", "longer"), ["folder", "longer"], "left_semi").where("longer <> beginning")
        below = pairs.groupBy(*key).agg(F.sum("longer_own").alias("below"))
        above = pairs.groupBy("folder", F.col("longer").alias("beginning")).agg(F.sum("shorter_own").alias("above"))
        takers = F.col("direct") + F.col("own") - 1 + F.coalesce("below", F.lit(0)) + F.coalesce("above", F.lit(0))
        live = staged(live.join(below, key, "left").join(above, key, "left").where(F.col("names") - takers < 2).select(live.columns))
        before, n = n, live.count()
        if n == before:
            break
    if not n:
        return first
    short: Column = F.min_by("beginning", F.length("beginning")).alias("family")
    named = staged(inside.join(live.select(key), key, "left_semi").groupBy("folder", "name").agg(short))
    roots = nested.join(live.select(key), key, "left_semi").groupBy("folder", F.col("longer").alias("beginning")).agg(short)
    asks = guesses.join(live.select(key), key, "left_semi").join(roots, key).select("folder", "family", F.lit(True).alias("asks"), F.col("beginning").alias("text"), "whole", "asker")
    asks = asks.unionByName(whole.join(named, ["folder", "name"]).select("folder", "family", F.lit(True).alias("asks"), F.col("name").alias("text"), "whole", "asker"))
    rows = named.select("folder", "family", F.lit(False).alias("asks"), F.col("name").alias("text"), F.lit(False).alias("whole"), F.lit(None).cast(asks.schema["asker"].dataType).alias("asker"))
    return first.join(named, ["folder", "name"], "left_anti").unionByName(_passes(rows.unionByName(asks)))
