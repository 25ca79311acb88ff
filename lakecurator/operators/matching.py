"""One-to-one matching: closest pairs first, each side used once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged


def greedy_one_to_one(pairs: DataFrame, left: str, right: str, order: list[str], rounds: int = 8) -> DataFrame:
    """The pairs that a pass in (order, left, right) takes if it takes a pair when both sides are still free.

    The order is total, so the pass takes exactly the pairs that stand first
    for both of their sides, drops what those sides take part in, and goes on.
    A round does this everywhere at once by two window minima and two anti
    joins. Ties and chains of rising values settle only a pair or two a round,
    so after `rounds` of them the pass itself is run over what is left, for
    each connected component by itself: see _passes(). A side's candidates meet
    in one window, so blocks bound them: see within_window() and equal names.
    """
    rank = F.struct(*[F.col(c) for c in [*order, left, right]])
    rest = staged(pairs.dropDuplicates([left, right]))
    taken = None
    for _ in range(rounds):
        ranked = rest.withColumn("_rank", rank)
        best = [ranked.groupBy(side).agg(F.min("_rank").alias("_rank")) for side in (left, right)]
        first = best[0].join(best[1].select(F.col(right).alias("_other"), F.col("_rank").alias("_theirs")), F.col("_rank") == F.col("_theirs")).select("_rank.*")
        round_ = staged(rest.join(first.select(left, right), [left, right], "left_semi"))
        if round_.isEmpty():
            return taken if taken is not None else rest.limit(0)
        taken = round_ if taken is None else taken.unionByName(round_)
        rest = staged(rest.join(round_.select(left), left, "left_anti").join(round_.select(right), right, "left_anti"))
    if rest.isEmpty():
        return taken if taken is not None else rest
    settled = staged(_passes(rest, left, right, order))
    return settled if taken is None else taken.unionByName(settled)


def _components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(left, _component): the smallest left that pairs lead to. Labels follow their own labels, so chains shorten by doubling."""
    ends = pairs.select(left, right)
    labels = staged(ends.select(left).distinct().withColumn("_component", F.col(left)))
    while True:
        near = ends.join(labels, left).groupBy(right).agg(F.min("_component").alias("_least"))
        lower = ends.join(near, right).groupBy(left).agg(F.min("_least").alias("_least"))
        lower = labels.withColumnRenamed("_component", "_was").join(lower, left)
        jump = labels.select(F.col(left).alias("_least"), F.col("_component").alias("_further"))
        stepped = staged(lower.join(jump, "_least").select(left, F.least("_least", "_further").alias("_component"), "_was"))
        labels = stepped.select(left, "_component")
        if stepped.where("_component <> _was").isEmpty():
            return labels


def _passes(pairs: DataFrame, left: str, right: str, order: list[str]) -> DataFrame:
    """The pairs that the pass takes, run component by component.

    A component's pairs stream through one task in their order. Spark sorts
    them and spills; the task holds the ids of the pairs it took and a batch.
    """
    columns = pairs.columns
    sorted_ = pairs.join(_components(pairs, left, right), left).repartition("_component").sortWithinPartitions("_component", *order, left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lefts, rights = None, set(), set()
        for batch in batches:
            taken = []
            for component, x, y in zip(*[batch[c].to_pylist() for c in ("_component", left, right)]):
                if component != now:
                    now, lefts, rights = component, set(), set()
                free = x not in lefts and y not in rights
                taken.append(free)
                if free:
                    lefts.add(x)
                    rights.add(y)
            yield batch.filter(pa.array(taken, pa.bool_())).select(columns)

    return sorted_.mapInArrow(run, pairs.schema)


def within_window(left: DataFrame, right: DataFrame, left_time: str, right_time: str, window: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose times differ by at most `window`, both ends included, with equal keys.

    A range join as an equi join: time is cut into cells as wide as the window
    and the left row looks into its own and the two beside it. Column names
    of the two sides, keys apart, must differ.
    """
    width = max(1, window)
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    near = left.withColumn("_cell", F.explode(F.array(*[cell(left_time) + i for i in (-1, 0, 1)])))
    met = near.join(right.withColumn("_cell", cell(right_time)), ["_cell", *(keys or [])])
    return met.where(F.abs(F.col(left_time) - F.col(right_time)) <= window).drop("_cell")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")
