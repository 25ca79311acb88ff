"""Running values along the rows of each key, without bringing a large key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged

#: Where no key has more rows, a plain window sorts each key in a task; results are the same.
KEY_ROWS = 100_000
#: Columns of a scan's own: the range of a row, and what a range is handed.
RANGE, CARRY = "_range", "_scan_carry"


class Scan:
    """Rows in the order of each key, to which columns are added that hang on the rows before.

    Rows are cut into ranges of keys and order, so a large key fills many of
    them. What runs along a key is worked out inside the ranges, and what a
    range of a key hands on is one row: its total or its last values. These
    carries are combined over a key's ranges, of which there are no more than
    partitions, and joined back. The order must be total within a key; null
    keys are a key of their own.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[Column], key_rows: int | None = None):
        self.keys, self.order = keys, order
        largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        self.whole = largest <= (KEY_ROWS if key_rows is None else key_rows)
        self.rows = df if self.whole else staged(df.repartitionByRange(*[F.col(k).asc() for k in keys], *order).withColumn(RANGE, F.spark_partition_id()))

    def _with(self, rows: DataFrame) -> Scan:
        new = object.__new__(Scan)
        new.keys, new.order, new.whole, new.rows = self.keys, self.order, self.whole, rows
        return new

    def _carried(self, rows: DataFrame, carries: DataFrame, keys: list[str]) -> DataFrame:
        """rows with the CARRY of carries, which bear the names of _ranges_of()."""
        same = F.col(RANGE) == F.col(f"{RANGE}_of")
        for key, of in zip(keys, self._names(keys)):
            same = same & F.col(key).eqNullSafe(F.col(of))
        return rows.join(carries, same, "left").drop(f"{RANGE}_of", *self._names(keys))

    def _names(self, keys: list[str]) -> list[str]:
        """What keys are called in carries: by place, so that no key's name can meet another column's."""
        return [f"_scan_key{i}" for i in range(len(keys))]

    def _ranges_of(self, keys: list[str]) -> list[Column]:
        return [*[F.col(k).alias(of) for k, of in zip(keys, self._names(keys))], F.col(RANGE).alias(f"{RANGE}_of")]

    def running(self, name: str, value: Column, also: list[str] | None = None) -> Scan:
        """Add the sum of value over the rows up to and with this one; `also` names columns that end a sum where they change.

        Equal values of those must lie next to each other in the order.
        """
        keys = [*self.keys, *(also or [])]
        along = Window.partitionBy(*keys, *([] if self.whole else [RANGE])).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self.rows.withColumn(name, F.sum(value).over(along).cast("long"))
        if self.whole:
            return self._with(rows)
        totals = self.rows.groupBy(*self._ranges_of(keys)).agg(F.sum(value).alias(CARRY))
        before = Window.partitionBy(*self._names(keys)).orderBy(f"{RANGE}_of").rowsBetween(Window.unboundedPreceding, -1)
        bases = totals.withColumn(CARRY, F.sum(CARRY).over(before))
        return self._with(self._carried(rows, bases, keys).withColumn(name, F.col(name) + F.coalesce(CARRY, F.lit(0))).drop(CARRY))

    def lagged(self, **values: Column) -> Scan:
        """Add the values of the row before under the names given, and `at_first`, true for a key's first row."""
        last = F.struct(*[v.alias(k) for k, v in values.items()])
        along = Window.partitionBy(*self.keys, *([] if self.whole else [RANGE])).orderBy(*self.order)
        rows = self.rows.withColumn("_scan_lag", F.lag(last).over(along))
        if not self.whole:
            ends = self.rows.withColumn(CARRY, last).withColumn("_scan_n", F.row_number().over(along))
            ends = ends.groupBy(*self._ranges_of(self.keys)).agg(F.max_by(CARRY, "_scan_n").alias(CARRY))
            ranges = Window.partitionBy(*self._names(self.keys)).orderBy(f"{RANGE}_of")
            rows = self._carried(rows, ends.withColumn(CARRY, F.lag(CARRY).over(ranges)), self.keys)
            rows = rows.withColumn("_scan_lag", F.coalesce("_scan_lag", CARRY)).drop(CARRY)
        out = rows.withColumn("at_first", F.col("_scan_lag").isNull())
        for k in values:
            out = out.withColumn(k, F.col("_scan_lag")[k])
        return self._with(out.drop("_scan_lag"))

    def done(self) -> DataFrame:
        return self.rows if self.whole else self.rows.drop(RANGE)
