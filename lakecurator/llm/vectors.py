"""Embeddings as whole numbers, for the operators that compare vectors exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A component beyond this many units counts as this many, so that products and sums stay exact in 64 bits.
LIMIT = 1 << 24


def whole_vectors(embeddings: DataFrame, factor: int = 256) -> DataFrame:
    """vec_id, label and v (array of int: floor(factor * x) of each component) of rows whose vector is whole.

    Rows whose vector is null or holds a null, NaN or infinite component go.
    Components are clipped to LIMIT units, which is 65,536 for a factor of 256.
    """
    inf, most = float("inf"), LIMIT / factor
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf))
    unit = lambda x: F.floor(F.greatest(F.least(x.cast("double"), F.lit(most)), F.lit(-most)) * factor).cast("int")
    return embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", unit).alias("v"))
