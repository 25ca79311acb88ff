"""New members as a stream: each file's bytes are reported once, late copies within the watermark too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_new(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Rows of Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def first_seen(rows: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each md5 that the stream meets, for as long as the watermark keeps it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["md5"])


def counts(rows: DataFrame, time: str, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows and bytes by window and extension."""
    return rows.withWatermark(time, late).groupBy(F.window(time, every), "ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def append_new(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now to Parquet, exactly once, and stop."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
