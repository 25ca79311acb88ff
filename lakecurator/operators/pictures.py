"""Perceptual hashes of pictures: what is missing is made once, in a scan of the files, and kept."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import rotation_hashes
from ..plans.staging import staged

#: Gray values of a picture: 8 rows of 9, and 9 rows of 8.
Renderer = Callable[[bytes], tuple[list[int], list[int]]]
#: Longest text of a failure that is kept.
ERROR_LENGTH = 300
CACHE = "key string, hashes array<bigint>, error string"


def rendered(data: bytes) -> tuple[list[int], list[int]]:
    """The two gray renderings of a picture in any format that Pillow opens."""
    from PIL import Image

    with Image.open(io.BytesIO(data)) as image:
        gray = image.convert("L")
        return tuple(list(gray.resize(size, Image.LANCZOS).tobytes()) for size in ((9, 8), (8, 9)))


def hash_pictures(pictures: DataFrame, render: Renderer = rendered) -> DataFrame:
    """key, hashes (of the four rotations) and error of pictures (key, content).

    Files are decoded in Arrow batches; hashes are an expression over the gray
    values. A picture that can't be decoded has an error instead of hashes.
    """
    schema = pa.schema([("key", pa.string()), ("wide", pa.list_(pa.int32())), ("tall", pa.list_(pa.int32())), ("error", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch["key"].to_pylist(), batch["content"]):
                row = {"key": key, "wide": None, "tall": None, "error": None}
                try:
                    row["wide"], row["tall"] = render(data.as_py() or b"")
                except Exception as failure:  # kept, so that the file goes to review and isn't tried again
                    row["error"] = f"{type(failure).__name__}: {failure}"[:ERROR_LENGTH]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    gray = pictures.select(F.col("key").cast("string").alias("key"), "content").mapInArrow(decode, "key string, wide array<int>, tall array<int>, error string")
    hashes = F.when(F.col("error").isNull(), rotation_hashes(F.col("wide"), F.col("tall")))
    return gray.select("key", hashes.alias("hashes"), "error")


def cached_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The hashes that are kept in a folder; empty where none were made yet."""
    try:
        return spark.read.schema(CACHE).parquet(folder)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CACHE)


def hashes_aside(wanted: DataFrame, folder: str, read: Callable[[DataFrame], DataFrame], render: Renderer = rendered) -> DataFrame:
    """key, hashes, error of the wanted keys, of which only those that the folder lacks are read and hashed.

    read: takes missing keys (key) and gives their files (key, content), for
    example through sources.archives.contents(). New rows are appended to the
    folder before they are used, so a run that stops keeps what its finished
    jobs made. Failures are kept too: they aren't tried again.
    """
    spark = wanted.sparkSession
    keys = staged(wanted.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct())
    missing = staged(keys.join(cached_hashes(spark, folder).select("key"), "key", "left_anti"))
    if not missing.isEmpty():
        hash_pictures(read(missing), render).write.mode("append").parquet(folder)
    return keys.join(cached_hashes(spark, folder), "key", "left")
