"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecurator.llm import classifier
from lakecurator.llm.common import cut, table
from lakecurator.llm.decontaminate import decontaminate, row_key
from lakecurator.llm.near_duplicates import near_duplicates
from lakecurator.llm.packing import pack
from lakecurator.llm.queries import tokenizer_file
from lakecurator.llm.repeats import remove_repeats
from lakecurator.llm.storage import new_folder
from lakecurator.llm.token_counts import token_counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score reaches the threshold.

    Every row is judged by its whole text, whatever its id; null and empty
    texts are scored as texts without words. Columns besides those of
    documents are left out, as in all stages; an empty table stays empty.
    """
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.classify(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near duplicates (five-word shingles, 0.8 or more).

    Rows are told apart by 128 bits of doc_id and text. Rows equal in both stay
    once, and a null doc_id comes after all others in its group. Both are
    elected by aggregates, so a large group of copies is never gathered. Near
    duplicates are found among numbered rows, so no two share a key. Null
    and empty texts are alike no other, so each row of them stays that isn't
    equal to another; very long texts are compared whole.
    """
    row = F.struct(*[c for c in COLUMNS if c not in ("doc_id", "text")], "doc_id", "text")
    unique = docs.select(*COLUMNS).groupBy("doc_id", F.col("text").isNull(), row_key()).agg(F.min(row).alias("_row"))
    unique = cut(unique.select(F.monotonically_increasing_id().alias("_key"), "_row.*"))
    found = near_duplicates(unique.select(F.col("_key").alias("doc_id"), "text"), n=5, part=80, whole=100)
    placed = found.select(F.col("doc_id").alias("_key"), "component_id").join(unique.select("_key", "doc_id"), "_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_key"))["_key"]
    kept = placed.groupBy("component_id").agg(first.alias("_key")).select("_key")
    return unique.join(kept, "_key", "left_semi").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that occur twice; texts that lose nothing stay as they are.

    No row goes: a text that loses every word, or is null, becomes empty.
    """
    found = remove_repeats(docs, window=35, keep=["lang", "source", "n_chars"], original=True)
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a twentieth or more of benchmark windows, each row judged by itself, whatever its id."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), key="_key").where("contaminated").select("_key")
    return docs.select(*COLUMNS).withColumn("_key", row_key()).join(found, "_key", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left; null and empty texts have length 0."""
    return pack(token_counts(docs, tokenizer_file("byte_bpe_50k.tiktoken"), whole=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near duplicates", one_of_each),
    ("repeated passages", without_repeats),
    ("benchmark decontamination", uncontaminated),
    ("packing", packed),
]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
