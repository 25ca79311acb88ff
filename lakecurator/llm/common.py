"""Session, storage and graph helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import Scan
from ..plans.staging import run_folder

#: Rows of an Arrow batch. Texts differ by orders of magnitude, so batches stay short to bound a task's memory.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and make sure that a shared checkpoint folder is set."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Where that is unset, as in local tests, a temporary folder is made and set.
    On a cluster executors wouldn't share it, so there the setting must be given.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lakecurator-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder, so that nothing before it is run or planned again.

    checkpoint() would keep the constraints of the plan before it, which
    multiply from round to round of an iteration until planning takes longer
    than the work. Tables of an application lie together: see clean_up().
    """
    shared_dir(df.sparkSession)
    folder = f"{run_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for a function that yields dicts of columns for each batch."""
    prepare(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(arrow, (columns[f.name] for f in arrow))], schema=arrow)

    return df.mapInArrow(run, schema)


class Carried:
    """Columns that a task hands on: under neutral names inside, so that no name clashes, and restored after."""

    def __init__(self, df: DataFrame, keep: list[str], own: list[str]):
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        self.names = [f"_x{i}" for i in range(len(keep))]
        self.columns = [F.col(f"`{c}`").alias(x) for c, x in zip(keep, self.names)]
        self.ddl = [f"{x} {kinds[c]}" for c, x in zip(keep, self.names)]
        self._after: dict[str, str] = {}
        for c, x in sorted(zip(keep, self.names), key=lambda pair: pair[0] in own):  # names that needn't change come first
            while c in own or c in self._after.values():
                c = f"{c}_in"
            self._after[x] = c

    def restored(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(self._after.get(c, c)) for c in df.columns])


def packed_texts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, z) and long columns to keep: texts compressed before a shuffle that must move them; null is an empty text."""
    keep = keep or []

    def pack(batch: pa.RecordBatch) -> Iterator[dict]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        yield {c: batch[c] for c in ["doc_id", *keep]} | {"z": [squeeze((x or "").encode()) for x in batch["text"].to_pylist()]}

    return with_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep), pack, ", ".join([f"{c} long" for c in ["doc_id", *keep]]) + ", z binary")


def unpacked(column: pa.Array) -> pa.Array:
    """The texts of a batch of packed_texts()."""
    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([expand(x) if x else b"" for x in column.to_pylist()], pa.large_binary()).cast(pa.large_string())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable.

    Each round the nodes whose label fell tell their neighbours, then every
    label follows its own label, so chains shorten by doubling. What didn't
    change isn't sent again. Labels are aggregated before every shuffle and no
    round gathers a node's neighbours.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component"), F.col("node").alias("was")))
    while not labels.where("component <> was").isEmpty():
        fell = labels.where("component <> was").select(F.col("node").alias("b"), "component")
        near = both.join(fell, "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        lower = labels.join(near, "node", "left").select("node", F.least("component", "least").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = cut(lower.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"), "was"))
    return labels.select("node", "component")


def ranks(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add rank, gapless from 0 within each group in the order of columns that tell rows apart, without bringing a group into one task.

    Rows are cut into ranges of group and order; counts of the ranges before
    are summed for each group, and only the rows of one range are numbered together.
    """
    return Scan(df, [group], [F.asc(c) for c in order], key_rows=0).running("rank", F.lit(1)).done().withColumn("rank", F.col("rank") - 1)
