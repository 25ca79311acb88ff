"""The report: one outcome for every source file, and counts that add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import file_type
from .scans import Scan

#: Outcomes in a reader's order; every file has exactly one.
OUTCOMES = [
    "already there (same file)",
    "already there (same picture)",
    "clip already beside its still",
    "uploaded into a dated album",
    "uploaded into an undated album",
    "not uploaded yet",
    "held for review",
    "duplicate within the source",
    "skipped by a policy",
    "upload failed",
    "not planned",
]
#: Upload states on their way.
PENDING = ("planned", "staged", "uploading", "unknown")


def classify(sources: DataFrame, uploads: DataFrame, matches: DataFrame, undated: list[str]) -> DataFrame:
    """(ref, type, outcome) of each source.

    sources: ref, kind (photo, video, clip), still_ref, policy_skip. uploads:
    source_ref, role, status, target_name; of several roles the last by name
    counts. matches: ref, decision. A clip goes by its still's decision.
    """
    last = uploads.groupBy(F.col("source_ref").alias("ref")).agg(F.max_by(F.struct("status", "target_name"), F.col("role")).alias("up"))
    known = sources.withColumn("_of", F.when(F.col("kind") == "clip", F.coalesce("still_ref", "ref")).otherwise(F.col("ref")))
    joined = known.join(last, "ref", "left").join(matches.select(F.col("ref").alias("_of"), "decision"), "_of", "left")
    status, decision, skip = F.col("up.status"), F.col("decision"), F.coalesce("policy_skip", F.lit(""))
    uploaded = (
        F.when(status == "done", F.when(F.col("up.target_name").isin(*undated), OUTCOMES[4]).otherwise(OUTCOMES[3]))
        .when(status.isin(*PENDING), OUTCOMES[5])
        .when(status.isin("needs_review", "held"), OUTCOMES[6])
        .when(status == "skipped", OUTCOMES[8])
        .otherwise(OUTCOMES[9])
    )
    clip = F.when(skip == "live_clips", OUTCOMES[8]).when(decision.isin("exact", "same"), OUTCOMES[2]).when(decision == "review", OUTCOMES[6]).when(skip != "", OUTCOMES[8]).otherwise(OUTCOMES[10])
    plain = F.when(decision == "exact", OUTCOMES[0]).when(decision == "same", OUTCOMES[1]).when(decision == "source_duplicate", OUTCOMES[7]).when(decision == "review", OUTCOMES[6]).when(skip != "", OUTCOMES[8]).otherwise(OUTCOMES[10])
    outcome = F.when(F.col("up").isNotNull(), uploaded).when(F.col("kind") == "clip", clip).otherwise(plain)
    return joined.select("ref", file_type(F.col("ref"), F.col("kind")).alias("type"), outcome.alias("outcome"))


def accounting(classified: DataFrame, label: str = "type", outcome: str = "outcome", outcomes: list[str] = OUTCOMES) -> DataFrame:
    """A row for each type, then 'all files': total, and a count for each outcome, largest type first."""
    counts = [F.count_if(F.col(outcome) == o).alias(o) for o in outcomes]
    table = classified.rollup(label).agg(F.grouping(label).alias("_all"), F.count("*").alias("total"), *counts)
    return table.withColumn(label, F.when(F.col("_all") == 1, "all files").otherwise(F.col(label))).orderBy("_all", F.desc("total"), label).drop("_all")


def adds_up(table: DataFrame, outcomes: list[str] = OUTCOMES) -> bool:
    """Whether the outcomes of every row sum to its total."""
    return table.where(sum((F.col(f"`{o}`") for o in outcomes), F.lit(0)) != F.col("total")).isEmpty()


def checked(table: DataFrame, outcomes: list[str] = OUTCOMES) -> DataFrame:
    """table, which fails where it is computed if the outcomes of a row don't sum to its total."""
    sum_ = sum((F.col(f"`{o}`") for o in outcomes), F.lit(0))
    wrong = F.raise_error(F.format_string("the outcomes of a type sum to %d, not to %d", sum_, F.col("total")))
    return table.withColumn("total", F.when(sum_ == F.col("total"), F.col("total")).otherwise(wrong.cast("long")))


def histograms(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """of, the columns, n: the counts of several groupings in one scan; `of` names the columns of a row's grouping, the others are null."""
    columns = list(dict.fromkeys(c for names in sets for c in names))
    grouped = df.groupingSets(sets, *columns).agg(*[F.grouping(c).alias(f"_{c}") for c in columns], F.count("*").alias("n"))
    of = F.concat_ws(", ", *[F.when(F.col(f"_{c}") == 0, c) for c in columns])
    return grouped.select(of.alias("of"), *columns, "n")


def clip_bucket() -> Column:
    """How far a clip is from its still, from the reason of its upload; null for other reasons."""
    gap = F.regexp_extract("reason", r"Live Photo clip, (\d+)s from its still", 1).try_cast("int")
    return F.when(gap == 0, "0 s").when(gap == 1, "1 s").when(gap <= 5, "2-5 s").when(gap <= 30, "6-30 s").when(gap.isNotNull(), "31-60 s")


def clip_gaps(uploads: DataFrame) -> DataFrame:
    """(bucket, n) of the seconds between clips and their stills, read from upload reasons."""
    return uploads.select(clip_bucket().alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def date_method() -> Column:
    """How a moved or collected item was dated, from the plan's reason; null for other actions."""
    method = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("reason", F.lit("")), r"^date via ([a-z_]+)", 1), F.lit("")), F.lit("other"))
    return F.when(F.col("action").isin("move", "collect"), method)


def dated_by(plan: DataFrame) -> DataFrame:
    """(method, n): how moved and collected items were dated."""
    return plan.select(date_method().alias("method")).where("method is not null").groupBy("method").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def target_progress(targets: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target: rows, done, collected; sums are null, as in SQL, for a target without rows."""
    counts = plan.groupBy(F.col("target_name").alias("name")).agg(F.count("*").alias("n"), F.sum((F.col("status") == "done").cast("long")).alias("done"), F.sum((F.col("action") == "collect").cast("long")).alias("collected"))
    return targets.join(counts, "name", "left").select("name", "kind", F.coalesce("n", F.lit(0)).alias("n"), "done", "collected")


def kinds_of_targets(targets: DataFrame) -> DataFrame:
    return targets.groupBy("kind").agg(F.count("*").alias("n"), F.sum("planned").alias("planned"), F.min("planned").alias("least"), F.max("planned").alias("most"))


def pending_work(uploads: DataFrame, plan: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: how much is still to do in all three tables."""
    parts = [uploads.where(F.col("status").isin(*PENDING)), plan.where(F.col("status").isin("pending", "in_progress", "unknown")), changes.where("status = 'planned'")]
    total = None
    for part in parts:
        one = part.agg(F.count("*").alias("n"))
        total = one if total is None else total.unionByName(one)
    return total.agg(F.sum("n").alias("pending"))


def median_date(dates: DataFrame, key: str, date: Column, least: int = 5, most_days: int = 45) -> DataFrame:
    """Per key: n, spread in days, and the median date where there are `least` dates within `most_days`; halves round to even."""
    days = F.unix_date(date)
    known = dates.select(key, days.alias("_d")).where("_d is not null")
    out = known.groupBy(key).agg(F.count("*").alias("n"), F.min("_d").alias("first"), F.max("_d").alias("last"), F.median("_d").alias("mid"))
    close = (F.col("n") >= least) & (F.col("last") - F.col("first") <= most_days)
    return out.select(key, "n", (F.col("last") - F.col("first")).alias("spread"), F.when(close, F.date_from_unix_date(F.col("first") + F.bround(F.col("mid") - F.col("first")).cast("int"))).alias("median_date"))


def page_sample(items: DataFrame, key: str, order: list[Column], pages: int, size: int = 20, seed: int = 0) -> DataFrame:
    """A page of `size` items from each of `pages` equal slices of every key's items, chosen by a seeded hash, MD5, which any engine has."""
    from pyspark.sql import Window

    placed = Scan(items, [key], order).running("_page", F.lit(1)).done().withColumn("_page", F.floor((F.col("_page") - 1) / size))
    listed = placed.select(key, "_page").distinct().withColumn("_slice", F.ntile(pages).over(Window.partitionBy(key).orderBy("_page")))
    chosen = listed.groupBy(key, "_slice").agg(F.min_by("_page", F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("_page").cast("string"))), "_page")).alias("_page"))
    return placed.join(chosen, [key, "_page"]).drop("_page", "_slice")


def seeded_sample(items: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if fewer), the same for the same seed."""
    return items.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
