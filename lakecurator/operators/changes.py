"""The change log: newest changes, runs that can be undone, batches, and state that a plan merges into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import Scan

#: Plan states whose work has begun.
STARTED = ("done", "in_progress", "unknown")


def newest(changes: DataFrame) -> DataFrame:
    """The change with the largest change_id for each album and setting, or album and other kind.

    Found by an aggregate and a join back on the id, so a long history of one key isn't sorted.
    """
    keyed = changes.withColumn("_field", F.when(F.col("kind") == "setting", F.col("field")))
    last = keyed.groupBy("album_id", "kind", "_field").agg(F.max("change_id").alias("change_id")).select("change_id")
    return changes.join(last, "change_id", "left_semi")


def linked_runs(changes: DataFrame, keys: list[str]) -> DataFrame:
    """changes with linked and before: which of the newest changes of a key hang together, and the value before them.

    From the newest on, an older change is linked while its new value is the
    old value of the change after it.
    """
    along = Scan(changes, keys, [F.desc("change_id")]).lagged(_later=F.col("old_value"))
    broken = F.when(F.col("at_first"), 0).otherwise((~F.col("new_value").eqNullSafe(F.col("_later"))).cast("int"))
    marked = along.running("_broken", broken).done()
    marked = marked.withColumn("linked", F.col("_broken") == 0).drop("_broken", "_later", "at_first")
    start = marked.where("linked").groupBy(*keys).agg(F.min_by("old_value", "change_id").alias("before"))
    return marked.join(start, keys)


def batches(rows: DataFrame, within: list[str], order: list[Column], same: list[str], size: int) -> DataFrame:
    """rows with island and batch: consecutive rows with equal `same` columns, at most `size` to a batch."""
    along = Scan(rows, within, order).lagged(**{f"_same{i}": F.col(c) for i, c in enumerate(same)})
    changed = F.col("at_first")
    for i, column in enumerate(same):
        changed = changed | ~F.col(column).eqNullSafe(F.col(f"_same{i}"))
    along = along.running("island", changed.cast("int")).running("_place", F.lit(1), ["island"])
    return along.done().withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("long")).drop("at_first", "_place", *[f"_same{i}" for i in range(len(same))])


def merge_plan(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The plan after planning again; item_id, action, target_name, reason, keeper_item_id, status, changed.

    Work that has begun stays as it is. A pending or failed item with the same
    target keeps its status and takes the new action and reason. All else
    fresh becomes pending. Stored items that aren't planned again stay.
    """
    columns = ["action", "target_name", "reason", "keeper_item_id", "status"]
    s = stored.select("item_id", *[F.col(c).alias(f"s_{c}") for c in columns], F.lit(True).alias("_s"))
    f = fresh.select("item_id", *[F.col(c).alias(f"f_{c}") for c in columns[:-1]], F.lit(True).alias("_f"))
    both = s.join(f, "item_id", "full_outer")
    stays = F.col("_f").isNull() | F.coalesce(F.col("s_status").isin(*STARTED), F.lit(False))
    refreshed = F.coalesce((F.col("s_target_name") == F.col("f_target_name")) & F.col("s_status").isin("pending", "failed"), F.lit(False))
    out = [F.when(stays, F.col(f"s_{c}")).otherwise(F.col(f"f_{c}")).alias(c) for c in columns[:-1]]
    status = F.when(stays | refreshed, F.col("s_status")).otherwise("pending").alias("status")
    return both.select("item_id", *out, status, (~stays & ~refreshed).alias("changed"))


def merge_targets(stored: DataFrame, plan: DataFrame, kinds: DataFrame) -> DataFrame:
    """Targets (name, kind, album_id, planned) recounted from a plan; those never built and without plan rows go."""
    counts = plan.groupBy(F.col("target_name").alias("name")).agg(F.count("*").alias("n"))
    named = kinds.groupBy(F.col("target_name").alias("name")).agg(F.max("kind").alias("new_kind"))
    both = stored.join(counts, "name", "full_outer").join(named, "name", "left")
    kept = both.where("n is not null or album_id is not null")
    return kept.select("name", F.coalesce("new_kind", "kind").alias("kind"), "album_id", F.coalesce("n", "planned").cast("long").alias("planned"))


def merge_items(stored: DataFrame, seen: DataFrame, fixed: list[str]) -> DataFrame:
    """Inventory upsert by item_id: what was seen replaces what is stored, but for the columns in fixed, which keep their first value."""
    rest = [c for c in seen.columns if c != "item_id"]
    s = stored.select("item_id", *[F.col(c).alias(f"s_{c}") for c in rest], F.lit(True).alias("_s"))
    f = seen.withColumn("_f", F.lit(True))
    pick = [F.when(F.col("_s") & (F.col("_f").isNull() | F.lit(c in fixed)), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in rest]
    return s.join(f, "item_id", "full_outer").select("item_id", *pick)


def reconcile(plan: DataFrame, observed: DataFrame) -> DataFrame:
    """What became of rows of unknown outcome: done where the target holds them, pending where another album does, else failed.

    plan: item_id, target_name, status; observed: item_id, album.
    """
    unknown = plan.where(F.col("status").isin("in_progress", "unknown"))
    seen = observed.groupBy("item_id").agg(F.collect_set("album").alias("albums"))
    found = F.when(F.array_contains("albums", F.col("target_name")), "done").when(F.size("albums") > 0, "pending").otherwise("failed")
    return unknown.join(seen, "item_id", "left").select("item_id", "target_name", found.alias("status"))


def verify_membership(expected: DataFrame, observed: DataFrame, before: DataFrame) -> DataFrame:
    """(target, item_id, problem): expected items that an album lacks, and items it has that nobody expected or saw before."""
    keys = ["target", "item_id"]
    missing = expected.select(keys).distinct().join(observed.select(keys), keys, "left_anti").withColumn("problem", F.lit("missing"))
    extra = observed.select(keys).distinct().join(expected.select(keys), keys, "left_anti").join(before.select(keys), keys, "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def unsafe_deletions(plan: DataFrame, targets: DataFrame, observed: DataFrame) -> DataFrame:
    """Parked duplicates whose keeper isn't verified at the destination: done, in a built album, and listed there."""
    parked = plan.where("action = 'park_duplicate' and status = 'done'").select("item_id", "keeper_item_id")
    keepers = plan.where("status = 'done'").select(F.col("item_id").alias("keeper_item_id"), F.col("target_name").alias("name")).join(targets.where("album_id is not null").select("name", "album_id"), "name")
    safe = keepers.join(observed.select(F.col("item_id").alias("keeper_item_id"), "album_id"), ["keeper_item_id", "album_id"], "left_semi")
    return parked.join(safe.select("keeper_item_id"), "keeper_item_id", "left_anti")


def release_answered_holds(uploads: DataFrame, decisions: DataFrame) -> DataFrame:
    """Held uploads with a decision that no longer asks for review: upload_id and the decision of the row, or of its pair."""
    held = uploads.where("status = 'needs_review'").withColumn("ref", F.coalesce("pair_ref", "source_ref"))
    return held.join(decisions.select("ref", "decision"), "ref").where("decision <> 'review'").select("upload_id", "decision")


def unused_targets(targets: DataFrame, plan: DataFrame) -> DataFrame:
    """Targets (name, ...) that no row of the plan (target_name) goes to: their albums may be deleted."""
    return targets.join(plan.select(F.col("target_name").alias("name")), "name", "left_anti")


def undo_collected(plan: DataFrame, before: DataFrame) -> DataFrame:
    """Collected items to take out of their target again: done, and not there before."""
    done = plan.where("action = 'collect' and status = 'done'").select("item_id", "target_name")
    return done.join(before.select("target_name", "item_id"), ["target_name", "item_id"], "left_anti")


def limited(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows over all targets, in a total order."""
    return rows.orderBy(*order).limit(n)
