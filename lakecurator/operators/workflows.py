"""Whole steps put together from the operators: what to organize, compare, rename, apply and verify."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import landed_name
from ..functions.naming import date_for, propose
from ..functions.times import recent
from .dedupe import content_candidates, decide, merge_decisions, missing_hashes
from .placing import group_of
from .policies import rename_collisions
from .scans import Scan


def organize_items(items: DataFrame, albums: DataFrame, chain: list[str], rules: list[dict], unassigned: str | None, zone: str, today: datetime.date, recent_days: int = 0, now: datetime.datetime | None = None, plugins: dict | None = None) -> DataFrame:
    """The planner's items: item_id, filename, is_video, md5, uploaded, capture_local, method, group.

    items: item_id, album_id, filename, is_video, md5, uploaded, capture_time,
    make, model; albums: album_id, name. Items uploaded in the last recent_days
    wait for a later run. Items whose album isn't listed have no album name.
    """
    known = items.join(albums.select("album_id", F.col("name").alias("album_name")), "album_id", "left")
    if recent_days:
        known = known.where(~recent(F.col("uploaded"), recent_days, now))
    columns = {c: F.col(c) for c in ("filename", "capture_time", "uploaded", "album_name")}
    dated = known.withColumn("_date", date_for(chain, columns, zone, today, plugins))
    rule_columns = {"album": F.col("album_name"), "make": F.col("make"), "model": F.col("model"), "filename": F.col("filename")}
    return dated.select("item_id", "filename", "is_video", "md5", "uploaded", F.col("_date.value").alias("capture_local"), F.col("_date.method").alias("method"), group_of(rules, unassigned, rule_columns).alias("group"))


def hashes_to_make(sources: DataFrame, dests: DataFrame, source_cache: DataFrame, dest_cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, item_ids) whose pictures a content run must still hash."""
    met = content_candidates(sources, dests)
    return missing_hashes(met, source_cache, "ref"), missing_hashes(met, dest_cache, "item_id")


def dedupe_run(sources: DataFrame, dests: DataFrame, stored: DataFrame, source_cache: DataFrame, dest_cache: DataFrame, **options) -> DataFrame:
    """Stored decisions after a new run: those of sources that are gone are pruned, others replaced, answers kept."""
    there = stored.join(sources.select("ref"), "ref", "left_semi")
    return merge_decisions(there, decide(sources, dests, source_cache, dest_cache, **options))


def destination_snapshot(items: DataFrame, albums: DataFrame) -> DataFrame:
    """(item_id, album, album_id, name) of a destination's items; an item of several albums is listed in each."""
    return items.join(albums.select("album_id", F.col("name").alias("album")), "album_id").select("item_id", "album", "album_id", "name")


def names_by_album(snapshot: DataFrame) -> DataFrame:
    """(album, names, n): lower-case names in use and the number of items; albums of one name count together."""
    return snapshot.groupBy("album").agg(F.sort_array(F.collect_set(F.lower("name"))).alias("names"), F.count("*").alias("n"))


def work_rows(plan: DataFrame, items: DataFrame, targets: DataFrame) -> DataFrame:
    """Plan rows with their item's source album and their target's album, null where that isn't built."""
    known = items.select("item_id", F.col("album_id").alias("src_album_id"), "filename")
    return plan.join(known, "item_id").join(targets.select(F.col("name").alias("target_name"), F.col("album_id").alias("dst_album_id")), "target_name", "left")


def target_counts(targets: DataFrame, plan: DataFrame) -> DataFrame:
    """(name, done, open) of each target, counted before the join."""
    counts = plan.groupBy(F.col("target_name").alias("name")).agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") != "done").alias("open"))
    zero = F.lit(0).cast("long")
    return targets.select("name").join(counts, "name", "left").select("name", F.coalesce("done", zero).alias("done"), F.coalesce("open", zero).alias("open"))


def albums_to_list(albums: DataFrame) -> DataFrame:
    """Albums whose items an inventory must list: those that aren't known to be empty."""
    return albums.where(F.coalesce("item_count", F.lit(-1)) != 0)


def over_cap(plan: DataFrame, counts: DataFrame, hard_cap: int) -> DataFrame:
    """(target_name, n, coming): targets that what is to come would lift over the hard cap. counts: target_name, n."""
    coming = plan.where(F.col("status").isin("pending", "failed")).groupBy("target_name").agg(F.count("*").alias("coming"))
    held = coming.join(counts, "target_name", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return held.where(F.col("n") + F.col("coming") > hard_cap).select("target_name", "n", "coming")


def failure_runs(log: DataFrame, order: list[Column], keys: list[str], least: int) -> DataFrame:
    """keys, first, n: runs of `least` or more failures (failed boolean) in a row, for each key; first is the step they began at."""
    marked = Scan(log, keys, order).running("_step", F.lit(1)).running("_run", F.coalesce(~F.col("failed"), F.lit(False)).cast("int")).done()
    runs = marked.where("failed").groupBy(*keys, "_run").agg(F.min("_step").cast("int").alias("first"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).select(*keys, "first", "n")


def empty_sources(albums: DataFrame, items: DataFrame, targets: DataFrame) -> DataFrame:
    """Source albums that nothing is left in and that no target uses: album_id."""
    rest = albums.select("album_id").join(items.select("album_id"), "album_id", "left_anti")
    return rest.join(targets.where("album_id is not null").select("album_id"), "album_id", "left_anti")


def uploads_to_verify(uploads: DataFrame, everything: bool = False) -> DataFrame:
    """Finished uploads that weren't verified before, or all of them."""
    done = uploads.where("status = 'done'")
    return done if everything else done.where("verified_at is null")


def verify_uploads(uploads: DataFrame, listed: DataFrame) -> DataFrame:
    """(upload_id, problem) of uploads: null where the album lists the item with its bytes, else missing, elsewhere or changed.

    uploads: upload_id, item_id, album_id, md5; listed: item_id, album_id, md5.
    Bytes are compared where both sides know them.
    """
    here = listed.groupBy("item_id", "album_id").agg(F.max("md5").alias("_md5"), F.lit(True).alias("_here"))
    known = listed.select("item_id").distinct().withColumn("_known", F.lit(True))
    both = uploads.join(here, ["item_id", "album_id"], "left").join(known, "item_id", "left")
    changed = (F.coalesce("md5", F.lit("")) != "") & (F.coalesce("_md5", F.lit("")) != "") & (F.col("md5") != F.col("_md5"))
    problem = F.when(F.col("_known").isNull(), "missing").when(F.col("_here").isNull(), "elsewhere").when(changed, "changed")
    return both.select("upload_id", problem.alias("problem"))


def reconcile_uploads(uploads: DataFrame, listed: DataFrame, converts: dict[str, str] | None = None) -> DataFrame:
    """(upload_id, status, item_id) of uploads of unknown outcome: done where their album lists their name, as sent or as landed, else planned again.

    uploads: upload_id, album_id, upload_name, status; listed: album_id, item_id, name. Of several items the smallest id is meant.
    """
    open_ = uploads.where(F.col("status").isin("uploading", "unknown"))
    wanted = open_.select("upload_id", "album_id", F.explode(F.array_distinct(F.array(F.lower("upload_name"), F.lower(landed_name(F.col("upload_name"), converts or {}))))).alias("_name"))
    found = wanted.join(listed.select("album_id", F.lower("name").alias("_name"), "item_id"), ["album_id", "_name"]).groupBy("upload_id").agg(F.min("item_id").alias("item_id"))
    return open_.select("upload_id").join(found, "upload_id", "left").select("upload_id", F.when(F.col("item_id").isNotNull(), "done").otherwise("planned").alias("status"), "item_id")


def plan_renames(albums: DataFrame, templates: dict[str, str], today: datetime.date, renamed: DataFrame, **options) -> DataFrame:
    """(album_id, folder, name, new, source, confidence, note, status) of albums that should be called otherwise.

    albums: album_id, folder, name, photo_dates, upload_dates. renamed: album_id
    and new of renames that were carried out; they aren't proposed again.
    """
    made = propose(albums, templates, today, **options).where("new is not null").join(renamed.select("album_id", "new"), ["album_id", "new"], "left_anti")
    return rename_collisions(made, albums).select("album_id", "folder", "name", "new", "source", "confidence", "note", "status")


def verify_renames(changes: DataFrame, seen: DataFrame) -> DataFrame:
    """(change_id, status): done renames and settings, as an album shows them now: verified, changed since, or gone.

    changes: change_id, album_id, field, new_value, status; seen: album_id, field, value.
    """
    done = changes.where("status = 'done'").select("change_id", "album_id", "field", "new_value")
    now = seen.select("album_id", "field", "value", F.lit(True).alias("_seen"))
    found = done.join(now, ["album_id", "field"], "left")
    status = F.when(F.col("_seen").isNull(), "gone").when(F.col("value").eqNullSafe(F.col("new_value")), "verified").otherwise("changed")
    return found.select("change_id", status.alias("status"))


def methods(items: DataFrame) -> DataFrame:
    """(method, n): date methods without their patterns."""
    return items.groupBy(F.split(F.coalesce("method", F.lit("none")), ":")[0].alias("method")).agg(F.count("*").alias("n"))


def errors(rows: DataFrame, length: int = 80) -> DataFrame:
    """(error, n): how often each beginning of last_error occurs."""
    return rows.where("last_error is not null").groupBy(F.substring("last_error", 1, length).alias("error")).agg(F.count("*").alias("n"))
