"""Whole commands, put together from operators: each refuses what it must, and returns the rows it would store."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.importing import ImportSettings, plan_import
from ..plans.staging import staged
from .changes import release_answered_holds
from .inventory import undecided
from .policies import audit_status, desired, drift, finding, governed, unsupported


class Refused(ValueError):
    """A command whose conditions aren't met, and why."""


def takeout_plan(items: DataFrame, decisions: DataFrame, destination: DataFrame, uploads: DataFrame, targets: DataFrame, dest_albums: DataFrame, settings: ImportSettings, compared: bool = True) -> dict[str, DataFrame]:
    """uploads (to add), released (upload_id of holds to drop), targets (to add) and notes of an import plan.

    items, decisions, destination: as plan_import() takes them, decisions
    effective and without columns missing. uploads: upload_id, source_ref,
    role, status, pair_ref, target_name, upload_name. targets: name, album_id.
    dest_albums: name, album_id of the project's own folder. Held uploads whose
    review was answered are planned anew. With `compared` every item must have
    a decision. A row that joins an album while another one of that name is a
    target is held. A new target is of videos only if all of its rows are.
    """
    if compared and (n := undecided(items, decisions).count()):
        raise Refused(f"{n} items are still without a decision")
    released = staged(release_answered_holds(uploads, decisions).select("upload_id").distinct())
    previous = uploads.join(released, "upload_id", "left_anti").select("source_ref", "role", "target_name", "upload_name")
    rows, notes = plan_import(items, decisions, destination, previous, settings)
    known = targets.select(F.col("name").alias("target_name"), F.col("album_id").alias("_known"), F.lit(True).alias("_there"))
    rows = rows.join(known, "target_name", "left")
    clash = F.coalesce(F.col("_known") != F.col("album_id"), F.lit(False))
    reason = F.concat(F.lit("the target "), F.col("target_name"), F.lit(" is an album already, and not the one of this row's still"))
    rows = staged(rows.withColumn("status", F.when(clash, "held").otherwise(F.col("status"))).withColumn("reason", F.when(clash, reason).otherwise(F.col("reason"))))
    video = F.col("role").isin("video", "clip")
    made = rows.where("_there is null").groupBy("target_name").agg(F.bool_and(video).alias("video"), F.max("album_id").alias("_own"))
    made = made.join(dest_albums.groupBy(F.col("name").alias("target_name")).agg(F.min("album_id").alias("_named")), "target_name", "left")
    new = made.select(F.col("target_name").alias("name"), F.when(F.col("video"), "video").otherwise("photo").alias("kind"), F.coalesce("_own", "_named").alias("album_id"), F.lit(0).cast("long").alias("planned"))
    return {"uploads": rows.drop("_known", "_there"), "released": released, "targets": new, "notes": notes}


def albums_audit(albums: DataFrame, actual: DataFrame, policies: list[dict], allowed: dict[str, list], soft_cap: int, hard_cap: int) -> dict[str, DataFrame]:
    """seen (album_id, folder, name, item_count) and changes of the albums that policies govern.

    albums: album_id, folder, name, item_count; actual: as drift() takes it.
    allowed: for each setting that can be changed the values that it can have.
    changes: album_id, kind (setting or finding), field, old_value, new_value,
    source, note, status: a setting to change is planned, or goes to review
    where its value now couldn't be put back; findings are info.
    """
    if not policies:
        raise Refused("there are no policies")
    if wrong := unsupported(policies, allowed):
        raise Refused(f"the destination can't change {wrong}")
    seen = staged(governed(albums, policies).select("album_id", "folder", "name", "item_count"))
    found = staged(drift(actual, desired(seen, policies)))
    options = F.create_map(*[x for k, vs in allowed.items() for x in (F.lit(k), F.array(*[F.lit(json.dumps(v)) for v in vs]))])
    now: Column = F.coalesce(F.col("actual"), F.lit("null"))
    status = audit_status(now, options[F.col("setting")])
    note = F.when(status == "review", F.concat(F.lit("couldn't be put back to "), now))
    none = F.lit(None).cast("string")
    fixes = found.where("warning is null").select("album_id", F.lit("setting").alias("kind"), F.col("setting").alias("field"), now.alias("old_value"), F.col("desired").alias("new_value"), F.concat(F.lit("policy "), F.col("policy").cast("string")).alias("source"), note.alias("note"), status.alias("status"))
    noted = found.where("warning is not null").select("album_id", F.col("warning").alias("note"))
    noted = noted.unionByName(seen.select("album_id", finding(F.col("item_count"), soft_cap, hard_cap).alias("note")).where("note is not null"))
    infos = noted.select("album_id", F.lit("finding").alias("kind"), none.alias("field"), none.alias("old_value"), none.alias("new_value"), none.alias("source"), "note", F.lit("info").alias("status"))
    return {"seen": seen, "changes": fixes.unionByName(infos)}
