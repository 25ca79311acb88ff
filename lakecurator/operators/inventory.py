"""Snapshots of a destination, answers of a review, and the rows that a plan starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import extension, inside, match_key
from .placing import ranked


def albums_in_scope(albums: DataFrame, paths: list[str]) -> DataFrame:
    """Albums (album_id, folder, name) under any of the paths, each once; "/" is everything.

    A path that no folder has may name one album, by folder and name.
    """
    keep = F.lit(False)
    for path in (p.strip("/") for p in paths):
        if not path:
            return albums.dropDuplicates(["album_id"])
        below = inside(F.col("folder"), path)
        if albums.where(below).isEmpty():
            parent, _, name = path.rpartition("/")
            below = (F.col("folder") == parent) & (F.col("name") == name)
        keep = keep | F.coalesce(below, F.lit(False))
    return albums.where(keep).dropDuplicates(["album_id"])


def refresh(listed_albums: DataFrame, listed_items: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(albums with their counts, items, albums that are gone): the snapshot as it is now listed."""
    items = listed_items.join(listed_albums.select("album_id"), "album_id", "left_semi")
    items = items.withColumn("_n", F.row_number().over(Window.partitionBy("item_id", "album_id").orderBy(F.desc_nulls_last("name")))).where("_n = 1").drop("_n")
    counts = items.groupBy("album_id").agg(F.count("*").alias("item_count"))
    albums = listed_albums.join(counts, "album_id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0).cast("long")))
    return albums, items, known.select("album_id").join(listed_albums.select("album_id"), "album_id", "left_anti")


def status_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, status, n) of several tables."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "status", "n")
        out = part if out is None else out.unionByName(part)
    return out


def undecided(sources: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sources without a decision; a plan needs there to be none."""
    return sources.select("ref").join(decisions.select("ref"), "ref", "left_anti")


def review_pairs(matches: DataFrame, numbered: DataFrame) -> DataFrame:
    """(number, ref) of pairs to review: numbers given before stay, new ones go on from there in the order of ref.

    matches: ref, decision, reviewed; numbered: number, ref.
    """
    todo = matches.where("decision = 'review' and reviewed is null").select("ref")
    last = numbered.agg(F.max("number")).first()[0] or 0
    new = todo.join(numbered, "ref", "left_anti")
    placed = ranked(new.withColumn("_queue", F.lit(0)), "_queue", [F.asc("ref")], "_rank")
    given = placed.select((F.col("_rank") + 1 + last).cast(numbered.schema["number"].dataType).alias("number"), "ref")
    return numbered.select("number", "ref").unionByName(given)


def read_answers(files: DataFrame, numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers: ref, answer; conflicts: number) from files (folder, name) that a person has sorted.

    The folder is the answer, same or different; the name begins with a pair's
    number. Pairs found in both folders have no answer.
    """
    number = F.regexp_extract("name", r"^(\d{4,}) (?:source|destination) ", 1).try_cast("int")
    seen = files.where(F.col("folder").isin("same", "different")).withColumn("number", number).where("number is not null").join(numbered, "number")
    told = seen.groupBy("number", "ref").agg(F.count_distinct("folder").alias("n"), F.min("folder").alias("answer"))
    return told.where("n = 1").select("ref", "answer"), told.where("n > 1").select("number")


def videos_to_look_up(sources: DataFrame, dests: DataFrame) -> DataFrame:
    """Destination videos without a duration that share a name with a source video of other bytes."""
    held = dests.where("md5 <> ''").select("md5")
    wanted = sources.where("kind <> 'photo'").join(held, "md5", "left_anti").select(match_key(F.col("name")).alias("key")).distinct()
    lacking = dests.where("is_video and duration_s is null").withColumn("key", match_key(F.col("name")))
    return lacking.join(wanted, "key", "left_semi").drop("key")


def with_video_facts(dests: DataFrame, facts: DataFrame) -> DataFrame:
    """dests with durations that were looked up; sizes that are known stay."""
    found = facts.select("item_id", F.col("duration_s").alias("_d"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    joined = dests.join(found, "item_id", "left")
    return joined.select(*[{"duration_s": F.coalesce("duration_s", "_d").alias(c), "width": F.coalesce("width", "_w").alias(c), "height": F.coalesce("height", "_h").alias(c)}.get(c, F.col(c)) for c in dests.columns])


def report_sources(items: DataFrame, rejected: list[str], rejected_types: str = "skip", live_clips: str = "pair", unpaired_clips: str = "dated") -> DataFrame:
    """(ref, kind, still_ref, policy_skip) of every file: each medium, and each motion clip with its still.

    items: ref, name, kind, motion_ref.
    """
    refused = (F.col("kind") == "photo") & F.lower(extension(F.col("name"))).isin(*rejected) & F.lit(rejected_types == "skip")
    clip = "live_clips" if live_clips == "skip" else "unpaired_clips" if unpaired_clips == "skip" else None
    own = F.struct("ref", "kind", F.lit(None).cast("string").alias("still_ref"), F.when(refused, "rejected_types").alias("policy_skip"))
    moving = F.when(F.col("motion_ref").isNotNull(), F.struct(F.col("motion_ref").alias("ref"), F.lit("clip").alias("kind"), F.col("ref").alias("still_ref"), F.lit(clip).cast("string").alias("policy_skip")))
    return items.select(F.inline(F.filter(F.array(own, moving), lambda x: x.isNotNull())))


def with_target_albums(rows: DataFrame, targets: DataFrame, albums: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, targets): planned rows with the album of their target, and the targets they add.

    A row that needs an album other than the one its target's name already
    stands for is held. New targets are photo targets if any still goes there.
    """
    known = targets.where("album_id is not null").select(F.col("name").alias("target_name"), F.col("album_id").alias("_known"))
    marked = rows.join(known, "target_name", "left")
    clash = F.col("album_id").isNotNull() & F.col("_known").isNotNull() & (F.col("album_id") != F.col("_known"))
    reason = F.concat(F.lit("another album named '"), F.col("target_name"), F.lit("' is already a target; rename one of them"))
    held = marked.withColumn("reason", F.when(clash, reason).otherwise(F.col("reason"))).withColumn("status", F.when(clash, "held").otherwise(F.col("status"))).drop("_known")
    named = albums.where(F.col("folder") == folder).groupBy(F.col("name").alias("target_name")).agg(F.max("album_id").alias("_named"))
    kinds = held.groupBy("target_name").agg(F.min(F.when(F.col("role").isin("video", "clip"), "video").otherwise("photo")).alias("kind"), F.max("album_id").alias("album_id"))
    new = kinds.join(targets.select(F.col("name").alias("target_name")), "target_name", "left_anti").join(named, "target_name", "left")
    return held, new.select(F.col("target_name").alias("name"), "kind", F.coalesce("album_id", "_named").alias("album_id"), F.lit(0).cast("long").alias("planned"))
