"""Which source items a destination has already: by bytes, by picture, or by a video's shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import match_key
from ..plans.staging import staged
from .classes import match_pictures, match_videos, unknown_items
from .matching import first_per_key

DECISIONS = ("exact", "same", "new", "review", "source_duplicate")
MODES = ("off", "exact", "content")
#: What the details of decisions say.
SAME_FILE = "same file as "
UNREADABLE = "a same-named copy couldn't be compared"
NEAREST = ("nearest same-named copy differs (distance ", ")")
CLAIMED = "same-named copies already claimed by closer matches"
BETWEEN = ("distance ", " is between {} and {}")
SECONDS = "duration differs by %.2fs"
NO_DURATION = "duration unknown; can't compare"
OTHER_SHAPE = "same-named video has a different shape"
COLUMNS = ["ref", "decision", "method", "dest_item_id", "dest_album_id", "dist", "detail"]


def representatives(sources: DataFrame) -> DataFrame:
    """sources with representative: the smallest ref of equal md5, or the ref itself where md5 is null or empty.

    Refs are aggregated by md5 before the join, so a large group of copies is
    never sorted in one task.
    """
    known = F.coalesce(F.col("md5"), F.lit("")) != ""
    least = sources.where(known).groupBy("md5").agg(F.min("ref").alias("_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return sources.join(least, "md5", "left").withColumn("representative", F.coalesce("_least", "ref")).drop("_least")


def content_candidates(sources: DataFrame, dests: DataFrame) -> DataFrame:
    """ref and item_id of photos to compare by picture: no equal bytes at the destination, but an equal base name."""
    unique = representatives(sources).where("representative = ref and kind = 'photo'")
    rest = unique.join(dests.where("md5 <> ''").select("md5"), "md5", "left_anti")
    named = dests.where(~F.coalesce("is_video", F.lit(False))).select("item_id", match_key(F.col("name")).alias("key"))
    return rest.select("ref", match_key(F.col("name")).alias("key")).join(named, "key").select("ref", "item_id")


def _rows(df: DataFrame, decision: Column, method: Column, dest: str | None = None, album: str | None = None, dist: Column | None = None, detail: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "ref",
        decision.cast("string").alias("decision"),
        method.cast("string").alias("method"),
        (F.col(dest) if dest else none).cast("string").alias("dest_item_id"),
        (F.col(album) if album else none).cast("string").alias("dest_album_id"),
        (none if dist is None else dist).cast("int").alias("dist"),
        (none if detail is None else detail).cast("string").alias("detail"),
    )


def decide(sources: DataFrame, dests: DataFrame, source_hashes: DataFrame | None = None, dest_hashes: DataFrame | None = None, mode: str = "content", same_max: int = 6, different_min: int = 19, tolerance: float = 0.02) -> DataFrame:
    """One decision for each source: ref, decision, method, dest_item_id, dest_album_id, dist, detail.

    sources: ref, name, kind, md5, duration_s, width, height. dests: item_id,
    album_id, name, md5, is_video, duration_s, width, height. source_hashes:
    ref, hashes (array of four bigints, null if unreadable). dest_hashes:
    item_id, hash (null if unreadable). Of destination items with equal bytes
    the first by album_id, then item_id, is meant.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    known = staged(representatives(sources))
    unique = known.where("representative = ref")
    twins = _rows(known.where("representative <> ref"), F.lit("source_duplicate"), F.lit("md5"), detail=F.concat(F.lit(SAME_FILE), F.col("representative")))
    if mode == "off":
        return twins.unionByName(_rows(unique, F.lit("new"), F.lit("off")))

    by_bytes = first_per_key(dests.where("md5 <> ''").select("md5", F.col("item_id").alias("d_item"), F.col("album_id").alias("d_album")), ["md5"], [F.asc_nulls_first("d_album"), F.asc("d_item")])
    looked = staged(unique.join(by_bytes, "md5", "left"))
    exact = _rows(looked.where("d_item is not null"), F.lit("exact"), F.lit("md5"), "d_item", "d_album", F.lit(0))
    rest = looked.where("d_item is null").drop("d_item", "d_album")
    if mode == "exact":
        return twins.unionByName(exact).unionByName(_rows(rest, F.lit("new"), F.lit("md5")))

    first = dests.groupBy("item_id").agg(F.min(F.struct("album_id", "name", "is_video", "duration_s", "width", "height")).alias("d")).select("item_id", "d.*")
    named = first.select("item_id", F.col("album_id").alias("d_album"), F.coalesce("is_video", F.lit(False)).alias("video"), match_key(F.col("name")).alias("key"), "duration_s", "width", "height")
    keyed = rest.select("ref", (F.col("kind") != "photo").alias("video"), match_key(F.col("name")).alias("key"), "duration_s", "width", "height")
    photos = _photos(keyed.where("not video"), named.where("not video"), source_hashes, dest_hashes, same_max, different_min)
    videos = _videos(keyed.where("video"), named.where("video"), tolerance)
    return twins.unionByName(exact).unionByName(photos).unionByName(videos)


def _photos(photos: DataFrame, named: DataFrame, source_hashes: DataFrame, dest_hashes: DataFrame, same_max: int, different_min: int) -> DataFrame:
    albums = named.select(F.col("item_id").alias("item"), F.col("d_album").alias("album"))
    settled = staged(match_pictures(photos.select("key", "ref").join(source_hashes, "ref", "left"), named.select("key", "item_id").join(dest_hashes, "item_id", "left"), same_max))
    taken = settled.where("item_id is not null").select("ref", F.col("item_id").alias("item"), "dist").join(albums, "item")
    same = _rows(taken, F.lit("same"), F.lit("content"), "item", "album", F.col("dist"))

    left = photos.select("ref").join(settled, "ref", "left").where("item_id is null").select("ref", F.coalesce("unreadable", F.lit(False)).alias("unreadable"), F.coalesce("scored", F.lit(False)).cast("int").alias("scores"), F.col("near_dist").alias("dist"), F.col("near_item").alias("item"))
    left = left.join(albums, "item", "left")
    far = F.col("dist").isNull() | (F.col("dist") >= different_min)
    unread = F.col("unreadable") & (F.col("dist").isNull() | (F.col("dist") > same_max))
    decision = F.when(unread, "review").when(far, "new").otherwise("review")
    method = F.when(~unread & far & (F.col("scores") == 0), "none").otherwise("content")
    distance = F.col("dist").cast("string")
    detail = (
        F.when(unread, UNREADABLE)
        .when(far & F.col("dist").isNotNull(), F.concat(F.lit(NEAREST[0]), distance, F.lit(NEAREST[1])))
        .when(far & (F.col("scores") > 0), CLAIMED)
        .when(~far, F.concat(F.lit(BETWEEN[0]), distance, F.lit(BETWEEN[1].format(same_max, different_min))))
    )
    decided = left.withColumn("decision", decision).withColumn("method", method).withColumn("detail", detail)
    named = F.col("decision") == "review"
    decided = decided.withColumn("item", F.when(named, F.col("item"))).withColumn("album", F.when(named, F.col("album")))
    return same.unionByName(_rows(decided, F.col("decision"), F.col("method"), "item", "album", F.col("dist"), F.col("detail")))


def _videos(videos: DataFrame, named: DataFrame, tolerance: float) -> DataFrame:
    albums = named.select(F.col("item_id").alias("item"), F.col("d_album").alias("album"))
    settled = staged(match_videos(videos, named, tolerance))
    taken = settled.where("item_id is not null").select("ref", F.col("item_id").alias("item"), "gap").join(albums, "item")
    same = _rows(taken, F.lit("same"), F.lit("video_shape"), "item", "album", detail=F.format_string(SECONDS, F.col("gap")))
    left = videos.select("ref", "key", "duration_s").join(settled, "ref", "left").where("item_id is null").join(unknown_items(named), "key", "left")
    unsure = F.when(F.coalesce("duration_s", F.lit(0)) <= 0, F.col("any")).otherwise(F.col("blank"))  # what can't be compared with it
    left = left.select("ref", unsure["item_id"].alias("item"), unsure["d_album"].alias("album"), F.col("any").isNotNull().alias("named"))
    review = F.col("item").isNotNull()
    detail = F.when(review, NO_DURATION).when(F.col("named"), OTHER_SHAPE)
    return same.unionByName(_rows(left, F.when(review, "review").otherwise("new"), F.when(F.col("named"), "video_shape").otherwise("none"), "item", "album", detail=detail))


def effective_decision(decision: Column, reviewed: Column) -> Column:
    """The decision after a person's answer: same stays the same, different is new."""
    return F.when(reviewed == "same", "same").when(reviewed == "different", "new").otherwise(decision)


def merge_decisions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored decisions replaced by fresh ones; answers (reviewed) survive."""
    kept = stored.select("ref", "reviewed")
    return fresh.join(kept, "ref", "left").unionByName(stored.join(fresh.select("ref"), "ref", "left_anti"), allowMissingColumns=True)


def missing_hashes(candidates: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys among the candidates whose hash isn't cached yet; a cached failure counts as cached."""
    return candidates.select(key).distinct().join(cache.select(key), key, "left_anti")
