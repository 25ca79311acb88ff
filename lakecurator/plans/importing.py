"""The import plan: what to upload, where, and under which name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import content_type, extension, landed_name, stem, still_output
from ..functions.shapes import aspect
from ..functions.times import dated_album, epoch
from ..operators.placing import claim_names, parts
from ..operators.timelines import pair_clips
from .staging import staged

#: A video without metadata this short, in seconds, is taken for a motion clip.
CLIP_SECONDS = 4.0


@dataclass(frozen=True)
class ImportSettings:
    """Policies, album templates and what the destination can do."""

    albums: dict[str, str]
    zone: str = "UTC"
    soft_cap: int = 5000
    heic: str = "convert"
    rejected_types: str = "convert"
    live_clips: str = "pair"
    unpaired_clips: str = "dated"
    pair_window: int = 60
    tolerance: float = 0.02
    rejected: list[str] = field(default_factory=list)
    converts: dict[str, str] = field(default_factory=dict)


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    order = ["source_ref", "role", "target", "name", "convert", "taken_ts", "pair_ref", "album_id", "reason", "held", "step", "sort_ts", "sort_name"]
    kinds = {"convert": "boolean", "taken_ts": "long", "held": "boolean", "step": "int", "sort_ts": "long"}
    return df.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in order])


def plan_import(items: DataFrame, decisions: DataFrame, destination: DataFrame, previous: DataFrame, s: ImportSettings) -> tuple[DataFrame, DataFrame]:
    """(rows, notes). rows: source_ref, role, target_name, upload_name, convert, content_type, taken_ts, pair_ref, album_id, reason, status; notes: note, n.

    items: ref, name, kind, taken_ts, own_time, width, height, duration_s,
    orphan, motion (struct of ref, name, own_time, width, height, duration_s).
    decisions: ref, decision, dest_item_id. destination: item_id, album,
    album_id, name. previous: source_ref, role, target_name, upload_name.

    Stills and videos are placed first and clips after them, because a clip
    joins its still's album. Names of one album are claimed in the order of
    time, name and ref, stills and videos before clips.
    """
    zone, albums = s.zone, s.albums
    own = epoch(F.col("own_time"))
    at = F.coalesce(F.nullif("taken_ts", F.lit(0)), own)
    known = items.join(decisions.select("ref", "decision", "dest_item_id"), "ref", "left").withColumn("decision", F.coalesce("decision", F.lit("new"))).withColumn("at", at).withColumn("own", own)
    known = staged(known.withColumn("there", F.col("decision").isin("exact", "same")).withColumn("held", F.col("decision") == "review"))
    notes = [known.where("decision = 'source_duplicate'").select(F.lit("same file appears twice in the source").alias("note"))]
    live = known.where("decision <> 'source_duplicate'")
    photos, others = live.where("kind = 'photo'"), live.where("kind <> 'photo'")
    loose = F.coalesce("orphan", F.lit(False)) & (F.coalesce("duration_s", F.lit(0.0)) > 0) & (F.col("duration_s") <= CLIP_SECONDS)
    notes.append(live.where("there").select(F.format_string("already on the destination (%s)", "decision").alias("note")))

    earlier = lambda role: previous.where(F.col("role") == role).select(F.col("source_ref").alias("ref"), F.col("target_name").alias("was_target"), F.col("upload_name").alias("was_name"))
    todo = photos.where("not there").join(earlier("still"), "ref", "left").withColumn("out", still_output(F.col("name"), s.heic, s.rejected_types, s.rejected))
    notes.append(todo.where("was_target is null and out.skip is not null").select(F.col("out.skip").alias("note")))
    order = {"sort_ts": F.coalesce("at", F.lit(0)), "sort_name": F.col("name")}
    stills = _rows(todo.where("was_target is null and out.skip is null"), source_ref=F.col("ref"), role=F.lit("still"), target=dated_album(F.col("at"), F.lit(False), albums, zone), name=F.col("out.name"), convert=F.col("out.convert"), taken_ts=F.col("at"), held=F.col("held"), step=F.lit(0), reason=F.when(F.col("held"), "close to a same-named copy on the destination; check it").otherwise("new photo"), **order)
    long = others.where(~loose & ~F.col("there")).join(earlier("video").select("ref"), "ref", "left_anti")
    videos = _rows(long, source_ref=F.col("ref"), role=F.lit("video"), target=dated_album(F.col("at"), F.lit(True), albums, zone), name=F.col("name"), convert=F.lit(False), taken_ts=F.col("at"), held=F.col("held"), step=F.lit(0), reason=F.when(F.col("held"), "same-named video on the destination couldn't be compared").otherwise("new video"), **order)

    counts = destination.groupBy(F.col("album").alias("target")).agg(F.count("*").alias("n"))
    taken = destination.select(F.col("album").alias("target"), "name").unionByName(destination.select(F.col("album").alias("target"), landed_name(F.col("name"), s.converts).alias("name"))).unionByName(previous.select(F.col("target_name").alias("target"), F.col("upload_name").alias("name"))).distinct()

    def placed(rows: DataFrame, used: DataFrame, full: DataFrame) -> DataFrame:
        """Rows with their part of the album and their unique name; rows of an existing album keep it."""
        fixed = rows.where("role = 'clip' and pair_ref is not null").withColumn("part", F.lit(1))
        free = parts(rows.where("role <> 'clip' or pair_ref is null").withColumnRenamed("target", "base"), "base", [F.asc("step"), F.asc("sort_ts"), F.asc("sort_name"), F.asc("source_ref")], s.soft_cap, full).drop("base")
        both = free.unionByName(fixed).withColumn("place", F.struct("step", "sort_ts", "sort_name", "source_ref"))
        rank = both.withColumn("place", F.concat_ws(" ", F.lpad(F.col("step").cast("string"), 3, "0"), F.lpad(F.col("sort_ts").cast("string"), 20, "0"), F.col("sort_name"), F.col("source_ref")))
        return staged(claim_names(rank, used, {k: v.upper() for k, v in s.converts.items()}))

    first = placed(stills.unionByName(videos), taken, counts)

    clips = photos.where("motion is not null").select("motion.*", F.col("ref").alias("still_ref"), F.col("at").alias("name_ts"), F.col("name").alias("of"))
    alone = others.where(loose & ~F.col("there")).select("ref", "name", "own_time", "width", "height", "duration_s", F.lit(None).cast("string").alias("still_ref"), F.lit(None).cast("long").alias("name_ts"), F.col("name").alias("of"))
    clips = staged(clips.select(alone.columns).unionByName(alone))
    if s.live_clips == "skip":
        notes.append(clips.select(F.lit("Live Photo clips skipped (live_clips = skip)").alias("note")))
        return _result(first), _counted(notes)

    copies = photos.where("there").join(destination.select(F.col("item_id").alias("dest_item_id"), "album", F.col("album_id").alias("at_album"), F.col("name").alias("at_name")), "dest_item_id").select("ref", F.col("album").alias("a_target"), F.col("at_name").alias("a_name"), F.lit(False).alias("a_held"), F.lit(True).alias("a_there"), F.col("at_album").alias("a_album"))
    none = F.lit(None).cast("string")
    planned = first.where("role = 'still'").select(F.col("source_ref").alias("ref"), F.col("target").alias("a_target"), F.col("final").alias("a_name"), F.col("held").alias("a_held"), F.lit(False).alias("a_there"), none.alias("a_album"))
    before = todo.where("was_target is not null").select("ref", F.col("was_target").alias("a_target"), F.col("was_name").alias("a_name"), F.col("held").alias("a_held"), F.lit(False).alias("a_there"), none.alias("a_album"))
    anchors = staged(copies.unionByName(planned).unionByName(before))
    sized = (F.coalesce("width", F.lit(0)) > 0) & (F.coalesce("height", F.lit(0)) > 0)
    bases = photos.join(anchors.select("ref"), "ref", "left_semi").where(sized).select(F.col("ref").alias("still_id"), F.coalesce(F.nullif("own", F.lit(0)), F.col("taken_ts")).alias("still_ts"), aspect(F.col("width"), F.col("height")).alias("still_ratio"), F.struct(F.coalesce("at", F.lit(0)), "name", "ref").alias("still_order"))
    timed = clips.withColumn("clip_at", F.coalesce(F.nullif(epoch(F.col("own_time")), F.lit(0)), F.col("name_ts")))
    wanted = timed.where(sized & F.col("clip_at").isNotNull()).select(F.col("ref").alias("clip_id"), F.col("clip_at").alias("clip_ts"), aspect(F.col("width"), F.col("height")).alias("clip_ratio"), F.struct(F.coalesce("name_ts", "clip_at"), "of", "ref").alias("clip_order"))
    pairs = staged(pair_clips(wanted, bases.where("still_ts is not null"), s.pair_window, s.tolerance))

    rest = timed.join(earlier("clip").select("ref"), "ref", "left_anti").join(pairs.select(F.col("clip_id").alias("ref"), "still_id", "gap"), "ref", "left").join(anchors.withColumnRenamed("ref", "still_id"), "still_id", "left")
    ext = F.upper(extension(F.col("name")))
    beside = destination.where(F.lower(extension(F.col("name"))).isin(".mp4", ".mov")).select(F.col("album").alias("a_target"), F.lower(stem(F.col("name"))).alias("a_stem")).distinct().withColumn("beside", F.lit(True))
    rest = staged(rest.withColumn("a_stem", F.lower(stem(F.col("a_name")))).join(beside, ["a_target", "a_stem"], "left"))
    when = {"sort_ts": F.coalesce("clip_at", F.lit(0)), "sort_name": F.col("of"), "taken_ts": F.col("clip_at"), "convert": F.lit(False), "role": F.lit("clip"), "source_ref": F.col("ref"), "step": F.lit(1)}
    dated = dated_album(F.col("clip_at"), F.lit(True), albums, zone)
    matched, unmatched = rest.where("still_id is not null"), rest.where("still_id is null")
    if s.live_clips == "pair":
        there = F.col("a_there") & F.coalesce("beside", F.lit(False))
        notes.append(matched.where(there).select(F.lit("clip already beside its still").alias("note")))
        reason = F.concat(F.lit("Live Photo clip, "), F.col("gap").cast("string"), F.lit("s from its still"), F.when(F.col("still_ref").eqNullSafe(F.col("still_id")), "").otherwise(" (paired by time)"))
        new = _rows(matched.where(~there), target=F.col("a_target"), name=F.concat(stem(F.col("a_name")), ext), held=F.col("a_held"), pair_ref=F.col("still_id"), album_id=F.col("a_album"), reason=reason, **when)
    else:
        new = _rows(matched, target=dated, name=F.col("name"), held=F.lit(False), reason=F.lit("Live Photo clip (separate)"), **when)
    if s.unpaired_clips == "skip":
        notes.append(unmatched.select(F.lit("clip with no matching still skipped (unpaired_clips = skip)").alias("note")))
    else:
        target = F.lit(albums["undated_video"]) if s.unpaired_clips == "undated" else dated
        new = new.unionByName(_rows(unmatched, target=target, name=F.col("name"), held=F.lit(False), reason=F.lit("clip with no matching still"), **when))
    placed_names = first.select("target", F.col("final").alias("name"))
    used = taken.unionByName(placed_names).unionByName(placed_names.select("target", landed_name(F.col("name"), s.converts).alias("name"))).distinct()
    full = counts.unionByName(first.groupBy("target").agg(F.count("*").alias("n"))).groupBy("target").agg(F.sum("n").alias("n"))
    second = placed(new, used, full)
    return _result(first.unionByName(second)), _counted(notes)


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("source_ref", "role", F.col("target").alias("target_name"), F.col("final").alias("upload_name"), "convert", content_type(F.col("final")).alias("content_type"), "taken_ts", "pair_ref", "album_id", "reason", F.when(F.col("held"), "needs_review").otherwise("planned").alias("status"))


def _counted(notes: list[DataFrame]) -> DataFrame:
    out = notes[0]
    for part in notes[1:]:
        out = out.unionByName(part)
    return out.groupBy("note").agg(F.count("*").alias("n"))
