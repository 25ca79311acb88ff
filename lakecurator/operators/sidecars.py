"""Media of an export with their sidecars and motion clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import extension, stem
from ..plans.staging import staged
from .elimination import assign_names
from .matching import first_per_key

_SUFFIX = "supplemental-metadata"
#: What stills and motion clips are called.
STILLS = (".heic", ".heif", ".jpg", ".jpeg", ".webp", ".bmp", ".ico", ".dng", "")
MOTION = (".mp4", ".mov")


def sidecar_pattern() -> str:
    """A sidecar's name: the media name, any beginning of the suffix, maybe a counter."""
    beginnings = "|".join(_SUFFIX[:n] for n in range(len(_SUFFIX), 0, -1))
    return rf"(?is)^(.*?)\.(?:{beginnings})(\(\d+\))?\.json$"


def media_name(sidecar: Column, title: Column) -> Column:
    """struct(expected, prefix): the media file that a sidecar names; a counter goes before the title's extension."""
    prefix, counter = (F.regexp_extract(sidecar, sidecar_pattern(), i) for i in (1, 2))
    named = F.coalesce(F.nullif(title, F.lit("")), prefix)
    expected = F.when(counter != "", F.concat(stem(named), counter, extension(named))).otherwise(prefix)
    return F.when(sidecar.rlike(sidecar_pattern()), F.struct(expected.alias("expected"), prefix.alias("prefix")))


def items(members: DataFrame) -> DataFrame:
    """One row for each medium: its sidecar's facts, and its motion clip.

    members as sources.archives gives them. Columns: archive, path, folder,
    basename, ext, md5, size, taken_ts, title, url, orphan, motion (struct of
    archive, path). In the order of (archive, path), which takes the place of
    that of a scan, each sidecar takes the medium that it names in its folder,
    in any case, or if there is none of that name, the only medium left whose
    name begins with its prefix: see assign_names().
    """
    media = members.where("ext <> '.json'").select("archive", "path", "folder", F.lower("basename").alias("lower_name"))
    media = first_per_key(media, ["folder", "lower_name"], [F.desc("archive"), F.desc("path")])
    sides = members.where("ext = '.json' and lower(basename) <> 'metadata.json'")
    sides = sides.withColumn("title", F.get_json_object("json", "$.title")).withColumn("taken", F.get_json_object("json", "$.photoTakenTime.timestamp"))
    has = F.col("title").isNotNull() | F.get_json_object("json", "$.photoTakenTime").isNotNull()
    sides = sides.where(has).withColumn("means", media_name(F.col("basename"), F.col("title"))).where("means is not null")
    sides = staged(sides.select("folder", F.struct("archive", "path").alias("sidecar"), "title", "taken", F.get_json_object("json", "$.url").alias("url"), F.lower("means.expected").alias("lower_name"), F.lower("means.prefix").alias("prefix")))

    given = assign_names(media.select("folder", F.col("lower_name").alias("name")), sides.select("folder", F.col("sidecar").alias("asker"), F.col("lower_name").alias("name"), F.col("prefix").alias("beginning")))
    found = given.join(media.withColumnRenamed("lower_name", "name"), ["folder", "name"]).join(sides.select(F.col("sidecar").alias("asker"), "title", "taken", "url"), "asker")
    found = found.select("archive", "path", F.col("asker").alias("sidecar"), "title", "taken", "url")

    known = members.where("ext <> '.json'").join(found, ["archive", "path"], "left").withColumn("key", F.lower(stem(F.col("basename"))))
    known = staged(known)
    paired = known.where(F.col("sidecar").isNotNull() & F.col("ext").isin(*STILLS))
    still = first_per_key(paired.select("folder", "key", F.struct("archive", "path").alias("still")), ["folder", "key"], [F.desc("still")])
    clip = first_per_key(known.where(F.col("sidecar").isNull() & F.col("ext").isin(*MOTION)), ["folder", "key"], [F.asc("archive"), F.asc("path")]).select("folder", "key", F.struct("archive", "path").alias("motion"))
    joined = staged(still.join(clip, ["folder", "key"]).select("still", "motion"))
    out = known.join(joined.select(F.col("motion.archive").alias("archive"), F.col("motion.path").alias("path")), ["archive", "path"], "left_anti")
    out = out.join(joined.select(F.col("still.archive").alias("archive"), F.col("still.path").alias("path"), "motion"), ["archive", "path"], "left")
    taken = F.nullif(F.col("taken").try_cast("long"), F.lit(0))
    return out.select("archive", "path", "folder", "basename", "ext", "md5", "size", taken.alias("taken_ts"), "title", "url", F.col("sidecar").isNull().alias("orphan"), "motion")


def source_items(found: DataFrame, include_orphans: bool = False) -> DataFrame:
    """items() that an import takes, with kind (photo or video): those with a sidecar, and on demand media without one and lone clips."""
    rows = found if include_orphans else found.where("not orphan")
    return rows.withColumn("kind", F.when(F.col("ext").isin(*MOTION), "video").otherwise("photo"))
