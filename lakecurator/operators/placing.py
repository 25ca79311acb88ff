"""Where items go: albums by date and group, parts of limited size, and unique names."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import extension, fill, glob, part_name, stem
from ..plans.staging import staged
from .scans import Scan


def ranked(df: DataFrame, group: str, order: list[Column], rank: str) -> DataFrame:
    """df with rank, the place from 0 of each row in its group by a total order.

    A large group is cut into ranges, of which each fills a task: see Scan.
    """
    return Scan(df, [group], order).running(rank, F.lit(1)).done().withColumn(rank, F.col(rank) - 1)


def parts(items: DataFrame, base: str, order: list[Column], cap: int, existing: DataFrame | None = None) -> DataFrame:
    """items with part and target: parts of a base hold `cap` items and continue as '- Part N'.

    existing (target, n) has the items that parts hold already. A part offers
    the places it has left, and the item of rank r takes the r-th place offered.
    """
    rows = ranked(items, base, order, "_rank")
    if existing is None:
        out = rows.withColumn("part", (F.floor(F.col("_rank") / cap) + 1).cast("int"))
        return out.withColumn("target", part_name(F.col(base), F.col("part"))).drop("_rank")
    named = existing.select(F.regexp_replace("target", r" - Part \d+$", "").alias(base), F.coalesce(F.regexp_extract("target", r" - Part (\d+)$", 1).try_cast("int"), F.lit(1)).alias("part"), "n")
    free = named.groupBy(base, "part").agg(F.greatest(F.lit(0), F.lit(cap) - F.sum("n")).alias("free"))
    # a listed part offers what it has left, after all of every unlisted part between it and the one before
    along = Window.partitionBy(base).orderBy("part")
    gaps = free.withColumn("gap", F.col("part") - F.coalesce(F.lag("part").over(along), F.lit(0)) - 1)
    ends = gaps.withColumn("_end", F.sum(F.col("gap").cast("long") * cap + F.col("free")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    offers = ends.groupBy(base).agg(F.sort_array(F.collect_list(F.struct("part", "gap", "free", "_end"))).alias("_offers"), F.max("part").alias("_last"), F.max("_end").alias("_total"))
    placed = rows.join(offers, base, "left")
    offer = F.get(F.filter("_offers", lambda o: o["_end"] > F.col("_rank")), F.lit(0))
    into = F.col("_rank") - (offer["_end"] - offer["gap"] * cap - offer["free"])
    fits = F.when(into < offer["gap"] * cap, offer["part"] - offer["gap"] + F.floor(into / cap)).otherwise(offer["part"])
    beyond = F.coalesce("_last", F.lit(0)) + F.floor((F.col("_rank") - F.coalesce("_total", F.lit(0))) / cap) + 1
    out = placed.withColumn("part", F.coalesce(fits, beyond).cast("int"))
    return out.withColumn("target", part_name(F.col(base), F.col("part"))).drop("_rank", "_offers", "_last", "_total")


def keepers(items: DataFrame) -> DataFrame:
    """items (item_id, md5, uploaded, capture_local, method) with keeper_item_id and the keeper's date.

    Of equal md5 the earliest upload, then the smallest id, is kept. A keeper
    without a date takes that of the first dated copy by upload and id.
    Elected by aggregates of structs, so a large group of copies is never gathered.
    """
    age = F.struct(F.coalesce("uploaded", F.lit("")), "item_id")
    dated = F.coalesce("capture_local", F.lit("")) != ""
    elected = items.where("md5 <> ''").groupBy("md5").agg(F.min_by("item_id", age).alias("keeper_item_id"), F.min_by(F.when(dated, F.struct("item_id", "capture_local", "method")), F.when(dated, age)).alias("_dated"))
    out = items.join(elected, "md5", "left").withColumn("keeper_item_id", F.coalesce("keeper_item_id", "item_id"))
    lent = (F.col("keeper_item_id") == F.col("item_id")) & ~dated & F.col("_dated").isNotNull()
    return out.withColumn("lent", F.coalesce(lent, F.lit(False))).withColumn("when", F.when(lent, F.col("_dated.capture_local")).otherwise(F.nullif("capture_local", F.lit("")))).withColumn("dated_by", F.when(lent, F.concat(F.col("_dated.method"), F.lit(" (from an identical copy)"))).otherwise(F.coalesce("method", F.lit("none")))).drop("_dated")


def plan_organize(items: DataFrame, settings: dict, existing: DataFrame | None = None) -> DataFrame:
    """item_id, action, target_name, kind, reason, keeper_item_id for each item.

    items: item_id, filename, is_video, md5, uploaded, capture_local, method,
    group. settings: photo, video, undated_photo, undated_video (templates),
    duplicates_album, duplicates (park or keep), soft_cap, mode (move or
    collect). existing: item_id, status, target_name; items that are done keep
    their album but count in the order of its base.
    """
    collect = settings.get("mode") == "collect"
    if settings["duplicates"] == "park" and not collect:
        known = keepers(items)
    else:
        dated = F.nullif("capture_local", F.lit(""))
        known = items.withColumn("keeper_item_id", F.col("item_id")).withColumn("when", dated).withColumn("dated_by", F.when(dated.isNotNull(), F.coalesce("method", F.lit("none"))).otherwise(F.coalesce("method", F.lit("none"))))
    parked = F.col("keeper_item_id") != F.col("item_id")
    video, dated = F.coalesce("is_video", F.lit(False)), F.col("when").isNotNull()
    group = F.col("group")
    base = F.when(parked, F.lit(settings["duplicates_album"]))
    kind = F.when(parked, F.lit("duplicates"))
    for is_video, name in ((True, "video"), (False, "photo")):
        base = base.when(dated & (video == is_video), fill(settings[name], F.col("when"), group)).when(~dated & (video == is_video), fill(settings[f"undated_{name}"], F.lit(None), group))
        kind = kind.when(dated & (video == is_video), name).when(~dated & (video == is_video), f"{name}_undated")
    named = F.when(F.coalesce(group, F.lit("")) != "", F.concat(F.lit(", group "), group)).otherwise("")
    reason = F.when(parked, F.concat(F.lit("same file as "), F.col("keeper_item_id"))).otherwise(F.concat(F.lit("date via "), F.col("dated_by"), named))
    rows = known.withColumn("base", base).withColumn("kind", kind).withColumn("reason", reason).withColumn("_first", F.when(parked, F.col("md5")).otherwise(F.coalesce("when", F.lit(""))))
    placed = parts(rows, "base", [F.asc("_first"), F.asc("item_id")], settings["soft_cap"])
    if existing is not None:
        done = existing.where("status = 'done'").select("item_id", F.col("target_name").alias("_done"))
        placed = placed.join(done, "item_id", "left").withColumn("target", F.coalesce("_done", "target"))
    action = F.when(F.col("kind") == "duplicates", "park_duplicate").otherwise("collect" if collect else "move")
    return placed.select("item_id", action.alias("action"), F.col("target").alias("target_name"), "kind", "reason", F.when(F.col("keeper_item_id") != F.col("item_id"), F.col("keeper_item_id")).alias("keeper_item_id"))


def group_of(rules: list[dict], unassigned: str | None, columns: dict[str, Column]) -> Column:
    """The name of the first rule whose globs all match; rules: name, and globs by key of columns."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for key, pattern in rule.items():
            if key != "name":
                test = test & glob(columns[key], pattern)
        out = F.when(test, rule["name"]) if out is None else out.when(test, rule["name"])
    return F.lit(unassigned) if out is None else out.otherwise(F.lit(unassigned))


def _families(converts: dict[str, str]) -> dict[str, str]:
    """Extensions that names of one another can come to bear, under one of them."""
    out: dict[str, str] = {}
    for source, target in converts.items():
        source, target = source.lower(), target.lower()
        old, new = out.get(source, source), out.get(target, target)
        out |= {k: new for k, v in out.items() if v == old} | {source: new, target: new, old: new}
    return out


def _parsed(df: DataFrame, families: dict[str, str]) -> DataFrame:
    """df with _lower, _stem, _ext, _root and _kind of its names; names that can meet are equal in the last two."""
    low = df.withColumn("_lower", F.lower("name")).withColumn("_stem", F.lower(stem(F.col("name")))).withColumn("_ext", F.lower(extension(F.col("name"))))
    kind = F.col("_ext")
    if families:
        kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in families.items() for x in pair]), F.col("_ext")), kind)
    return low.withColumn("_root", F.regexp_replace("_stem", r"( \(\d+\))+$", "")).withColumn("_kind", kind)


def _by_gaps(lone: DataFrame, taken: DataFrame, converts: dict[str, str], names: list[str]) -> DataFrame:
    """Claims of names that meet none but taken ones: the r-th file takes the r-th counter that is free.

    Of counters in use, sorted, the j-th has k - j free ones before it; so as
    many counters are passed over by the r-th file as have k - j <= r, which is
    a running count once files and counters stand in one order. Counter 0 is
    the plain name.
    """
    key = ["target", "_lower"]
    files = Scan(lone, key, [F.asc("place"), F.asc("name")]).running("_at", F.lit(1)).done().select(*key, (F.col("_at") - 1).alias("_at"), F.lit(1).alias("_file"), F.struct(*names).alias("_row"))
    sources = F.create_map(*[F.lit(x) for k, v in converts.items() for x in (k.lower(), v.lower())]) if converts else None
    ends = F.array("_ext")
    if sources is not None:  # a taken name may be what one with another extension lands as
        ends = F.array_distinct(F.concat(ends, F.map_keys(F.map_filter(sources, lambda k, v: v == F.col("_ext")))))
    counter = F.regexp_extract("_stem", r"(?s)^.* \(([1-9]\d{0,17})\)$", 1)
    plain = F.struct(F.col("_stem").alias("base"), F.lit(0).cast("long").alias("k"))
    counted = F.when(counter != "", F.struct(F.substring(F.col("_stem"), F.lit(1), F.length("_stem") - F.length(counter) - 3).alias("base"), counter.try_cast("long").alias("k")))
    used = taken.select("target", F.explode(ends).alias("_end"), F.array_compact(F.array(plain, counted)).alias("_names")).select("target", "_end", F.inline("_names"))
    used = used.select("target", F.concat("base", "_end").alias("_lower"), "k").distinct()
    used = Scan(used, key, [F.asc("k")]).running("_j", F.lit(1)).done()
    kind = files.schema["_row"].dataType.simpleString()
    used = used.select(*key, (F.col("k") - F.col("_j") + 1).alias("_at"), F.lit(0).alias("_file"), F.lit(None).cast(kind).alias("_row"))
    met = Scan(used.unionByName(files), key, [F.asc("_at"), F.asc("_file")]).running("_passed", 1 - F.col("_file")).done().where("_file = 1")
    found = met.select("_row.*", (F.col("_at") + F.col("_passed")).cast("string").alias("_k"))
    numbered = F.concat(stem(F.col("name")), F.lit(" ("), F.col("_k"), F.lit(")"), extension(F.col("name")))
    return found.select(*names, F.when(F.col("_k") == "0", F.col("name")).otherwise(numbered).alias("final"))


def claim_names(items: DataFrame, taken: DataFrame, converts: dict[str, str] | None = None) -> DataFrame:
    """items (target, place, name, ...) with final: the name, or `stem (k).ext` with the least free k.

    A name is free if neither it nor the name it lands with is taken in the
    album, in any letter case; both are then taken. taken: target, name. Names
    are claimed in the order of place. Most names meet only taken ones: those
    count the gaps between counters in use, however many files bear a name.
    Names that differ but may come to be equal, as `a.HEIC` that lands as `a.JPG`
    beside `a.jpg`, or `a (1).jpg` beside `a.jpg`, hang on each other, and go
    through the rule in order, in a task for all with one stem and kind.
    """
    converts, names = converts or {}, items.columns
    families, family = _families(converts), ["target", "_root", "_kind"]
    new, old = staged(_parsed(items, families)), staged(_parsed(taken.select("target", "name"), families))
    mixed = staged(new.groupBy(*[F.col(c).alias(f"{c}_of") for c in family]).agg(F.min("_lower").alias("_a"), F.max("_lower").alias("_b")).where("_a <> _b").drop("_a", "_b"))
    same = F.lit(True)
    for c in family:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    gaps = _by_gaps(new.join(mixed, same, "left_anti"), old, converts, names)
    if mixed.isEmpty():
        return gaps
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def claim(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        used, following, out = {x.lower() for x in old["name"]}, {}, []

        def landed(name: str) -> str:
            base, ext = os.path.splitext(name)
            return (base + converts[ext.lower()] if ext.lower() in converts else name).lower()

        new = new.sort_values("place", kind="stable")
        for name in new["name"]:
            base, ext = os.path.splitext(name)
            k = following.get(name.lower(), 0)
            final = name if k == 0 else f"{base} ({k}){ext}"
            while final.lower() in used or landed(final) in used:
                k += 1
                final = f"{base} ({k}){ext}"
            used |= {final.lower(), landed(final)}
            following[name.lower()] = k
            out.append(final)
        return new[names].astype(object).assign(final=pd.Series(out, index=new.index, dtype=object))

    met = new.join(mixed, same, "left_semi").groupBy(*family).cogroup(old.join(mixed, same, "left_semi").groupBy(*family))
    return gaps.unionByName(met.applyInPandas(claim, f"{kinds}, final string"))
