"""Album settings: what ordered policies want, how albums differ, and other findings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import glob_any, glob_pattern, path_of

#: How strict a privacy setting is.
PRIVACY_RANK = {"public": 0, "unlisted": 1, "private": 2}
#: Policies up to which albums are tested by one expression.
FEW_POLICIES = 32
#: Rows of globs or settings, which come from the driver, up to which they are broadcast.
BROADCAST_ROWS = 100_000
#: What warnings and findings say.
UNUSED_SIZE = "policy %d: download_size applies only with downloads on; not checked"
BLOCKED = ("a containing folder makes it ", "; the album's own '", "' setting can't take effect")
OVER_CAP = "over the item cap (%d > {})"
NEAR_CAP = "near the item cap (%d of {})"


def in_scope(policy: dict, folder: Column, name: Column) -> Column:
    """Whether a policy's globs take an album in, by its path or name, and none takes it out."""
    values = [path_of(folder, name), name]
    return glob_any(values, policy.get("scope", [])) & ~glob_any(values, policy.get("exclude", []))


def literal_ends(pattern: str) -> tuple[str, str]:
    """What a glob's matches begin and end with: its text before the first and after the last special character."""
    special = [i for i, c in enumerate(pattern) if c in "*?["]
    if not special:
        return pattern, ""
    last = pattern.rfind("]") if "[" in pattern else -1
    return pattern[: special[0]], pattern[max(special[-1], last) + 1 :]


def _listed(albums: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of policies as the side of a join that is sent around; albums never are, as their size after exploding isn't known."""
    return albums.sparkSession.createDataFrame(rows, schema).hint("broadcast" if len(rows) <= BROADCAST_ROWS else "merge")


def _hits(albums: DataFrame, policies: list[dict]) -> DataFrame:
    """(album_id, policy) of policies that take an album in, by an index of globs.

    A glob is filed under the longer of its literal ends. An album's path and
    name are cut at the lengths that occur and meet by equality the globs filed
    there, which alone are tried. Globs without a literal end are tried on all.
    """
    globs = []
    for n, policy in enumerate(policies, 1):
        for kind in ("scope", "exclude"):
            for pattern in policy.get(kind) or []:
                first, last = literal_ends(pattern.lower())
                end = len(last) > len(first)
                globs.append((n, kind == "exclude", end, last if end else first, glob_pattern(pattern.lower())))
    filed = _listed(albums, globs, "policy int, out boolean, end boolean, text string, pattern string")
    sizes = [sorted({len(g[3]) for g in globs if g[2] == end}) for end in (False, True)]
    values = F.array_distinct(F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in (path_of(F.col("folder"), F.col("name")), F.col("name"))]))
    each = albums.select("album_id", F.explode(values).alias("value"))
    piece = lambda end, text: F.struct(F.lit(end).alias("end"), text.alias("text"))
    cut = [F.when(F.length("value") >= n, piece(False, F.substring("value", 1, n))) for n in sizes[0]] + [F.when(F.length("value") >= n, piece(True, F.right("value", F.lit(n)))) for n in sizes[1]]
    met = each.select("album_id", "value", F.inline(F.array_compact(F.array(*cut)))).join(filed, ["end", "text"]).where(F.rlike("value", "pattern"))
    hit = met.groupBy("album_id", "policy").agg(F.bool_or("out").alias("out"), F.bool_or(~F.col("out")).alias("in"))
    return hit.where(F.col("in") & ~F.col("out")).select("album_id", "policy")


def governed(albums: DataFrame, policies: list[dict], few: int = FEW_POLICIES) -> DataFrame:
    """The albums that some policy takes in."""
    if len(policies) > few:
        return albums.join(_hits(albums, policies).select("album_id").distinct(), "album_id", "left_semi")
    test = F.lit(False)
    for policy in policies:
        test = test | in_scope(policy, F.col("folder"), F.col("name"))
    return albums.where(test)


def _indexed(albums: DataFrame, policies: list[dict]) -> DataFrame:
    """desired() by the index of globs."""
    settings = [(n, k, json.dumps(v)) for n, policy in enumerate(policies, 1) for k, v in policy.items() if k not in ("scope", "exclude")]
    wants = _hits(albums, policies).join(_listed(albums, settings, "policy int, setting string, desired string"), "policy")
    return wants.groupBy("album_id", "setting").agg(F.max_by("desired", "policy").alias("desired"), F.max("policy").alias("policy"))


def desired(albums: DataFrame, policies: list[dict], few: int = FEW_POLICIES) -> DataFrame:
    """(album_id, setting, desired, policy): for each setting the last policy that matches; values are JSON text.

    A few policies become one array expression for each album, so albums are
    neither joined nor shuffled. That expression grows with policies and
    settings, so more of them are looked up in an index; results are the same.
    """
    if len(policies) > few:
        return _indexed(albums, policies)
    wants = []
    settings = sorted({k for p in policies for k in p if k not in ("scope", "exclude")})
    for setting in settings:
        value = None
        for n, policy in reversed(list(enumerate(policies, 1))):
            if setting in policy:
                test = in_scope(policy, F.col("folder"), F.col("name"))
                found = F.struct(F.lit(setting).alias("setting"), F.lit(json.dumps(policy[setting])).alias("desired"), F.lit(n).alias("policy"))
                value = F.when(test, found) if value is None else value.when(test, found)
        wants.append(value)
    if not wants:
        return albums.select("album_id", F.lit("").alias("setting"), F.lit("").alias("desired"), F.lit(0).alias("policy")).limit(0)
    return albums.select("album_id", F.inline(F.filter(F.array(*wants), lambda w: w.isNotNull())))


def drift(actual: DataFrame, want: DataFrame) -> DataFrame:
    """(album_id, place, setting, actual, desired, policy, warning) of settings to fix and of warnings.

    actual: album_id, setting, value (JSON text; effective_privacy and
    folder_privacy too). Fixes come with downloads first, then by name; place
    is that order, null for warnings. download_size counts only with downloads
    wanted, or on if nothing is wanted for them.
    """
    have = actual.where(~F.col("setting").isin("effective_privacy", "folder_privacy")).select("album_id", "setting", F.col("value").alias("actual"))
    both = want.join(have, ["album_id", "setting"], "left")
    one = lambda df, setting, column, name: df.where(F.col("setting") == setting).select("album_id", F.col(column).alias(name))
    on = one(actual, "downloads", "value", "downloads_are").join(one(want, "downloads", "desired", "downloads_wanted"), "album_id", "full_outer").select("album_id", (F.coalesce("downloads_wanted", "downloads_are") == "true").alias("downloads"))
    both = both.join(on, "album_id", "left")
    idle = (F.col("setting") == "download_size") & ~F.coalesce("downloads", F.lit(False))
    fixes = both.where(~idle & ~F.col("desired").eqNullSafe(F.col("actual")))
    place = F.when(F.col("setting") == "downloads", F.lit("")).otherwise(F.col("setting"))
    fixes = fixes.select("album_id", place.alias("place"), "setting", "actual", "desired", "policy", F.lit(None).cast("string").alias("warning"))
    blank = [F.lit(None).cast("string").alias(c) for c in ("place", "setting", "actual", "desired")]
    unused = both.where(idle).select("album_id", *blank, "policy", F.format_string(UNUSED_SIZE, F.col("policy")).alias("warning"))

    ranks = F.create_map(*[F.lit(x) for k, v in PRIVACY_RANK.items() for x in (json.dumps(k), v)])
    rank = lambda c: F.coalesce(F.try_element_at(ranks, F.col(c)), F.lit(0))
    private = one(want, "privacy", "desired", "wanted").join(want.where("setting = 'privacy'").select("album_id", "policy"), "album_id")
    for setting, name in (("folder_privacy", "folder"), ("effective_privacy", "effective"), ("privacy", "own")):
        private = private.join(one(actual, setting, "value", name), "album_id", "left")
    reported = F.coalesce(F.col("folder"), F.lit("null")) != "null"
    capped = F.when(reported, rank("folder") > rank("wanted")).otherwise((rank("effective") > rank("wanted")) & (rank("effective") > rank("own")))
    limit = F.when(reported, F.col("folder")).otherwise(F.col("effective"))
    text = F.concat(F.lit(BLOCKED[0]), F.replace(limit, F.lit('"')), F.lit(BLOCKED[1]), F.replace("wanted", F.lit('"')), F.lit(BLOCKED[2]))
    blocked = private.where(capped).select("album_id", *blank, "policy", text.alias("warning"))
    return fixes.unionByName(unused).unionByName(blocked)


def audit_status(actual: Column, allowed: Column) -> Column:
    """planned, or review where the current value is unknown and a change couldn't be undone."""
    return F.when(F.array_contains(allowed, actual), "planned").otherwise("review")


def finding(count: Column, soft_cap: int, hard_cap: int) -> Column:
    """empty, over or near the item cap, or null."""
    return (
        F.when(count == 0, "empty")
        .when(count > hard_cap, F.format_string(OVER_CAP.format(hard_cap), count))
        .when(count >= soft_cap, F.format_string(NEAR_CAP.format(hard_cap), count))
    )


def unsupported(policies: list[dict], allowed: dict[str, list]) -> list[str]:
    return sorted({k for p in policies for k in p if k not in ("scope", "exclude") and k not in allowed})


def rename_collisions(proposals: DataFrame, albums: DataFrame) -> DataFrame:
    """proposals (album_id, folder, name, new, auto) with status: review where the new name is taken in the folder.

    Taken by another album, by the old name of one, or by a proposal that
    comes earlier in the order of name and album_id.
    """
    from pyspark.sql import Window

    lower = F.lower("new")
    names = albums.select("folder", F.lower("name").alias("_new")).distinct()
    own = F.lower(F.coalesce("name", F.lit("")))
    marked = proposals.withColumn("_new", lower).join(names.withColumn("_taken", F.lit(True)), ["folder", "_new"], "left")
    before = F.row_number().over(Window.partitionBy("folder", "_new").orderBy(F.asc_nulls_first("name"), "album_id")) > 1
    other = (F.col("_taken").isNotNull() | before) & (F.col("_new") != own)
    status = F.when(other, "review").when(F.col("auto"), "planned").otherwise("review")
    return marked.withColumn("status", status).drop("_new", "_taken")
