"""Names, paths and references as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content types by extension.
CONTENT_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".heic": "image/heic",
    ".heif": "image/heif",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".dng": "image/x-adobe-dng",
    ".mp4": "video/mp4",
    ".mov": "video/quicktime",
    ".m4v": "video/mp4",
    ".3gp": "video/3gpp",
}
#: Extensions of the high-efficiency still formats.
HEIF = (".heic", ".heif", ".hif")


def extension(name: Column) -> Column:
    """The last dot and what follows it; leading dots start no extension."""
    return F.coalesce(F.regexp_extract(name, r"(?s)^\.*[^./].*(\.[^./]*)$", 1), F.lit(""))


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def match_key(name: Column) -> Column:
    """What copies of one file are called alike by: the lower-case stem without a trailing counter."""
    return F.regexp_replace(F.lower(stem(F.coalesce(name, F.lit("")))), r"\s?\(\d+\)$", "")


def content_type(name: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.lower(extension(name))), F.lit("application/octet-stream"))


def path_of(folder: Column, name: Column) -> Column:
    """Folder and name joined, leaving out what is null or empty."""
    return F.concat_ws("/", F.nullif(folder, F.lit("")), F.nullif(name, F.lit("")))


def archive_of(ref: Column) -> Column:
    return F.split(ref, "::", 2)[0]


def member_of(ref: Column) -> Column:
    return F.get(F.split(ref, "::", 2), F.lit(1))


def file_type(ref: Column, kind: Column) -> Column:
    """The label that a report counts a file under."""
    tail = F.element_at(F.split(F.coalesce(member_of(ref), ref), "/"), -1)
    plain = F.coalesce(F.nullif(F.lower(extension(tail)), F.lit("")), F.lit("(none)"))
    return F.concat(plain, F.when(kind == "clip", " Live Photo clip").when(kind == "video", " video").otherwise(""))


def glob_pattern(glob: str) -> str:
    """A regular expression for a shell glob: * ? [abc] [!abc]."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append(f"[^{body[1:]}]" if body[0] == "!" else f"[\\{body}]" if body[0] == "^" else f"[{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def glob(value: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether value matches a shell glob; null matches as an empty text."""
    text = F.coalesce(value, F.lit(""))
    return (F.lower(text) if ignore_case else text).rlike(glob_pattern(pattern.lower() if ignore_case else pattern))


def glob_any(values: list[Column], patterns: list[str], ignore_case: bool = True) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        for value in values:
            found = found | glob(value, pattern, ignore_case)
    return found


def inside(folder: Column, base: str) -> Column:
    """Whether a folder is base or lies below it."""
    return (folder == base) | folder.startswith(f"{base}/")


def still_output(name: Column, heic: str, rejected_types: str, rejected: list[str]) -> Column:
    """struct(name, convert, skip): how a still is uploaded under the policies for HEIC and rejected types."""
    kind = F.lower(extension(name))
    as_jpeg = F.struct(F.concat(stem(name), F.lit(".JPG")).alias("name"), F.lit(True).alias("convert"), F.lit(None).cast("string").alias("skip"))
    as_is = lambda skip: F.struct(name.alias("name"), F.lit(False).alias("convert"), skip.cast("string").alias("skip"))
    out = F.when(kind.isin(*HEIF), as_jpeg if heic == "convert" else as_is(F.lit(None)))
    refused = as_jpeg if rejected_types == "convert" else as_is(F.concat(kind, F.lit(" is rejected by the destination (rejected_types = skip)")))
    return out.when(kind.isin(*rejected), refused).otherwise(as_is(F.lit(None)))


def landed_name(name: Column, converts: dict[str, str]) -> Column:
    """The name a file has after the destination's own conversions, such as {".heic": ".jpg"}."""
    out = name
    for source, target in converts.items():
        out = F.when(F.lower(extension(name)) == source, F.concat(stem(name), F.lit(target.upper()))).otherwise(out)
    return out


def fill(template: str, when: Column, group: Column | None = None, tidy: bool = True) -> Column:
    """A name from a template with {yyyy}, {mm}, {dd} and {group}; when is ISO text or null."""
    text = F.coalesce(when, F.lit(""))
    out = F.lit(template)
    for key, value in (("{yyyy}", F.substring(text, 1, 4)), ("{mm}", F.substring(text, 6, 2)), ("{dd}", F.substring(text, 9, 2)), ("{group}", F.coalesce(group, F.lit("")) if group is not None else F.lit(""))):
        out = F.replace(out, F.lit(key), value)
    return F.trim(F.regexp_replace(out, r"\s+", " ")) if tidy else out


def album_path(template: str, when: Column, group: Column) -> Column:
    """fill(), with each segment tidied and empty ones left out."""
    parts = F.transform(F.split(fill(template, when, group, tidy=False), "/"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "/")


def part_name(base: Column, n: Column) -> Column:
    return F.when(n == 1, base).otherwise(F.concat(base, F.lit(" - Part "), n.cast("string")))


def duration_seconds(text: Column) -> Column:
    """The first number in a text."""
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
