"""Times: instants in unix seconds, local ISO text, and months of a time zone."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = r"(Z|[+-]\d\d:?\d\d(:?\d\d)?)$"
#: Earlier dates come from unset cameras.
FIRST_YEAR = 1990

#: Dates in file names, in the order in which they are tried. Groups y, m, d and maybe H, M, S, ampm.
FILENAME_PATTERNS = [
    ("camera_datetime", r"(?:^|[^0-9])(?:IMG|VID|PXL|MVIMG|PANO|BURST)?_?(\d{4})(\d\d)(\d\d)[_-](\d\d)(\d\d)(\d\d)", 7),
    ("screenshot", r"Screen ?[Ss]hot[ _](\d{4})-(\d\d)-(\d\d)(?:(?: at |[ _-])(\d{1,2})[.:-](\d\d)[.:-](\d\d)(?:\s?([AP]M))?)?", 8),
    ("whatsapp", r"(?:IMG|VID)-(\d{4})(\d\d)(\d\d)-WA\d+", 4),
    ("iso_date", r"(?:^|[^0-9])(\d{4})-(\d\d)-(\d\d)(?:[ T_](\d\d)[.:-](\d\d)[.:-](\d\d))?(?:[^0-9]|$)", 7),
]


def epoch(iso: Column) -> Column:
    """Unix seconds of ISO text with an offset; text without one can't be placed in time and gives null."""
    whole = F.unix_micros(F.try_to_timestamp(F.when(iso.rlike(_OFFSET), iso)))
    return (F.signum(whole) * F.floor(F.abs(whole) / 1_000_000)).cast("long")


def local_month(seconds: Column, zone: str) -> Column:
    """The month of an instant in a time zone, whatever the session's zone."""
    utc = F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), "yyyy-MM")


def dated_album(seconds: Column, is_video: Column, albums: dict[str, str], zone: str) -> Column:
    """The album of a capture time: a month's, or the one for undated items. albums: photo, video, undated_photo, undated_video."""
    from .names import fill

    month = local_month(seconds, zone)
    dated = F.when(is_video, fill(albums["video"], month, tidy=False)).otherwise(fill(albums["photo"], month, tidy=False))
    return F.when(seconds.isNull(), F.when(is_video, albums["undated_video"]).otherwise(albums["undated_photo"])).otherwise(dated)


def plausible(year: Column, month: Column, day: Column, today: datetime.date) -> Column:
    """Whether text fields form a real date from FIRST_YEAR to tomorrow."""
    text = F.concat_ws("-", year, month, day)
    date = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), text.try_cast("date"))
    return F.coalesce(date.between(F.lit(datetime.date(FIRST_YEAR, 1, 1)), F.lit(today + datetime.timedelta(days=1))), F.lit(False))


def _filename_date(label: str, groups: int, parts: Column, today: datetime.date) -> Column:
    """struct(value, pattern) of a match's groups, or null if they are no plausible date."""
    g = lambda i: F.get(parts, F.lit(i - 1))
    value = date = F.concat_ws("-", g(1), g(2), g(3))
    if groups > 4:
        hour, minute, second = (F.nullif(g(i), F.lit("")).cast("int") for i in (4, 5, 6))  # digits or nothing; try_cast is slow where it fails
        good = (hour < 24) & (minute < 60) & (second < 60)
        if groups == 8:
            hour = F.when(g(7) == "PM", hour % 12 + 12).when(g(7) == "AM", hour % 12).otherwise(hour)
        value = F.when(good, F.concat(date, F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), g(5), F.lit(":"), g(6))).otherwise(date)
    return F.when(plausible(g(1), g(2), g(3), today), F.struct(value.alias("value"), F.lit(label).alias("pattern")))


def from_filename(name: Column, today: datetime.date) -> Column:
    """struct(value, pattern) of the first pattern that gives a plausible date, or null.

    A pattern is matched once and its groups are taken from the match.
    """
    found = []
    for label, pattern, groups in FILENAME_PATTERNS:
        listed = "|".join(f"${i}" for i in range(1, groups))
        hit = F.regexp_extract(name, pattern, 0)
        parts = F.split(F.regexp_replace(hit, pattern, listed), "\\|", -1)
        one = F.filter(F.transform(F.array(parts), lambda p: _filename_date(label, groups, p, today)), lambda x: x.isNotNull())  # noqa: B023  an array of one, so that the groups are named once
        found.append(F.when(name.rlike(pattern), F.get(one, F.lit(0))))
    return F.coalesce(*found)


def from_camera(capture_time: Column, today: datetime.date) -> Column:
    text = F.substring(F.replace(capture_time, F.lit(" "), F.lit("T")), 1, 19)
    return F.when((F.length(text) >= 10) & plausible(F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2), today), text)


def from_upload(uploaded: Column, zone: str) -> Column:
    """Local ISO text of an upload time; text without an offset is local already."""
    at = F.try_to_timestamp(F.when(uploaded.rlike(_OFFSET), uploaded))
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(F.try_to_timestamp(F.nullif(uploaded, F.lit(""))), "yyyy-MM-dd'T'HH:mm:ss"))


def recent(uploaded: Column, days: int, now: datetime.datetime) -> Column:
    """Whether an upload time lies less than `days` before now; 0 days never."""
    if not days:
        return F.lit(False)
    return F.coalesce(F.try_to_timestamp(F.nullif(uploaded, F.lit(""))) > F.lit(now - datetime.timedelta(days=days)), F.lit(False))
