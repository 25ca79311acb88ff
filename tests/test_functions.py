import datetime
import fnmatch
import os.path
import random

import pytest
from lakecurator.functions import names, naming, shapes, times
from pyspark.sql import functions as F

TODAY = datetime.date(2026, 10, 7)


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_extension_and_stem_follow_the_path_library(spark):
    rng = random.Random(1)
    values = [".a", "..a.b", "a", "a.b.c", "a.", "", ".", "x y.JPG", "a\nb.c"] + ["".join(rng.choices("ab. (1)", k=rng.randint(0, 9))) for _ in range(400)]
    assert column(spark, values, names.extension) == [os.path.splitext(v)[1] for v in values]
    assert column(spark, values, names.stem) == [os.path.splitext(v)[0] for v in values]


def test_match_key(spark):
    assert column(spark, ["IMG_1.HEIC", "img_1 (2).jpg", "IMG_1(3).JPG", "a (b).jpg", None], names.match_key) == ["img_1", "img_1", "img_1", "a (b)", ""]


def test_globs_match_as_the_shell_does(spark):
    rng = random.Random(2)
    values = ["", "abc", "a/b", "A]b", "x\ny", "a.c", "[a]"] + ["".join(rng.choices("ab[]*?.^-", k=4)) for _ in range(60)]
    for pattern in ["*", "a*", "?b?", "[ab]*", "[!a]*", "a.c", "[^a]*", "[a-c]?*", "[", "a[]]*", "*]"]:
        assert column(spark, values, lambda v, p=pattern: names.glob(v, p)) == [fnmatch.fnmatchcase(v.lower(), pattern.lower()) for v in values], pattern


def test_paths_types_and_outputs(spark):
    assert column(spark, ["a.zip::x/IMG.JPG", "a.zip::x/y", "b"], lambda v: names.file_type(v, F.lit("clip"))) == [".jpg Live Photo clip", "(none) Live Photo clip", "(none) Live Photo clip"]
    assert column(spark, ["x.MOV", "x.zzz"], names.content_type) == ["video/quicktime", "application/octet-stream"]
    found = column(spark, ["a.HEIC", "a.webp", "a.jpg"], lambda v: names.still_output(v, "convert", "skip", [".webp"]))
    assert [(r.name, r.convert, r.skip is None) for r in found] == [("a.JPG", True, True), ("a.webp", False, False), ("a.jpg", False, True)]
    assert column(spark, ["a.heic", "a.png"], lambda v: names.landed_name(v, {".heic": ".jpg"})) == ["a.JPG", "a.png"]
    assert column(spark, ["2024-05-06", None], lambda v: names.fill("{yyyy}-{mm}  {group} ", v, F.lit("G"))) == ["2024-05 G", "- G"]
    assert column(spark, ["2024-05-06", None], lambda v: names.album_path("{yyyy}/{group}/{mm}", v, F.lit(""))) == ["2024/05", ""]
    assert column(spark, ["about 12.5 s", "none"], names.duration_seconds) == [12.5, None]
    assert column(spark, ["p", "p/q", "pq"], lambda v: names.inside(v, "p")) == [True, True, False]


def test_epochs_and_months(spark):
    values = ["2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00", None, "1969-12-31T23:59:58.500000+00:00"]
    assert column(spark, values, times.epoch) == [1704060000, 1704067200, None, None, -1]
    albums = {"photo": "{yyyy}-{mm}", "video": "{yyyy}-{mm} V", "undated_photo": "U", "undated_video": "UV"}
    assert column(spark, [1704067199, None], lambda v: times.dated_album(v, F.lit(False), albums, "Europe/Berlin"), "long") == ["2024-01", "U"]
    now = datetime.datetime(2024, 1, 10, tzinfo=datetime.timezone.utc)
    assert column(spark, ["2024-01-09T00:00:01Z", "2024-01-01T00:00:00Z", None], lambda v: times.recent(v, 5, now)) == [True, False, False]
    assert column(spark, ["2024-06-01T10:00:00Z", "2024-06-01T10:00:00", None], lambda v: times.from_upload(v, "Europe/Berlin")) == ["2024-06-01T12:00:00", "2024-06-01T10:00:00", None]


@pytest.mark.parametrize(
    "name,value,pattern",
    [
        ("IMG_20230504_101112.jpg", "2023-05-04T10:11:12", "camera_datetime"),
        ("PXL_20230504_256112.jpg", "2023-05-04", "camera_datetime"),
        ("Screenshot 2023-05-04 at 9.08.07 PM.png", "2023-05-04T21:08:07", "screenshot"),
        ("Screenshot 2023-05-04 at 12.08.07 AM.png", "2023-05-04T00:08:07", "screenshot"),
        ("IMG-20230504-WA0001.jpg", "2023-05-04", "whatsapp"),
        ("trip 2023-05-04 10.11.12.jpg", "2023-05-04T10:11:12", "iso_date"),
        ("IMG_20231304_101112.jpg", None, None),
        ("IMG_19800504_101112.jpg", None, None),
        ("plain.jpg", None, None),
    ],
)
def test_dates_in_file_names(spark, name, value, pattern):
    (found,) = column(spark, [name], lambda v: times.from_filename(v, TODAY))
    assert (found and (found.value, found.pattern)) == ((value, pattern) if value else None)


ALBUM_NAMES = [
    ("1987.11.02 harbour", (1987, 11, 2), "day", "harbour", "high"),
    ("harbour 2031-11-02", (None, None, None), "none", "harbour 2031-11-02", "none"),
    ("Kites taken on Oct. 9th, 1999", (1999, 10, 9), "day", "Kites", "high"),
    ("3 SEPT 2011 | lake", (2011, 9, 3), "day", "lake", "high"),
    ("x_19990231 or 19990228", (1999, 2, 28), "day", "x_19990231 or", "high"),
    ("Vineyard, november-2002 []", (2002, 11, None), "month", "Vineyard", "high"),
    ("2002_07 – Rome of", (2002, 7, None), "month", "Rome", "high"),
    ("07/2002 Rome", (2002, 7, None), "month", "Rome", "high"),
    ("Ferry 4.5.2006", (2006, 4, 5), "day", "Ferry", "medium"),
    ("Ferry 25.5.2006", (2006, 5, 25), "day", "Ferry", "high"),
    ("Ferry 5.5.2006", (2006, 5, 5), "day", "Ferry", "high"),
    ("Ferry 13.13.2006", (2006, None, None), "year", "Ferry 13.13", "medium"),
    ("Garden may '07", (2007, 5, None), "month", "Garden", "medium"),
    ("Regatta 2001 and 2003", (2001, None, None), "year", "Regatta and 2003", "medium"),
    ("Class of '31 ( )", (1931, None, None), "year", "Class", "medium"),
    ("Winter 1998 – 1999", (1998, None, None), "range", "Winter 1998 – 1999", "none"),
    ("Café'98", (None, None, None), "none", "Café'98", "none"),
    ("Platform #2001", (None, None, None), "none", "Platform #2001", "none"),
    ("on", (None, None, None), "none", "on", "none"),
    ("", (None, None, None), "none", "", "none"),
    (None, (None, None, None), "none", "", "none"),
]


@pytest.fixture(scope="module")
def album_dates(spark):
    names_ = [x[0] for x in ALBUM_NAMES]
    return dict(zip(names_, column(spark, names_, lambda v: naming.parse(v, TODAY))))


@pytest.mark.parametrize("name,iso,precision,subject,confidence", ALBUM_NAMES)
def test_dates_in_album_names(album_dates, name, iso, precision, subject, confidence):
    found = album_dates[name]
    assert ((found["year"], found["month"], found["day"]), found["precision"], found["subject"], found["confidence"]) == (iso, precision, subject, confidence)


def test_date_chain(spark):
    rows = [("IMG_20230504_101112.jpg", None, "2024-01-01T00:00:00Z", "2001-02 Ski"), ("x.jpg", "2022-01-02 03:04:05", None, None), ("x.jpg", None, None, "2001-02 Ski"), ("x.jpg", None, "2024-01-01T00:00:00Z", None), ("x.jpg", None, None, None)]
    df = spark.createDataFrame(rows, "filename string, capture_time string, uploaded string, album_name string")
    columns = {c: F.col(c) for c in df.columns}
    found = [r[0] for r in df.select(naming.date_for(["camera", "filename", "album", "upload"], columns, "UTC", TODAY)).collect()]
    assert [(r.value, r.method) for r in found] == [("2023-05-04T10:11:12", "filename:camera_datetime"), ("2022-01-02T03:04:05", "camera"), ("2001-02-01", "album:ym"), ("2024-01-01T00:00:00", "upload"), (None, "none")]
    with pytest.raises(ValueError):
        naming.date_for(["guess"], columns, "UTC", TODAY)
    plugged = df.select(naming.date_for(["own"], columns, "UTC", TODAY, {"own": lambda c: F.lit("2020-01-01")})["method"]).first()[0]
    assert plugged == "own"


def test_proposals(spark):
    day = [f"2019-06-{14:02d}T10:00:00"] * 6
    spread = [f"2019-06-{d:02d}" for d in range(1, 11)]
    rows = [
        (1, "2003-04-05 First snow", None, None),
        (2, "Dunes June 2019", None, None),
        (3, "Regatta 2010", None, None),
        (4, "Picnic", day, None),
        (5, "Picnic", spread, None),
        (6, "Picnic 2019", spread, None),
        (7, "Picnic", spread, ["2010-01-01", "2019-01-01"]),
        (8, "Choir 2018/2019", spread, None),
        (9, "Picnic", day[:2], None),
        (10, "Choir 2018/2019", None, None),
    ]
    templates = {"day": "{yyyy}-{mm}-{dd} {subject}", "month": "{yyyy}-{mm} {subject}", "year": "{yyyy} {subject}"}
    df = spark.createDataFrame(rows, "album_id int, name string, photo_dates array<string>, upload_dates array<string>")
    found = {r.album_id: r for r in naming.propose(df, templates, TODAY).collect()}
    assert [(found[i].new, found[i].source, found[i].auto) for i in range(1, 11)] == [
        (None, "name", False),
        ("2019-06 Dunes", "name", True),
        ("2010 Regatta", "name", False),
        ("2019-06-14 Picnic", "photos", False),
        ("2019-06 Picnic", "photos", False),
        ("2019-06 Picnic", "name+photos", True),
        (None, "none", False),
        ("2019-06 Choir 2018/2019", "range+photos", True),
        (None, "none", False),
        (None, "none", False),
    ]
    assert found[1].note == "named as it should be" and found[7].note.startswith("undated name; uploads went on for ") and found[9].note.endswith("under 5 photos have dates")


def test_hashes_and_shapes(spark):
    assert column(spark, ["ffffffffffffffff", "0000000000000001"], lambda v: shapes.hash_to_hex(shapes.hash_from_hex(v))) == ["ffffffffffffffff", "0000000000000001"]
    assert column(spark, ["ffffffffffffffff"], lambda v: shapes.hamming(shapes.hash_from_hex(v), F.lit(0).cast("long"))) == [64]
    gray = [[(i * 37) % 251 for i in range(72)]]
    bits = 0
    for row in range(8):
        for c in range(8):
            bits = bits << 1 | (gray[0][9 * row + c] > gray[0][9 * row + c + 1])
    (found,) = column(spark, gray, shapes.difference_hash, "array<int>")
    assert found & (2**64 - 1) == bits
    df = spark.createDataFrame([(10.0, 1920, 1080, 10.4, 1280, 720), (10.0, 1920, 1080, 11.0, 1280, 720), (0.0, 1, 1, 2.0, 1, 1), (10.0, None, None, 10.0, 5, 5), (10.0, 1280, 720, 10.0, 1920, 1080)], "a double, b int, c int, d double, e int, f int")
    got = [r[0] for r in df.select(shapes.video_gap(dict(duration=F.col("a"), width=F.col("b"), height=F.col("c")), dict(duration=F.col("d"), width=F.col("e"), height=F.col("f")))).collect()]
    assert [(None if r.gap is None else round(r.gap, 3), r.known) for r in got] == [(0.4, True), (None, True), (None, False), (0.0, True), (None, True)]
