from lakecurator.operators import inventory
from pyspark.sql import functions as F


def test_scopes(spark):
    albums = spark.createDataFrame([("1", "F", "a"), ("2", "F/G", "b"), ("3", "FG", "c"), ("4", "H", "d"), ("4", "H", "d")], "album_id string, folder string, name string")
    ids = lambda *p: sorted(r.album_id for r in inventory.albums_in_scope(albums, list(p)).collect())
    assert ids("/") == ["1", "2", "3", "4"] and ids("F") == ["1", "2"] and ids("H/d", "F/G") == ["2", "4"] and ids() == [] and ids("none") == []


def test_refresh_and_status(spark):
    albums = spark.createDataFrame([("1", "F", "a"), ("2", "F", "b")], "album_id string, folder string, name string")
    items = spark.createDataFrame([("x", "1", "n"), ("x", "1", "m"), ("y", "9", "n")], "item_id string, album_id string, name string")
    known = spark.createDataFrame([("1",), ("7",)], "album_id string")
    a, i, gone = inventory.refresh(albums, items, known)
    assert {(r.album_id, r.item_count) for r in a.collect()} == {("1", 1), ("2", 0)} and [r.name for r in i.collect()] == ["n"] and [r.album_id for r in gone.collect()] == ["7"]
    s = spark.createDataFrame([("done",), ("done",), ("failed",)], "status string")
    assert {tuple(r) for r in inventory.status_counts({"plan": s, "uploads": s.limit(0)}).collect()} == {("plan", "done", 2), ("plan", "failed", 1)}


def test_reviews(spark):
    matches = spark.createDataFrame([("a", "review", None), ("b", "review", None), ("c", "review", "same"), ("d", "new", None)], "ref string, decision string, reviewed string")
    numbered = spark.createDataFrame([(1, "b")], "number int, ref string")
    pairs = inventory.review_pairs(matches, numbered)
    assert {tuple(r) for r in pairs.collect()} == {(1, "b"), (2, "a")}
    files = spark.createDataFrame([("same", "0001 source x.jpg"), ("different", "0001 destination x.jpg"), ("different", "0002 source y.jpg"), ("same", "note.txt"), ("", "0002 source z.jpg")], "folder string, name string")
    answers, conflicts = inventory.read_answers(files, pairs)
    assert [tuple(r) for r in answers.collect()] == [("a", "different")] and [r.number for r in conflicts.collect()] == [1]
    assert [r.ref for r in inventory.undecided(matches, matches.where("ref <> 'd'")).collect()] == ["d"]


def test_video_facts(spark):
    sources = spark.createDataFrame([("V1.MOV", "video", "m"), ("V2.MOV", "video", "k"), ("P.jpg", "photo", None)], "name string, kind string, md5 string")
    dests = spark.createDataFrame([("1", "v1.mp4", "z", True, None, 5, None), ("2", "v2.mp4", "k", True, None, None, None), ("3", "p.mp4", None, True, None, None, None)], "item_id string, name string, md5 string, is_video boolean, duration_s double, width int, height int")
    assert [r.item_id for r in inventory.videos_to_look_up(sources, dests).collect()] == ["1"]
    facts = spark.createDataFrame([("1", 2.0, 9, 9)], "item_id string, duration_s double, width int, height int")
    found = inventory.with_video_facts(dests, facts).where("item_id = '1'").first()
    assert (found.duration_s, found.width, found.height) == (2.0, 5, 9)


def test_report_sources_and_targets(spark):
    items = spark.createDataFrame([("a", "A.webp", "photo", None), ("b", "B.heic", "photo", "b2")], "ref string, name string, kind string, motion_ref string")
    found = {tuple(r) for r in inventory.report_sources(items, [".webp"], unpaired_clips="skip").collect()}
    assert found == {("a", "photo", None, "rejected_types"), ("b", "photo", None, None), ("b2", "clip", "b", "unpaired_clips")}
    rows = spark.createDataFrame([("T", "still", None, "r", "planned"), ("T", "clip", None, "r", "planned"), ("V", "clip", "al", "r", "planned"), ("K", "clip", "x", "r", "planned")], "target_name string, role string, album_id string, reason string, status string")
    targets = spark.createDataFrame([("K", "video", "y", 1)], "name string, kind string, album_id string, planned long")
    albums = spark.createDataFrame([("t1", "Home", "T")], "album_id string, folder string, name string")
    held, new = inventory.with_target_albums(rows, targets, albums, "Home")
    assert {(r.target_name, r.role): r.status for r in held.collect()}[("K", "clip")] == "held"
    assert {(r.name, r.kind, r.album_id) for r in new.collect()} == {("T", "photo", "t1"), ("V", "video", "al")}
    assert held.where(F.col("status") == "planned").count() == 3
