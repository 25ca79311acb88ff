import datetime
import hashlib
import io
import json
import struct
import tarfile
import zipfile

import pytest
from lakecurator.operators import accounting
from lakecurator.plans import rendering, runs, staging
from lakecurator.plans.store import Store
from lakecurator.sources import archive_format, archives, media, stills
from lakecurator.sources.files import opened
from lakecurator.streaming import arrivals
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith


def box(kind, content, long=False):
    return struct.pack(">I4sQ", 1, kind, len(content) + 16) + content if long else struct.pack(">I4s", len(content) + 8, kind) + content


def movie(width=1920, height=1080, seconds=2.5, created=1704067200, apple=None, version=0, last=False, noise=b""):
    raw = created + media.EPOCH_1904 if created else 0
    if version:
        header = bytes([1, 0, 0, 0]) + struct.pack(">QQIQ", raw, raw, 1000, int(seconds * 1000))
    else:
        header = bytes(4) + struct.pack(">IIII", raw, raw, 1000, int(seconds * 1000))
    track = lambda w, h: box(b"trak", box(b"tkhd", bytes([version, 0, 0, 0]) + bytes(84 if version else 72) + struct.pack(">II", w << 16, h << 16)))
    extra = box(b"meta", media.CREATION_KEY + b"...." + apple.encode()) if apple else b""
    moov = box(b"moov", box(b"mvhd", header + bytes(80)) + track(0, 0) + track(width, height) + extra)
    data = box(b"mdat", noise or b"mvhd junk" * 10, long=True)
    return box(b"ftyp", b"qt  ") + (data + moov if last else moov + data)


@pytest.mark.parametrize("last", [False, True])
@pytest.mark.parametrize("version", [0, 1])
def test_movie_headers(last, version):
    found = media.probe(media.Edges(movie(version=version, last=last)), ".MOV")
    assert found == {"width": 1920, "height": 1080, "duration_s": 2.5, "own_time": "2024-01-01T00:00:00+00:00"}


def test_movie_oddities():
    own = media.probe(media.Edges(movie(apple="2023-06-01T10:00:00+0200")), ".mp4")["own_time"]
    assert own == "2023-06-01T08:00:00+00:00"
    assert media.probe(media.Edges(movie(created=0)), ".mp4")["own_time"] is None
    assert media.probe(media.Edges(b"not a movie at all"), ".mp4")["width"] is None
    whole = movie(last=True, noise=b"x" * 5000)
    edges = media.Edges(whole[:64], whole[-600:], len(whole))
    assert media.probe(edges, ".mp4")["height"] == 1080
    assert media.probe(media.Edges(whole[:64], whole[-20:], len(whole)), ".mp4")["height"] is None


def test_file_systems_by_uri(tmp_path):
    for uri in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        system, path = opened(uri)
        assert path == str(tmp_path) and system.type_name == "local"
    for scheme in ("s3", "s3a", "s3n"):
        system, path = opened(f"{scheme}://bucket/a/b?region=eu-west-1")  # without a region it would be asked for
        assert path == "bucket/a/b" and system.type_name == "s3"


def test_exif_times():
    assert stills.exif_time("2024:01:02 03:04:05", "+02:00") == "2024-01-02T03:04:05+02:00"
    assert stills.exif_time("2024:01:02 03:04:05", "bad") == "2024-01-02T03:04:05"
    assert stills.exif_time("0000:00:00 00:00:00", None) is None and stills.exif_time(None, None) is None


def exif(date=b"2024:01:02 03:04:05\x00", offset=b"+02:00\x00", order="<"):
    """A TIFF block with a directory of dates."""
    mark = b"II" if order == "<" else b"MM"
    entries = [(0x9003, date), (0x9011, offset)]
    at, tail, rows = 8 + 2 + 12 + 4 + 2 + 12 * len(entries) + 4, b"", b""
    for tag, text in entries:
        rows += struct.pack(f"{order}HHII", tag, 2, len(text), at + len(tail))
        tail += text
    first = struct.pack(f"{order}H", 1) + struct.pack(f"{order}HHII", 0x8769, 4, 1, 26) + bytes(4)
    return mark + struct.pack(f"{order}HI", 42, 8) + first + struct.pack(f"{order}H", len(entries)) + rows + bytes(4) + tail


def jpeg(width=4032, height=3024, block=None):
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\x00" + bytes(9)) + (segment(0xE1, b"Exif\x00\x00" + block) if block else b"")
    return out + b"\xff" + segment(0xC4, bytes(20)) + segment(0xC2, bytes([8]) + struct.pack(">HH", height, width) + bytes(6)) + segment(0xDA, bytes(6)) + b"scan"


def test_still_headers():
    for order in "<>":
        assert stills.still_facts(jpeg(block=exif(order=order))) == {"width": 4032, "height": 3024, "own_time": "2024-01-02T03:04:05+02:00"}
    assert stills.still_facts(jpeg(block=exif(offset=b"x\x00")))["own_time"] == "2024-01-02T03:04:05"
    assert stills.still_facts(jpeg(3, 7)) == {"width": 3, "height": 7, "own_time": None}
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    assert stills.still_facts(png) == {"width": 640, "height": 480, "own_time": None}
    assert stills.still_facts(b"GIF89a" + struct.pack("<HH", 5, 6))["height"] == 6
    size = lambda w, h: box(b"ispe", bytes(4) + struct.pack(">II", w, h))
    heic = box(b"ftyp", b"heic") + box(b"meta", size(512, 512) + size(4032, 3024) + size(320, 240)) + box(b"mdat", b"Exif\x00\x00" + exif())
    assert stills.still_facts(heic) == {"width": 4032, "height": 3024, "own_time": "2024-01-02T03:04:05+02:00"}
    assert media.probe(media.Edges(jpeg(block=exif())), ".jpg") == {"width": 4032, "height": 3024, "duration_s": None, "own_time": "2024-01-02T03:04:05+02:00"}


def test_torn_headers_give_what_they_have():
    whole = jpeg(block=exif())
    for n in range(len(whole)):
        assert set(stills.header_facts(whole[:n])) <= {"width", "height", "own_time"}
    block = exif()
    for n in range(len(block)):
        stills.exif_tags(block[:n])
    assert stills.exif_tags(b"II*\x00\xff\xff\xff\xff") == {} and stills.header_facts(b"") == {}


@pytest.fixture
def export(tmp_path):
    files = {"T/a.mp4": movie(), "T/a.json": b'{"title": "a"}', "T/b.txt": b"plain", "T/bad.mp4": box(b"moov", box(b"mvhd", b""))}
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as out:
        for name, data in files.items():
            out.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data)
        out.writestr("T/dir/", b"")
    with tarfile.open(tmp_path / "two.tgz", "w:gz") as out:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(data), 1704067200
            out.addfile(info, io.BytesIO(data))
    (tmp_path / "notes.txt").write_text("no archive")
    return tmp_path, files


def test_archive_members(spark, export):
    folder, files = export
    found = archives.list_archives(spark, str(folder))
    assert [r.archive for r in found.orderBy("archive").collect()] == ["one.zip", "two.tgz"]
    rows = archives.members(found).collect()
    assert {(r.archive, r.path) for r in rows} == {(a, p) for a in ("one.zip", "two.tgz") for p in files}
    for r in rows:
        assert r.md5 == hashlib.md5(files[r.path]).hexdigest() and r.size == len(files[r.path]) and r.mtime == 1704067200
        assert r.json == ('{"title": "a"}' if r.ext == ".json" else None)
        assert (r.width, r.duration_s) == ((1920, 2.5) if r.basename == "a.mp4" else (None, None))
        assert (r.probe_error is None) == (r.basename != "bad.mp4")
    wanted = spark.createDataFrame([("one.zip", "T/b.txt"), ("two.tgz", "T/a.json"), ("two.tgz", "none")], "archive string, path string")
    got = {(r.archive, r.path): bytes(r.content) for r in archives.contents(found, wanted).collect()}
    assert got == {("one.zip", "T/b.txt"): b"plain", ("two.tgz", "T/a.json"): b'{"title": "a"}'}


def test_archives_as_a_format(spark, export):
    folder, files = export
    archive_format.register(spark)
    whole = spark.read.format("archives").load(str(folder))
    index = archives.members(archives.list_archives(spark, str(folder)))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, index.collect()), key=str)

    (folder / "torn.zip").write_bytes(b"PK, but no archive")
    names = spark.read.format("archives").schema("path string, archive string").load(str(folder))
    with pytest.raises(Exception, match="zip"):
        names.collect()
    two = names.where("archive in ('one.zip', 'two.tgz', 'none.zip')")  # the torn one isn't opened
    assert {tuple(r) for r in two.collect()} == {(p, a) for p in files for a in ("one.zip", "two.tgz")}
    assert two.where("path like 'T/a.%' and archive = 'one.zip'").count() == 2
    assert two.where("path = 'T/b.txt' and length(archive) > 3").count() == 2
    assert names.where("archive = 'one.zip' and archive = 'two.tgz'").count() == 0 == names.where("archive = 'none'").count()
    assert spark.read.format("archives").load(str(folder)).where("archive = 'two.tgz' and path = 'T/b.txt'").first().md5 == hashlib.md5(b"plain").hexdigest()


def test_filters_are_taken_over():
    reader = archive_format.ArchiveReader("", ["path", "archive"])
    kept = list(reader.pushFilters([EqualTo(("archive",), "a.zip"), In(("path",), ("x", "y")), StringStartsWith(("path",), "x"), EqualTo(("size",), 3), GreaterThan(("path",), "a"), In(("archive",), ("a.zip", "b.zip"))]))
    assert kept == [EqualTo(("size",), 3), GreaterThan(("path",), "a")]
    assert reader.equal == {"archive": {"a.zip"}, "path": {"x", "y"}} and reader._wanted("path", "x") and not reader._wanted("path", "y")


def test_names_alone_read_no_bytes(export, monkeypatch):
    folder, files = export
    for columns, opened in ((["path", "size"], 0), (["path", "md5"], 4)):
        count = []
        members = archive_format._members
        monkeypatch.setattr(archive_format, "_members", lambda uri: ((p, s, m, lambda b=b: count.append(p) or b()) for p, s, m, b in members(uri)))
        assert len(list(archive_format.ArchiveReader(str(folder), columns).read(archive_format.Archive(str(folder / "one.zip"))))) == 4
        assert len(count) == opened
        monkeypatch.undo()


def test_staged_tables_are_cleaned_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_folder", lambda _: str(tmp_path))
    kept = staging.staged(spark.range(5))
    assert kept.count() == 5 and len(list(tmp_path.iterdir())) == 1
    assert staging.clean_up(spark) and not list(tmp_path.iterdir()) and not staging.clean_up(spark)


def test_runs(spark, tmp_path):
    folder = str(tmp_path / "runs")
    with runs.recorded(spark, folder, "plan", cap=3) as run:
        rows = run.observe("rows", spark.range(10), n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
        rows.write.parquet(str(tmp_path / "out"))
    with runs.recorded(spark, folder, "plan"):
        raise runs.Stopped
    with pytest.raises(ZeroDivisionError):
        with runs.recorded(spark, folder, "apply"):
            1 / 0
    found = {(r.command, r.status): json.loads(r.summary) for r in spark.read.parquet(folder).collect()}
    assert found["plan", "ok"] == {"rows": {"n": 10, "odd": 5}} and found["plan", "stopped"] == {}
    assert found["apply", "failed"]["error"].startswith("ZeroDivisionError")
    assert json.loads(runs.last_notes(spark.read.parquet(folder), "plan")) == {"rows": {"n": 10, "odd": 5}} and runs.last_notes(spark.read.parquet(folder), "none") is None
    many = spark.createDataFrame([(i, c, s) for i in range(40) for c in "ab" for s in ("ok", "failed") if i % 3 or s == "ok"], "run_id long, command string, status string")
    last = runs.last_runs(many).collect()
    assert len(last) == 20 and {r.run_id for r in last if r.status == "failed"} == {38, 37, 35, 34, 32}


def test_index_takes_only_new_archives(spark, export, tmp_path_factory):
    folder, files = export
    index = str(tmp_path_factory.mktemp("index") / "members")
    assert archives.update_index(spark, str(folder), index).count() == 8
    (folder / "two.tgz").rename(folder / "three.tgz")
    assert archives.update_index(spark, str(folder), index).count() == 12
    assert archives.update_index(spark, str(folder), index, force=True).count() == 12


def test_store_swaps_snapshots_and_migrates(spark, tmp_path):
    store = Store(spark, str(tmp_path / "state"))
    store.write(plan=spark.range(3), targets=spark.range(1))
    store.write(plan=store.read("plan").union(spark.range(5, 6)))
    assert store.read("plan").count() == 4 and store.names() == ["plan", "targets"] and not store.has("runs")
    store.event("plan", rows=4)
    store.event("plan", rows=5)
    assert store.events().count() == 2
    add = lambda s: s.write(plan=s.read("plan").withColumn("status", F.lit("pending")))
    assert store.migrate([add]) == [1] and store.migrate([add]) == [] and "status" in store.read("plan").columns
    with pytest.raises(ValueError):
        store.migrate([])


def test_reports(spark, tmp_path):
    classified = spark.createDataFrame([("a.jpg", ".jpg", "not planned"), ("b.jpg", ".jpg", "upload failed"), ("c", "(none)", "not planned")], "ref string, type string, outcome string")
    data = rendering.report("P<1>", accounting.accounting(classified), 2, {"By outcome": accounting.histogram(classified, "outcome")})
    assert data["ok"] and data["outcomes"] == ["upload failed", "not planned"]
    text = rendering.to_markdown(data)
    assert "| all files | 3 | 1 | 2 |" in text and "Open: 2 steps" in text
    assert "P&lt;1&gt;" in rendering.to_html(data) and '"in_progress": 2' in rendering.to_json(data)
    wrong = spark.createDataFrame([("a.jpg", ".jpg", "no such outcome")], "ref string, type string, outcome string")
    with pytest.raises(Exception, match="sum to 0, not to 1"):
        rendering.report("P", accounting.accounting(wrong), 0)
    marked = rendering.report("P", accounting.accounting(wrong), 0, strict=False)
    assert not marked["ok"] and "WARNING" in rendering.to_markdown(marked)
    uploads = spark.createDataFrame([("done", "Live Photo clip, 4s from its still"), ("done", None), ("failed", "x")], "status string, reason string")
    plan = spark.createDataFrame([("move", "done", "date via camera"), ("move", "pending", "?"), ("park_duplicate", "done", "same")], "action string, status string, reason string")
    built = rendering.build("P", classified, uploads, plan, 1)
    assert built["histograms"] == {
        "Uploads by status": [("done", 2), ("failed", 1)],
        "Uploads by seconds from still": [("2-5 s", 1)],
        "Plan by action": [("move", 2), ("park_duplicate", 1)],
        "Plan by status": [("done", 2), ("pending", 1)],
        "Plan by dated by": [("camera", 1), ("other", 1)],
        "Plan by action, status": [("move", "done", 1), ("move", "pending", 1), ("park_duplicate", "done", 1)],
    }
    one = accounting.histograms(plan, [["action"], ["status"]])
    assert one._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    rendering.write_per_file(classified, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_arrivals_report_bytes_once(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    schema = "md5 string, ext string, size long, ts timestamp"
    rows = [("a", ".jpg", 1, at), ("b", ".jpg", 2, at), ("a", ".jpg", 1, at)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: arrivals.append_new(arrivals.first_seen(arrivals.read_new(spark, str(tmp_path / "in"), schema), "ts"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    spark.createDataFrame([("a", ".jpg", 1, at), ("c", ".mp4", 3, at)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r.md5 for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
