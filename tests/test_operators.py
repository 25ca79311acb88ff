import collections
import datetime
import itertools
import os
import random

import numpy as np
import pytest
from lakecurator.functions import naming, plugins, shapes
from lakecurator.operators import accounting, changes, classes, dedupe, elimination, matching, pictures, placing, policies, scans, sidecars, steps, timelines, workflows
from lakecurator.plans.importing import ImportSettings, plan_import
from pyspark.sql import Window
from pyspark.sql import functions as F

SOURCE = "ref string, name string, kind string, md5 string, duration_s double, width int, height int"
DEST = "item_id string, album_id string, name string, md5 string, is_video boolean, duration_s double, width int, height int"


def rows_of(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


def greedy(pairs):
    left, right, out = set(), set(), set()
    for gap, a, b in sorted(pairs):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.add((gap, a, b))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_equals_a_sorted_pass(spark, seed):
    rng = random.Random(seed)
    pairs = {(a, b): rng.randrange(6) for a in range(12) for b in range(12) if rng.random() < 0.4}
    df = spark.createDataFrame([(g, a, b) for (a, b), g in pairs.items()], "gap int, l int, r int")
    found = {tuple(r) for r in matching.greedy_one_to_one(df, "l", "r", ["gap"]).select("gap", "l", "r").collect()}
    assert found == greedy([(g, a, b) for (a, b), g in pairs.items()])


@pytest.mark.parametrize("rounds", [0, 1])
def test_the_pass_over_components_equals_a_sorted_pass(spark, rounds):
    rng = random.Random(rounds)
    pairs = {(f"l{a}", f"r{b}"): rng.randrange(3) for block in range(6) for a in range(10 * block, 10 * block + 10) for b in range(10 * block, 10 * block + 10) if rng.random() < 0.3}
    df = spark.createDataFrame([(g, a, b) for (a, b), g in pairs.items()], "gap int, l string, r string")
    found = {tuple(r) for r in matching.greedy_one_to_one(df, "l", "r", ["gap"], rounds=rounds).select("gap", "l", "r").collect()}
    assert found == greedy([(g, a, b) for (a, b), g in pairs.items()])


def test_long_ties_and_chains_are_matched_whole(spark):
    ties = spark.range(1_000).select(F.col("id").alias("l")).crossJoin(spark.range(1_000).select(F.col("id").alias("r"))).select(F.lit(5).alias("gap"), "l", "r")
    chain = spark.range(1_200).select((F.col("id") + 10_000).cast("int").alias("gap"), (F.floor((F.col("id") + 1) / 2) + 5_000).alias("l"), (F.floor(F.col("id") / 2) + 5_000).alias("r"))
    found = {tuple(r) for r in matching.greedy_one_to_one(ties.unionByName(chain), "l", "r", ["gap"]).select("gap", "l", "r").collect()}
    assert found == {(5, i, i) for i in range(1_000)} | greedy([tuple(r) for r in chain.collect()])


CLIPS, STILLS = ("{0}_id string, {0}_ts long, {0}_ratio double, {0}_order int, u int".format(x) for x in ("clip", "still"))


def pair_pass(clips, stills, window):
    """clips and stills: (id, ts, ratio, order, key). All pairs, sorted, each side taken once."""
    rank = lambda x: (x is not None, x)
    met = [(abs(s[1] - c[1]), rank(c[3]), rank(s[3]), c[0], s[0]) for c in clips for s in stills if None not in (c[1], s[1], c[2], s[2], c[4]) and s[2] and c[4] == s[4] and abs(s[1] - c[1]) <= window and abs(s[2] - c[2]) / s[2] <= 0.02]
    count = collections.Counter(m[3] for m in met)
    used, expected = set(), {}
    for gap, _, _, c, s in sorted(met):
        if c not in expected and s not in used:
            used.add(s)
            expected[c] = (s, gap, count[c])
    return expected


@pytest.mark.parametrize("seed,span,window,key_rows", [(7, 500, 60, None), (8, 40, 3, 0), (9, 30, 60, None), (10, 3000, 9, 0)])
def test_clip_pairs_equal_a_sorted_pass(spark, monkeypatch, seed, span, window, key_rows):
    if key_rows is not None:
        monkeypatch.setattr(scans, "KEY_ROWS", key_rows)
    rng = random.Random(seed)
    shape = lambda: rng.choice([1.5, 1.78, 1.51, 1.52, 1.33, None, 0.0] if seed == 9 else [1.5, 1.78, 1.51])
    side = lambda letter, n: [(f"{letter}{i}", rng.choice([rng.randrange(span), rng.randrange(span), None]), shape(), rng.choice([i, 5, None]), rng.choice([1, 1, 2, None])) for i in range(n)]
    clips, stills = side("c", 150), side("s", 170)
    left, right = spark.createDataFrame(clips, CLIPS).repartition(3), spark.createDataFrame(stills, STILLS).repartition(3)
    assert rows_of(timelines.pair_clips(left, right, window, keys=["u"]), "clip_id", "still_id", "gap", "candidates") == pair_pass(clips, stills, window)
    apart = [c[:4] + (1,) for c in clips], [s[:4] + (1,) for s in stills]
    assert rows_of(timelines.pair_clips(left, right, window), "clip_id", "still_id", "gap", "candidates") == pair_pass(*apart, window)


def test_a_burst_is_paired_in_memory_linear_in_rows(spark):
    """10,000 clips and stills of one second would make 100 million pairs."""
    n = 10_000
    side = lambda name: spark.range(n).select(F.format_string("%05d", "id").alias(f"{name}_id"), F.lit(77).cast("long").alias(f"{name}_ts"), F.lit(1.5).alias(f"{name}_ratio"), (n - F.col("id")).cast("int").alias(f"{name}_order"))
    found = timelines.pair_clips(side("clip"), side("still")).where("clip_id = still_id and gap = 0")
    assert found.agg(F.count("*"), F.count_distinct("clip_id"), F.min("candidates")).first() == (n, n, n)


def test_islands_split_at_wide_gaps(spark, monkeypatch):
    times = [0, 5, 10, 16, 22, 22, 22, 30]
    for key_rows in (0, 100):
        monkeypatch.setattr(scans, "KEY_ROWS", key_rows)
        df = spark.createDataFrame([(1, t, i) for i, t in enumerate(times)] + [(2, 3, 99)], "k int, t long, id int")
        found = rows_of(timelines.islands(df, ["k"], "t", ["id"], 5), "id", "island")
        assert [found[i][0] for i in range(8)] == [1, 1, 1, 2, 3, 3, 3, 4] and found[99] == (1,)


def decide(spark, sources, dests, hashes=(), dest_hashes=(), **kwargs):
    s, d = spark.createDataFrame(sources, SOURCE), spark.createDataFrame(dests, DEST)
    h = spark.createDataFrame(list(hashes), "ref string, hashes array<bigint>")
    k = spark.createDataFrame(list(dest_hashes), "item_id string, hash bigint")
    return rows_of(dedupe.decide(s, d, h, k, **kwargs), "ref", "decision", "method", "dest_item_id", "dist")


def photo(ref, name, md5=None):
    return (ref, name, "photo", md5, None, None, None)


def test_photo_decisions(spark):
    bits = lambda n: (1 << n) - 1
    sources = [photo("a", "IMG_1.HEIC"), photo("b", "IMG_2.HEIC"), photo("c", "IMG_3.HEIC"), photo("d", "IMG_4.HEIC"), photo("e", "IMG_5.HEIC"), photo("f", "x.jpg", "m1"), photo("g", "y.jpg", "m1"), photo("h", "z.jpg", "m2")]
    dests = [(f"d{i}", "A", f"IMG_{i} (1).JPG", None, False, None, None, None) for i in (1, 2, 3, 5)] + [("d9", "A", "q.jpg", "m1", False, None, None, None), ("d8", "B", "q.jpg", "m1", False, None, None, None)]
    hashes = [(r, [0, -1, -1, -1]) for r in "abcd"] + [("e", None)]
    found = decide(spark, sources, dests, hashes, [("d1", bits(2)), ("d2", bits(25)), ("d3", bits(10)), ("d5", 0)])
    assert found == {"a": ("same", "content", "d1", 2), "b": ("new", "content", None, 25), "c": ("review", "content", "d3", 10), "d": ("new", "none", None, None), "e": ("review", "content", None, None), "f": ("exact", "md5", "d9", 0), "g": ("source_duplicate", "md5", None, None), "h": ("new", "none", None, None)}
    exact = decide(spark, sources, dests, hashes, mode="exact")
    assert exact["a"] == ("new", "md5", None, None) and exact["f"][0] == "exact"
    assert decide(spark, sources, dests, mode="off")["f"] == ("new", "off", None, None)
    with pytest.raises(ValueError):
        decide(spark, sources, dests, mode="guess")


def test_bursts_are_matched_one_to_one(spark):
    sources = [photo(r, "IMG_1.jpg") for r in "abc"]
    dests = [(i, "A", "IMG_1.jpg", None, False, None, None, None) for i in ("x", "y")]
    found = decide(spark, sources, dests, [("a", [0] * 4), ("b", [0b11] * 4), ("c", [0b1] * 4)], [("x", 0), ("y", 0b11)])
    assert found["a"][:3] == ("same", "content", "x") and found["b"][:3] == ("same", "content", "y") and found["c"][:2] == ("new", "content")


def test_video_decisions(spark):
    video = lambda ref, name, d, w=1920, h=1080: (ref, name, "video", None, d, w, h)
    sources = [video("a", "V1.MOV", 10.0), video("b", "V2.MOV", 10.0), video("c", "V3.MOV", None), video("d", "V4.MOV", 5.0), video("e", "V1.MOV", 10.3)]
    dests = [("x", "A", "V1.mp4", None, True, 10.2, 1280, 720), ("y", "A", "V2.mp4", None, True, 30.0, 1280, 720), ("z", "A", "V3.mp4", None, True, 9.0, 1, 1)]
    found = decide(spark, sources, dests)
    assert {k: v[:3] for k, v in found.items()} == {"a": ("new", "video_shape", None), "b": ("new", "video_shape", None), "c": ("review", "video_shape", "z"), "d": ("new", "none", None), "e": ("same", "video_shape", "x")}


def test_answers_survive_deciding_again(spark):
    stored = spark.createDataFrame([("a", "review", "same"), ("b", "new", None)], "ref string, decision string, reviewed string")
    fresh = spark.createDataFrame([("a", "new"), ("c", "exact")], "ref string, decision string")
    merged = dedupe.merge_decisions(stored, fresh).withColumn("effective", dedupe.effective_decision(F.col("decision"), F.col("reviewed")))
    assert rows_of(merged, "ref", "decision", "effective") == {"a": ("new", "same"), "b": ("new", "new"), "c": ("exact", "exact")}


def test_parts_fill_what_is_free(spark):
    for seed in range(6):
        rng = random.Random(seed)
        cap, full = rng.randint(1, 4), {n: rng.randint(0, 5) for n in range(1, rng.randint(1, 4))}
        name = lambda n: "B" if n == 1 else f"B - Part {n}"
        counts, expected = collections.Counter({name(n): c for n, c in full.items()}), []
        for _ in range(12):
            n = 1
            while counts[name(n)] >= cap:
                n += 1
            counts[name(n)] += 1
            expected.append(name(n))
        items = spark.createDataFrame([(i, "B") for i in range(12)], "i int, base string")
        existing = spark.createDataFrame([(name(n), c) for n, c in full.items()], "target string, n long")
        got = placing.parts(items, "base", [F.asc("i")], cap, existing).orderBy("i").select("target").collect()
        assert [r[0] for r in got] == expected


def test_names_are_claimed_in_order(spark):
    items = spark.createDataFrame([("A", "1", "x.jpg"), ("A", "2", "X.JPG"), ("A", "3", "x.heic"), ("A", "4", "x (1).jpg"), ("B", "5", "x.jpg"), ("A", "6", "y.jpg")], "target string, place string, name string")
    taken = spark.createDataFrame([("A", "X (2).jpg"), ("A", "z.jpg")], "target string, name string")
    found = {r.place: r.final for r in placing.claim_names(items, taken, {".heic": ".JPG"}).collect()}
    assert found == {"1": "x.jpg", "2": "X (1).JPG", "3": "x (3).heic", "4": "x (1) (1).jpg", "5": "x.jpg", "6": "y.jpg"}


def claimed(items, taken, converts):
    """items: (target, place, name). The rule as a loop over all names of an album."""
    used, out = collections.defaultdict(set), {}
    for target, name in taken:
        used[target].add(name.lower())
    for target, place, name in sorted(items, key=lambda r: r[1]):
        base, ext = os.path.splitext(name)
        landed = lambda n: (os.path.splitext(n)[0] + converts.get(os.path.splitext(n)[1].lower(), os.path.splitext(n)[1])).lower()
        final, k = name, 0
        while {final.lower(), landed(final)} & used[target]:
            k += 1
            final = f"{base} ({k}){ext}"
        used[target] |= {final.lower(), landed(final)}
        out[place] = final
    return out


@pytest.mark.parametrize("seed,key_rows", [(1, 0), (2, 10**6), (3, 0), (4, 10**6)])
def test_claims_equal_a_loop(spark, monkeypatch, seed, key_rows):
    monkeypatch.setattr(scans, "KEY_ROWS", key_rows)
    rng = random.Random(seed)
    converts = [{}, {".heic": ".JPG"}, {".heic": ".JPG", ".dng": ".HEIC", ".png": ".Webp"}, {".a": ".B", ".b": ".a"}][seed - 1]
    base = lambda: rng.choice(["x", "X", "y", "IMG_1", "x (1)", "x (2)", "x (01)", "x (0)", " (1)", ".x", "x.y", "é"]) + rng.choice(["", "", ".jpg", ".HEIC", ".dng", ".png", ".a", ".b", "."])
    sparse = seed % 2
    items = [(rng.choice(["A", "B", None]), i, f"solo{rng.randrange(4)}.jpg" if sparse and rng.random() < 0.7 else base()) for i in range(160)]
    taken = [(rng.choice(["A", "B", None]), rng.choice([base(), f"Solo{rng.randrange(4)} ({rng.choice([1, 2, 3, 7, 40])}).jpg", f"solo{rng.randrange(5)}.JPG"])) for _ in range(40)]
    df = spark.createDataFrame([(*r, "k") for r in items], "target string, place int, name string, _kind string").withColumnRenamed("_kind", "extra").repartition(3)
    found = placing.claim_names(df, spark.createDataFrame(taken, "target string, name string"), converts)
    assert rows_of(found, "place", "final") == {place: (final,) for place, final in claimed(items, taken, converts).items()}


def test_claims_of_one_name_fill_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(scans, "KEY_ROWS", 5_000)
    n = 60_000
    items = spark.range(n).select(F.lit("A").alias("target"), F.col("id").alias("place"), F.lit("P.jpg").alias("name"))
    taken = spark.range(0, n, 3).select(F.lit("A").alias("target"), F.format_string("p (%d).JPG", "id").alias("name"))
    free = (k for k in itertools.count() if k == 0 or k % 3 or k >= n)
    expected = {i: (f"P ({k}).jpg" if k else "P.jpg",) for i, k in zip(range(n), free)}
    assert rows_of(placing.claim_names(items, taken), "place", "final") == expected


SETTINGS = {"photo": "{yyyy}-{mm} {group}", "video": "{yyyy} V", "undated_photo": "Undated", "undated_video": "Undated V", "duplicates_album": "Dups", "duplicates": "park", "soft_cap": 2, "mode": "move"}
ITEM = "item_id string, filename string, is_video boolean, md5 string, uploaded string, capture_local string, method string, `group` string"


def test_organize(spark):
    rows = [("a", "a.jpg", False, "m", "2", None, None, "G"), ("b", "b.jpg", False, "m", "1", None, "none", "G"), ("c", "c.jpg", False, "m", "3", "2024-05-01", "camera", "G"), ("d", "d.mp4", True, None, "1", "2023-01-02", "camera", None), ("e", "e.jpg", False, None, "1", None, None, None), ("f", "f.jpg", False, None, "1", "2024-05-03", "upload", "G"), ("g", "g.jpg", False, None, "1", "2024-05-02", "camera", "G")]
    df = spark.createDataFrame(rows, ITEM)
    found = rows_of(placing.plan_organize(df, SETTINGS), "item_id", "action", "target_name", "kind", "reason", "keeper_item_id")
    assert found["b"] == ("move", "2024-05 G", "photo", "date via camera (from an identical copy), group G", None)
    assert found["a"] == ("park_duplicate", "Dups", "duplicates", "same file as b", "b")
    assert found["d"][1:3] == ("2023 V", "video") and found["e"][1:3] == ("Undated", "photo_undated")
    assert (found["g"][1], found["f"][1]) == ("2024-05 G", "2024-05 G - Part 2")
    existing = spark.createDataFrame([("g", "done", "Old")], "item_id string, status string, target_name string")
    again = rows_of(placing.plan_organize(df, SETTINGS, existing), "item_id", "target_name")
    assert again["g"] == ("Old",) and again["f"] == ("2024-05 G - Part 2",)
    collected = rows_of(placing.plan_organize(df, SETTINGS | {"mode": "collect"}), "item_id", "action", "keeper_item_id")
    assert set(collected.values()) == {("collect", None)}


def test_first_rule_names_the_group(spark):
    df = spark.createDataFrame([("Canon", "x.jpg"), ("Apple", "IMG.HEIC"), (None, None)], "make string, filename string")
    rules = [{"name": "Cam", "make": "CAN*"}, {"name": "Phone", "make": "apple", "filename": "*.heic"}, {"name": "Any", "make": "apple"}]
    got = df.select(placing.group_of(rules, "Other", {"make": F.col("make"), "filename": F.col("filename")})).collect()
    assert [r[0] for r in got] == ["Cam", "Phone", "Other"]


def test_changes(spark):
    log = [("a", "setting", "f", 1, "0", "1", "done"), ("a", "setting", "f", 2, "1", "2", "done"), ("a", "setting", "f", 3, "2", "3", "done"), ("a", "setting", "g", 4, "x", "y", "done"), ("b", "rename", "name", 5, "p", "q", "done"), ("b", "rename", "other", 6, "z", "r", "done")]
    df = spark.createDataFrame(log, "album_id string, kind string, field string, change_id long, old_value string, new_value string, status string")
    assert sorted(r.change_id for r in changes.newest(df).collect()) == [3, 4, 6]
    runs = changes.linked_runs(df, ["album_id", "kind"]).where("linked")
    assert {(r.change_id, r.before) for r in changes.linked_runs(df.where("field = 'f'"), ["album_id"]).collect()} == {(1, "0"), (2, "0"), (3, "0")}
    assert {r.change_id for r in runs.collect()} == {4, 6}


def test_plan_merge_keeps_started_work(spark):
    columns = "item_id string, action string, target_name string, reason string, keeper_item_id string"
    stored = spark.createDataFrame([("a", "move", "T", "r", None, "done"), ("b", "move", "T", "r", None, "failed"), ("c", "move", "T", "r", None, "pending"), ("d", "move", "T", "r", None, "pending")], columns + ", status string")
    fresh = spark.createDataFrame([("a", "move", "U", "n", None), ("b", "move", "T", "n", None), ("c", "move", "U", "n", None), ("e", "move", "U", "n", None)], columns)
    merged = changes.merge_plan(stored, fresh)
    assert rows_of(merged, "item_id", "target_name", "reason", "status", "changed") == {"a": ("T", "r", "done", False), "b": ("T", "n", "failed", False), "c": ("U", "n", "pending", True), "d": ("T", "r", "pending", False), "e": ("U", "n", "pending", True)}
    again = changes.merge_plan(merged.drop("changed"), fresh)
    assert again.where("changed").count() == 0
    targets = spark.createDataFrame([("T", "photo", None, 9), ("Gone", "photo", None, 1), ("Built", "photo", "id", 3)], "name string, kind string, album_id string, planned long")
    kinds = spark.createDataFrame([("U", "video")], "target_name string, kind string")
    assert rows_of(changes.merge_targets(targets, merged, kinds), "name", "kind", "planned") == {"T": ("photo", 3), "U": ("video", 2), "Built": ("photo", 3)}


def test_safety_and_reconciliation(spark):
    plan = spark.createDataFrame([("k", "move", "T", None, "done"), ("p", "park_duplicate", "D", "k", "done"), ("q", "park_duplicate", "D", "x", "done"), ("u", "move", "T", None, "unknown"), ("v", "move", "T", None, "unknown"), ("w", "move", "T", None, "unknown")], "item_id string, action string, target_name string, keeper_item_id string, status string")
    targets = spark.createDataFrame([("T", "1")], "name string, album_id string")
    seen = spark.createDataFrame([("k", "1")], "item_id string, album_id string")
    assert [r.item_id for r in changes.unsafe_deletions(plan, targets, seen).collect()] == ["q"]
    observed = spark.createDataFrame([("u", "T"), ("v", "S")], "item_id string, album string")
    assert rows_of(changes.reconcile(plan, observed), "item_id", "status") == {"u": ("done",), "v": ("pending",), "w": ("failed",)}
    uploads = spark.createDataFrame([(1, "a", None, "needs_review"), (2, "c", "a", "needs_review"), (3, "b", None, "needs_review"), (4, "a", None, "done")], "upload_id int, source_ref string, pair_ref string, status string")
    answers = spark.createDataFrame([("a", "new"), ("b", "review")], "ref string, decision string")
    assert rows_of(changes.release_answered_holds(uploads, answers), "upload_id", "decision") == {1: ("new",), 2: ("new",)}
    collected = spark.createDataFrame([("a", "collect", "T", "done"), ("b", "collect", "T", "done")], "item_id string, action string, target_name string, status string")
    before = spark.createDataFrame([("T", "b")], "target_name string, item_id string")
    assert [r.item_id for r in changes.undo_collected(collected, before).collect()] == ["a"]
    stored = spark.createDataFrame([("a", "old", 1), ("b", "old", 1)], "item_id string, name string, size int")
    fresh = spark.createDataFrame([("a", "new", 2), ("c", "new", 2)], "item_id string, name string, size int")
    assert rows_of(changes.merge_items(stored, fresh, ["name"]), "item_id", "name", "size") == {"a": ("old", 2), "b": ("old", 1), "c": ("new", 2)}


def test_policies_and_drift(spark):
    albums = spark.createDataFrame([("1", "Family", "Kids"), ("2", "", "Kids"), ("3", "Work", "Desk")], "album_id string, folder string, name string")
    rules = [{"scope": ["*"], "downloads": False, "privacy": "unlisted", "download_size": "4k"}, {"scope": ["family/*"], "exclude": ["*/none"], "downloads": True}]
    want = policies.desired(albums, rules)
    assert {(r.album_id, r.setting): (r.desired, r.policy) for r in want.collect()}[("1", "downloads")] == ("true", 2)
    have = [("1", "downloads", "false"), ("1", "privacy", '"public"'), ("1", "effective_privacy", '"private"'), ("2", "downloads", "false"), ("2", "privacy", '"unlisted"'), ("2", "folder_privacy", '"private"'), ("3", "downloads", "true"), ("3", "privacy", '"private"'), ("3", "effective_privacy", '"private"')]
    found = policies.drift(spark.createDataFrame(have, "album_id string, setting string, value string"), want)
    fixes = [(r.album_id, r.setting, r.actual, r.desired) for r in found.where("warning is null").orderBy("album_id", "place").collect()]
    assert fixes == [("1", "downloads", "false", "true"), ("1", "download_size", None, '"4k"'), ("1", "privacy", '"public"', '"unlisted"'), ("3", "downloads", "true", "false"), ("3", "privacy", '"private"', '"unlisted"')]
    warnings = sorted((r.album_id, r.warning) for r in found.where("warning is not null").collect())
    capped = "a containing folder makes it private; the album's own 'unlisted' setting can't take effect"
    unused = "policy 1: download_size applies only with downloads on; not checked"
    assert warnings == [("1", capped), ("2", capped), ("2", unused), ("3", unused)]
    counts = spark.createDataFrame([(0,), (None,), (5,), (8,), (11,)], "n int")
    assert [r[0] for r in counts.select(policies.finding(F.col("n"), 8, 10)).collect()] == ["empty", None, None, "near the item cap (8 of 10)", "over the item cap (11 > 10)"]
    assert policies.unsupported(rules, {"downloads": [], "privacy": []}) == ["download_size"]
    proposals = spark.createDataFrame([("1", "F", "a", "New", True), ("2", "F", "b", "new", True), ("3", "F", "c", "D", True), ("4", "F", "e", "G", False)], "album_id string, folder string, name string, new string, auto boolean")
    known = spark.createDataFrame([("F", "a"), ("F", "d")], "folder string, name string")
    assert rows_of(policies.rename_collisions(proposals, known), "album_id", "status") == {"1": ("planned",), "2": ("review",), "3": ("review",), "4": ("review",)}


def test_every_file_is_counted_once(spark):
    sources = [("z::a.jpg", "photo", None, None), ("z::b.jpg", "photo", None, None), ("z::c.mov", "clip", "z::a.jpg", None), ("z::d.mov", "clip", "z::q.jpg", "unpaired_clips"), ("z::e.webp", "photo", None, "rejected_types"), ("z::f.mp4", "video", None, None), ("z::g", "photo", None, None)]
    uploads = [("z::b.jpg", "still", "done", "Undated"), ("z::f.mp4", "video", "failed", "2024")]
    matches = [("z::a.jpg", "exact"), ("z::g", "source_duplicate")]
    found = accounting.classify(spark.createDataFrame(sources, "ref string, kind string, still_ref string, policy_skip string"), spark.createDataFrame(uploads, "source_ref string, role string, status string, target_name string"), spark.createDataFrame(matches, "ref string, decision string"), ["Undated"])
    assert rows_of(found, "ref", "type", "outcome") == {
        "z::a.jpg": (".jpg", "already there (same file)"),
        "z::b.jpg": (".jpg", "uploaded into an undated album"),
        "z::c.mov": (".mov Live Photo clip", "clip already beside its still"),
        "z::d.mov": (".mov Live Photo clip", "skipped by a policy"),
        "z::e.webp": (".webp", "skipped by a policy"),
        "z::f.mp4": (".mp4 video", "upload failed"),
        "z::g": ("(none)", "duplicate within the source"),
    }
    table = accounting.accounting(found)
    rows = table.collect()
    assert rows[0].type == ".jpg" and rows[-1].type == "all files" and rows[-1].total == 7 and accounting.adds_up(table)


def test_samples_and_medians(spark):
    items = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    pages = accounting.page_sample(items, "k", [F.asc("id")], 5, size=5, seed=3).collect()
    assert collections.Counter(r.k for r in pages) == {0: 25, 1: 25}
    assert accounting.seeded_sample(items, "id", 7, 1).count() == 7
    dates = spark.createDataFrame([("a", datetime.date(2024, 1, d)) for d in (1, 2, 3, 6)] + [("b", datetime.date(2024, 1, 1))], "k string, d date")
    assert rows_of(accounting.median_date(dates, "k", F.col("d"), 3, 10), "k", "n", "spread", "median_date") == {"a": (4, 5, datetime.date(2024, 1, 3)), "b": (1, 0, None)}


def test_sidecars(spark):
    js = '{"title": "%s", "photoTakenTime": {"timestamp": "%s"}}'
    member = lambda name, body=None, folder="F", archive="a": (archive, f"{folder}/{name}", name.lower()[name.rfind(".") :], folder, name, body, "m" + name, 1)
    rows = [
        member("IMG_1.HEIC"), member("IMG_1.HEIC.supplemental-metadata.json", js % ("IMG_1.HEIC", "100")), member("IMG_1.MP4"),
        member("lp.heic"), member("lp.heic.supplemental-metadata.json", js % ("lp.heic", "")), member("lp(1).heic"), member("lp.heic.supplemental-metadata(1).json", js % ("lp.heic", "300")),
        member("a_very_long_name_that_is.jpg"), member("a_very_long_name_th.suppl.json", js % ("a_very_long_name_that_is.jpg", "400")),
        member("Shot.PNG"), member("shot.png.json", js % ("Shot.PNG", "500")), member("Shot.mov"), member("IMG_9.MP4"), member("metadata.json", js % ("x", "1")), member("IMG_2.jpg.supp.json", js % ("IMG_2.jpg", "1")),
        member("IMG_1.MOV", archive="b"),
    ]
    df = spark.createDataFrame(rows, "archive string, path string, ext string, folder string, basename string, json string, md5 string, size long")
    found = {r.basename: r for r in sidecars.items(df).collect()}
    assert {k: (r.taken_ts, r.orphan, r.motion and r.motion.path) for k, r in found.items()} == {
        "IMG_1.HEIC": (100, False, "F/IMG_1.MP4"),
        "lp.heic": (None, False, None),
        "lp(1).heic": (300, False, None),
        "a_very_long_name_that_is.jpg": (400, False, None),
        "Shot.PNG": (None, True, None),
        "Shot.mov": (None, True, None),
        "IMG_9.MP4": (None, True, None),
        "IMG_1.MOV": (None, True, None),
    }


def one_pass(names, askers):
    """names: folder -> set; askers: (asker, folder, name, beginning). The rule as a loop."""
    free, out = {f: set(n) for f, n in names.items()}, set()
    for asker, folder, name, beginning in sorted(askers):
        if name in names.get(folder, ()):
            chosen = [name] if name in free[folder] else []
        else:
            chosen = [n for n in free.get(folder, ()) if beginning and n.startswith(beginning)]
        if len(chosen) == 1:
            free[folder].remove(chosen[0])
            out.add((folder, chosen[0], asker))
    return out


def assigned(spark, names, askers, **more):
    left = spark.createDataFrame([(f, n) for f, ns in names.items() for n in ns], "folder string, name string")
    right = spark.createDataFrame([(f, a, n, b) for a, f, n, b in askers], "folder string, asker int, name string, beginning string")
    return {tuple(r) for r in elimination.assign_names(left, right, **more).select("folder", "name", "asker").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_names_by_beginning_equal_one_pass(spark, seed):
    rng = random.Random(seed)
    names, askers = {}, []
    for f in range(12):
        made = {"".join(rng.choice("ab") for _ in range(rng.choice([2, 4, 6, 7]))) + rng.choice(["", ".é", "\U0001f600"]) for _ in range(rng.choice([3, 8, 25]))}
        names[str(f)] = made
        for _ in range(rng.choice([2, 10, 30])):
            name = rng.choice([*made, "none"])
            askers.append((str(f), rng.choice([name, name[:3] + "!", None]), rng.choice([name, name[: rng.choice([1, 2, 3, 4, 5])], "", None])))
    rng.shuffle(askers)
    askers = [(i, *a) for i, a in enumerate(askers)]
    expected = one_pass(names, askers)
    assert assigned(spark, names, askers) == expected
    assert assigned(spark, names, askers, eliminations=0) == expected


def test_names_left_by_chains_of_others(spark):
    """The last name is left only when all others are gone, each by the one before; and one asker too many."""
    names = {"f": [f"img_{i:04}" for i in range(600)]}
    askers = [(i, "f", f"img_{i:04}", None) for i in range(598)] + [(598, "f", None, "img_05"), (599, "f", "img_0598", None), (600, "f", None, "img"), (601, "f", None, "img_0")]
    found = assigned(spark, names, askers)
    assert found == one_pass(names, askers) and len(found) == 600
    assert assigned(spark, {"f": ["a", "ab", "abc"]}, [(1, "f", None, "a"), (2, "f", None, "abc"), (3, "f", None, "ab"), (4, "f", None, "a")]) == {("f", "abc", 2), ("f", "ab", 3), ("f", "a", 4)}
    assert assigned(spark, {}, [(1, "f", "a", "a")]) == set() == assigned(spark, {"f": ["a"]}, [])


def test_first_free_places():
    rng = random.Random(2)
    for n in (1, 2, 7, 64, 100):
        places, free = elimination.FreePlaces(n), set(range(n))
        for place in rng.sample(range(n), n):
            places.take(place)
            free.remove(place)
            for at in range(n):
                assert places.before(at) == sum(f < at for f in free)
                if later := [f for f in free if f >= at]:
                    assert places.first_from(at) == min(later)


@pytest.mark.parametrize("key_rows", [0, None])
def test_scans_equal_loops(spark, monkeypatch, key_rows):
    """With ranges for every key and with windows alike: a key with most rows, a null key, a single row."""
    monkeypatch.setattr(scans, "KEY_ROWS", 0 if key_rows == 0 else 10**6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins ranges of a few kilobytes
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None, f"k{rng.randrange(30)}"]), i, rng.choice("xxy"), rng.choice([True, False, False])) for i in range(1500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, same string, failed boolean").repartition(5)
    scan = scans.Scan(df, ["k"], [F.desc("i")])
    if key_rows == 0:
        assert scan.rows.where("k = 'hot'").select("_range").distinct().count() > 1
    expected, place, last = {}, collections.Counter(), {}
    islands, in_island, ends = collections.Counter(), collections.Counter(), {}
    for k, i, same, failed in sorted(rows, key=lambda r: -r[1]):
        place[k] += i
        expected[i] = (place[k], last.get(k), k not in last)
        last[k] = same
    out = scan.running("total", F.col("i")).lagged(prior=F.col("same")).done()
    assert rows_of(out, "i", "total", "prior", "at_first") == expected
    cut = {}
    for k, i, same, failed in sorted(rows, key=lambda r: r[1]):
        islands[k] += ends.get(k) != same
        ends[k] = same
        cut[i] = (islands[k], in_island[k, islands[k]] // 2)
        in_island[k, islands[k]] += 1
    assert rows_of(changes.batches(df, ["k"], [F.asc("i")], ["same"], 2), "i", "island", "batch") == cut
    runs, step, at = collections.Counter(), collections.Counter(), {}
    for k, i, same, failed in sorted(rows, key=lambda r: r[1]):
        step[k] += 1
        at[k] = (at.get(k) or step[k]) if failed else None
        if failed:
            runs[k, at[k]] += 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = workflows.failure_runs(df, [F.asc("i")], ["k"], 2).collect()
    assert {(r.k, r["first"]): r["n"] for r in found} == {x: n for x, n in runs.items() if n >= 2}
    assert rows_of(placing.ranked(df, "k", [F.asc("i")], "r"), "i", "r") == {i: (sum(1 for r in rows if r[0] == k and r[1] < i),) for k, i, _, _ in rows}


@pytest.mark.parametrize("key_rows", [0, 10**6])
def test_linked_runs_of_a_long_history(spark, monkeypatch, key_rows):
    monkeypatch.setattr(scans, "KEY_ROWS", key_rows)
    rows = [("a", i, str(i), str(i + 1)) for i in range(400)] + [("b", i, str(i), str(i + 1 + (i == 150))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, change_id int, old_value string, new_value string").repartition(4)
    found = changes.linked_runs(df, ["k"]).collect()
    assert {(r.k, r.change_id) for r in found if r.linked} == {("a", i) for i in range(400)} | {("b", i) for i in range(151, 300)}
    assert {(r.k, r.before) for r in found} == {("a", "0"), ("b", "151")}


def test_many_policies_by_an_index(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("aBc[") for _ in range(n)).replace("[", rng.choice("d[."))
    glob = lambda: rng.choice([word(2) + "*", "*" + word(2), word(1) + "?" + word(1), "*" + word(1) + "*", "[ab]*" + word(1), "*", word(3), "a*[!b]", "", word(1) + "/*"])
    wanted = [{"scope": [glob() for _ in range(rng.choice([1, 2]))], **({"exclude": [glob()]} if rng.random() < 0.4 else {}), rng.choice("xyz"): n} for n in range(60)]
    albums = spark.createDataFrame([(i, rng.choice([word(1), None, ""]), rng.choice([word(3), None])) for i in range(80)], "album_id int, folder string, name string")
    both = [{tuple(r) for r in policies.desired(albums, wanted, few).select("album_id", "setting", "desired", "policy").collect()} for few in (1000, 0)]
    assert both[0] == both[1] and len(both[0]) > 100


@pytest.mark.parametrize("bound,join", [(policies.BROADCAST_ROWS, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_albums_are_never_broadcast_to_policies(spark, monkeypatch, bound, join):
    monkeypatch.setattr(policies, "BROADCAST_ROWS", bound)
    wanted = [{"scope": [f"album {n} *"], "privacy": n} for n in range(50)]
    albums = spark.range(100).select(F.col("id").alias("album_id"), F.lit("f").alias("folder"), F.format_string("Album %d x", "id").alias("name"))
    found = policies.desired(albums, wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{join} [") == 2 and "BuildLeft" not in plan
    assert {tuple(r) for r in found.collect()} == {(n, "privacy", str(n), n + 1) for n in range(50)}


def test_five_thousand_policies(spark):
    wanted = [{"scope": [f"album {n} *"], "privacy": "private", "downloads": n % 2 == 0} for n in range(5_000)]
    albums = spark.range(20_000).select(F.col("id").alias("album_id"), F.lit("f").alias("folder"), F.format_string("Album %d x", F.col("id") % 10_000).alias("name"))
    found = policies.desired(albums, wanted)
    assert found.agg(F.count("*"), F.min(F.col("policy") - F.col("album_id") % 10_000), F.max(F.col("policy") - F.col("album_id") % 10_000)).first() == (20_000, 1, 1)


def test_date_plugins(spark):
    added = plugins.DatePlugins(spark)
    for name, body in (("camera", "filename"), ("upper", "filename"), ("Bad Name", "filename"), ("number", "1"), ("broken", "nothing_here"), ("cut_off", "substring("), ("filename", "filename")):
        with pytest.raises(plugins.PluginError):
            added.register(name, body)
    added.register_all({"day_of_scan": "try_to_date(filename, 'yyyyMMdd')", "wrong": "no_column"})
    assert set(added.refused) == {"wrong"} and set(added.sources()) == {"day_of_scan"}
    added.register("day_of_scan", "coalesce(try_to_date(filename, 'yyyyMMdd'), try_to_date(album_name, 'yyyyMMdd'))")
    df = spark.createDataFrame([("20240102", None), ("x", "20230405"), ("y", None)], "f string, a string")
    value = naming.date_for(["day_of_scan"], {"filename": F.col("f"), "album_name": F.col("a")}, "UTC", datetime.date(2026, 1, 1), added.sources())
    assert [tuple(r) for r in df.select(value["value"], value["method"]).collect()] == [("2024-01-02", "day_of_scan"), ("2023-04-05", "day_of_scan"), (None, "none")]
    assert spark.sql("SELECT day_of_scan('20240102', NULL, NULL, NULL)").first()[0] == "2024-01-02"


def pixels(data: bytes):
    """The two renderings of a made picture: its bytes are the gray values themselves."""
    if len(data) != 144:
        raise ValueError("not a picture")
    return list(data[:72]), list(data[72:])


def turned_hashes(wide, tall):
    """By turning matrices: numpy turns left, as the library does."""
    wide, tall = np.array(wide).reshape(8, 9), np.array(tall).reshape(9, 8)
    grids = [wide, np.rot90(tall), np.rot90(wide, 2), np.rot90(tall, 3)]
    whole = [int("".join("1" if a > b else "0" for row in g for a, b in zip(row, row[1:])), 2) for g in grids]
    return [h - (h >> 63 << 64) for h in whole]


def test_rotations_equal_turned_matrices(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 4, 72).tolist(), rng.integers(0, 256, 72).tolist()) for i in range(30)]
    found = spark.createDataFrame(rows, "i int, w array<int>, t array<int>").select("i", shapes.rotation_hashes(F.col("w"), F.col("t")).alias("h"))
    assert rows_of(found, "i", "h") == {i: (turned_hashes(w, t),) for i, w, t in rows}


def test_hashes_are_made_once(spark, tmp_path):
    rng = np.random.default_rng(4)
    files = {f"p{i}": rng.integers(0, 256, 144).astype(np.uint8).tobytes() for i in range(12)} | {"bad": b"xx", "none": None}
    asked, folder = [], str(tmp_path / "hashes")

    def read(missing):
        asked.append(sorted(r.key for r in missing.collect()))
        return spark.createDataFrame([(k, files[k]) for k in asked[-1]], "key string, content binary")

    wanted = lambda names: spark.createDataFrame([(n,) for n in names], "key string")
    first = ["p1", "p2", "p2", "bad", None]
    found = rows_of(pictures.hashes_aside(wanted(first), folder, read, pixels), "key", "hashes", "error")
    assert found == {k: (turned_hashes(files[k][:72] and list(files[k][:72]), list(files[k][72:])), None) for k in ("p1", "p2")} | {"bad": (None, "ValueError: not a picture")}
    again = pictures.hashes_aside(wanted(first), folder, read, pixels)
    assert rows_of(again, "key", "hashes", "error") == found and asked == [["bad", "p1", "p2"]]
    assert len(rows_of(pictures.hashes_aside(wanted([*files]), folder, read, pixels), "key", "error")) == 14
    assert asked[1] == sorted(set(files) - {"p1", "p2", "bad"}) and pictures.cached_hashes(spark, folder).count() == 14


def test_items_with_orphans(spark):
    df = spark.createDataFrame([("a", ".jpg", False), ("b", ".mp4", True), ("c", ".mov", False)], "path string, ext string, orphan boolean")
    assert rows_of(sidecars.source_items(df), "path", "kind") == {"a": ("photo",), "c": ("video",)}
    assert rows_of(sidecars.source_items(df, True), "path", "kind") == {"a": ("photo",), "b": ("video",), "c": ("video",)}


IMPORT_ITEM = "ref string, name string, kind string, taken_ts long, own_time string, width int, height int, duration_s double, orphan boolean, motion struct<ref: string, name: string, own_time: string, width: int, height: int, duration_s: double>"


def test_import_plan(spark):
    t = 1704067200
    clip = lambda ref, name, at: (ref, name, at, 1440, 1080, 2.0)
    items = [
        ("s1", "IMG_1.HEIC", "photo", t, None, 4032, 3024, None, False, clip("m1", "IMG_1.MP4", "2024-01-01T00:00:01+00:00")),
        ("s2", "IMG_1.HEIC", "photo", t + 50, None, 4032, 3024, None, False, None),
        ("s3", "P.jpg", "photo", t + 60, None, 10, 10, None, False, None),
        ("s4", "N.webp", "photo", None, None, 10, 10, None, False, None),
        ("s5", "D.jpg", "photo", t, None, 10, 10, None, False, None),
        ("s6", "E.jpg", "photo", t + 5000, None, 3000, 2000, None, False, clip("m6", "E.mov", "2024-01-01T01:23:20+00:00")),
        ("v1", "V.mp4", "video", t, None, 1, 1, 60.0, False, None),
        ("o1", "lost.mov", "video", None, "2024-01-01T00:00:49+00:00", 1440, 1080, 3.0, True, None),
        ("o2", "alone.mov", "video", None, None, None, None, 1.0, True, None),
    ]
    decisions = [("s3", "exact", "d1"), ("s5", "source_duplicate", None), ("s6", "review", None)]
    destination = [("d1", "2024-01", "al", "P.JPG"), ("d2", "2024-01", "al", "img_1.jpg")]
    settings = ImportSettings({"photo": "{yyyy}-{mm}", "video": "{yyyy}-{mm} V", "undated_photo": "U", "undated_video": "UV"}, soft_cap=4, rejected=[".webp"], rejected_types="skip", unpaired_clips="undated")
    rows, notes = plan_import(spark.createDataFrame(items, IMPORT_ITEM), spark.createDataFrame(decisions, "ref string, decision string, dest_item_id string"), spark.createDataFrame(destination, "item_id string, album string, album_id string, name string"), spark.createDataFrame([], "source_ref string, role string, target_name string, upload_name string"), settings)
    found = rows_of(rows, "source_ref", "role", "target_name", "upload_name", "status", "pair_ref")
    assert found == {
        "s1": ("still", "2024-01", "IMG_1 (1).JPG", "planned", None),
        "s2": ("still", "2024-01", "IMG_1 (2).JPG", "planned", None),
        "s6": ("still", "2024-01 - Part 2", "E.jpg", "needs_review", None),
        "v1": ("video", "2024-01 V", "V.mp4", "planned", None),
        "m1": ("clip", "2024-01", "IMG_1 (1).MP4", "planned", "s1"),
        "o1": ("clip", "2024-01", "IMG_1 (2).MOV", "planned", "s2"),
        "m6": ("clip", "UV", "E.mov", "planned", None),
        "o2": ("clip", "UV", "alone.mov", "planned", None),
    }
    assert rows_of(notes, "note", "n") == {"same file appears twice in the source": (1,), "already on the destination (exact)": (1,), ".webp is rejected by the destination (rejected_types = skip)": (1,)}
    previous = rows.select("source_ref", "role", "target_name", "upload_name")
    again, _ = plan_import(spark.createDataFrame(items, IMPORT_ITEM), spark.createDataFrame(decisions, "ref string, decision string, dest_item_id string"), spark.createDataFrame(destination, "item_id string, album string, album_id string, name string"), previous, settings)
    assert again.count() == 0


def test_takeout_plan_as_one_step(spark):
    t = 1704067200
    items = [
        ("s1", "P.HEIC", "photo", t, None, 4032, 3024, None, False, ("m1", "P.MP4", "2024-01-01T00:00:01+00:00", 1440, 1080, 2.0)),
        ("s2", "Q.jpg", "photo", t, None, 10, 10, None, False, None),
        ("v1", "V.mp4", "video", t, None, 1, 1, 60.0, False, None),
    ]
    settings = ImportSettings({"photo": "{yyyy}-{mm}", "video": "{yyyy}-{mm} V", "undated_photo": "U", "undated_video": "UV"}, soft_cap=10)
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    decisions = frame([("s1", "exact", "d1"), ("s2", "new", None), ("v1", "new", None)], "ref string, decision string, dest_item_id string")
    destination = frame([("d1", "Old", "al", "P.JPG")], "item_id string, album string, album_id string, name string")
    uploads = frame([(1, "s2", "still", "needs_review", None, "2024-01", "Q.jpg"), (2, "x", "still", "done", None, "2024-01", "Z.jpg")], "upload_id int, source_ref string, role string, status string, pair_ref string, target_name string, upload_name string")
    albums = frame([("2024-01 V", "a7"), ("2024-01 V", "a9")], "name string, album_id string")
    plan = lambda targets, decided=decisions: steps.takeout_plan(frame(items, IMPORT_ITEM), decided, destination, uploads, frame(targets, "name string, album_id string"), albums, settings)
    with pytest.raises(steps.Refused, match="1 items"):
        plan([], decisions.where("ref <> 'v1'"))
    made = plan([("2024-01", None)])
    assert [r.upload_id for r in made["released"].collect()] == [1]
    assert rows_of(made["uploads"], "source_ref", "target_name", "status", "album_id") == {"s2": ("2024-01", "planned", None), "v1": ("2024-01 V", "planned", None), "m1": ("Old", "planned", "al")}
    assert rows_of(made["targets"], "name", "kind", "album_id", "planned") == {"2024-01 V": ("video", "a7", 0), "Old": ("video", "al", 0)}
    held = plan([("Old", "another"), ("2024-01", None)])
    assert rows_of(held["uploads"], "source_ref", "status")["m1"] == ("held",) and "Old" not in rows_of(held["targets"], "name", "kind")


def test_audit_refuses_what_it_must(spark):
    albums = spark.createDataFrame([(1, "f", "n", 3)], "album_id int, folder string, name string, item_count long")
    actual = spark.createDataFrame([], "album_id int, setting string, value string")
    with pytest.raises(steps.Refused, match="no policies"):
        steps.albums_audit(albums, actual, [], {}, 1, 2)
    with pytest.raises(steps.Refused, match="colour"):
        steps.albums_audit(albums, actual, [{"scope": ["*"], "colour": "red"}], {"privacy": ["public"]}, 1, 2)


def test_ten_thousand_items_of_one_name(spark):
    """Fifty pictures on either side: 2,500 distances, and the pass by rank."""
    rng = np.random.default_rng(1)
    pictures = [int(x) - 2**63 for x in rng.integers(0, 2**63, 50, dtype=np.uint64) * 2]
    n = 10_000
    known = F.array(*[F.lit(x) for x in pictures])
    side = lambda name, seed: spark.range(n).select(F.lit("k").alias("key"), F.format_string(f"{name}%05d", "id").alias(name), F.get(known, F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(50)).cast("int")).alias("hash"))
    left, right = side("ref", 1).select("key", "ref", F.array("hash").alias("hashes")), side("item_id", 2)
    found = classes.match_pictures(left, right, 6).cache()
    assert found.count() == n
    ranked = lambda df, id_, value: df.select(id_, value.alias("h"), F.row_number().over(Window.partitionBy(value).orderBy(id_)).alias("r"))
    expected = ranked(left, "ref", F.col("hashes")[0]).join(ranked(right, "item_id", F.col("hash")), ["h", "r"])
    taken = found.where("item_id is not null")
    assert taken.where("dist <> 0").isEmpty() and taken.select("ref", "item_id").exceptAll(expected.select("ref", "item_id")).isEmpty() and taken.count() == expected.count()


@pytest.mark.parametrize("seed", range(3))
def test_classes_equal_pairs(spark, seed):
    """Pictures and videos by classes against the greedy pass over a table of pairs."""
    rng = random.Random(seed)
    hashes = [rng.choice([0, 1, 3, 7, 255, 2**40, -1, -2**63, 2**62 + 5]) for _ in range(9)]
    left = [(rng.choice("kl"), f"r{i:02}", rng.choice([[rng.choice(hashes), rng.choice(hashes)], [rng.choice(hashes)], [rng.choice(hashes), None], None])) for i in range(40)]
    right = [(rng.choice("kl"), f"i{i:02}", rng.choice([*hashes, None])) for i in range(30)]
    a, b = spark.createDataFrame(left, "key string, ref string, hashes array<long>"), spark.createDataFrame(right, "key string, item_id string, hash long")
    met = a.join(b, "key").select("ref", "item_id", shapes.rotation_distance(F.col("hashes"), F.col("hash")).alias("dist")).collect()
    taken = {a: (b, d) for d, a, b in greedy([(r.dist, r.ref, r.item_id) for r in met if r.dist is not None and r.dist <= 6])}
    gone, expected = {b for b, _ in taken.values()}, {}
    for ref in {r.ref for r in met}:
        own = [r for r in met if r.ref == ref]
        near = min(((r.dist, r.item_id) for r in own if r.dist is not None and r.item_id not in gone), default=(None, None))
        item, dist = taken.get(ref, (None, None))
        expected[ref] = (item, dist, *((None, None) if item else near), any(r.dist is None for r in own), any(r.dist is not None for r in own))
    found = classes.match_pictures(a, b, 6)
    assert rows_of(found, "ref", "item_id", "dist", "near_dist", "near_item", "unreadable", "scored") == expected

    shape = lambda: (rng.choice([10.0, 10.2, 10.4, 11.0, 60.0, 0.0, None]), rng.choice([1920, 1080, None]), rng.choice([1080, 1920, 1440, 0]))
    left, right = [("k", f"r{i:02}", *shape()) for i in range(30)], [("k", f"i{i:02}", *shape()) for i in range(25)]
    ddl = "key string, {} string, duration_s double, width int, height int"
    a, b = spark.createDataFrame(left, ddl.format("ref")), spark.createDataFrame(right, ddl.format("item_id"))
    side = lambda p: {"duration": F.col(f"{p}.duration_s"), "width": F.col(f"{p}.width"), "height": F.col(f"{p}.height")}
    met = a.alias("a").join(b.alias("b"), "key").select("ref", "item_id", shapes.video_gap(side("a"), side("b"))["gap"].alias("gap")).where("gap is not null").collect()
    expected = {a: (b, d) for d, a, b in greedy([(r.gap, r.ref, r.item_id) for r in met])}
    assert rows_of(classes.match_videos(a, b, 0.02), "ref", "item_id", "gap") == expected
