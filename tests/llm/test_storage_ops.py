import collections
import gzip
import hashlib
import json
import os
import random
import zlib

import numpy as np

from lakecurator.llm.shards import SLOTS, SlotMap, newest, shard_rows
from lakecurator.llm.storage import NO_KEY, key_ranges
from lakecurator.llm.warc import read_archives, write_archives
from pyspark.sql import functions as F

from .corpora import corpus, frame, odd

PAGES = "page_id long, url string, html string, digest string"


def pages():
    big, other = "<p>é" + "x" * 200, "<b>" + "y" * 300
    html = [big, other, None, "", "tiny", "tiny", big, big, "z" * 99, "z" * 99, "w" * 100, "w" * 100, other, "a\r\n\r\nb" * 40, "plain"]
    return [(i, None if i % 5 == 4 else f"http://h.example/{i}?q=a b\r\nx", h, "clash") for i, h in enumerate(html)]


def expected(rows):
    first = {}
    for i, _, h, _ in rows:
        if h and len(h.encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = {}
    for i, _, h, _ in rows:
        raw, to = (h or "").encode(), first.get(h, i)
        out[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "response" if to == i else "revisit", None if to == i else to)
    return out


def test_warc_round_trip(spark):
    rows = pages()
    folder = write_archives(frame(spark, rows, PAGES), range_bytes=1500, roll_bytes=700)
    found = read_archives(spark, folder).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == expected(rows)
    assert {r.page_id: bytes(r.payload) for r in found if r.record_type == "response"} == {i: (h or "").encode() for i, _, h, _ in rows if expected(rows)[i][2] == "response"}
    local = folder.removeprefix("file:")
    manifest = json.load(open(f"{local}/manifest.json"))
    assert len(manifest["files"]) > 3 and max(x["part"] for x in manifest["files"]) > 0
    for entry in manifest["files"]:
        raw = open(f"{local}/{entry['file']}", "rb").read()
        assert len(raw) == entry["bytes"] and hashlib.sha256(raw).hexdigest() == entry["sha256"]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert not [x for x in os.listdir(local) if x.startswith(".") and not x.endswith(".crc")]
    again = write_archives(frame(spark, rows, PAGES, 5), range_bytes=1500, roll_bytes=700).removeprefix("file:")
    assert sorted(os.listdir(again)) == sorted(os.listdir(local))
    assert all(open(f"{again}/{x}", "rb").read() == open(f"{local}/{x}", "rb").read() for x in os.listdir(local))


def test_warc_of_odd_tables(spark):
    text = "q" * 150
    rows = [(None, None, text, None), (3, None, text, None), (3, None, text, None), (5, "u", text, None), (None, None, None, None)]
    found = read_archives(spark, write_archives(frame(spark, rows, PAGES))).collect()
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in found)
    assert kinds == {(None, "revisit", 3): 1, (None, "response", None): 1, (3, "response", None): 2, (5, "revisit", 3): 1}
    assert read_archives(spark, write_archives(frame(spark, [], PAGES))).count() == 0


def test_key_ranges(spark):
    df = spark.range(0, 1000).select((F.col("id") * F.col("id")).alias("k"), F.lit(10).alias("w"))
    found = key_ranges(df, "k", "w", 1000)
    sizes = collections.Counter(found.of(np.array([r.k for r in df.collect()]), np.zeros(1000, np.uint32)).tolist())
    assert sum(sizes.values()) == 1000 and max(sizes.values()) <= 200 and set(sizes) == set(range(len(found)))
    assert len(key_ranges(df.limit(0), "k", "w", 5)) == 1
    far = spark.createDataFrame([(-(2**62) * 2 + 1, 5), (2**63 - 1, 5), (0, 5), (1, 5), (2, 5)], "k long, w long")
    assert 4 <= len(key_ranges(far, "k", "w", 5)) <= 5
    assert len(key_ranges(df, "k", "w", 10, ranges=7)) <= 14


def test_hot_and_null_keys_are_split(spark):
    rows = [(i, 10) for i in range(100)] + [(25, 10)] * 500 + [(None, 10)] * 300
    found = key_ranges(spark.createDataFrame(rows, "k long, w long"), "k", "w", 200)
    keys = np.array([NO_KEY if k is None else k for k, _ in rows])
    ties = np.random.default_rng(1).integers(0, 1 << 32, len(keys), dtype=np.uint32)
    at = found.of(keys, ties)
    assert len(found) > 800 * 10 // 400 and max(collections.Counter(at.tolist()).values()) < 60
    order = np.lexsort((ties, keys))
    assert (np.diff(at[order]) >= 0).all() and at.max() == len(found) - 1


def test_archives_roll_by_compressed_size(spark):
    rng = random.Random(4)
    rows = [(i, f"u{i}", "".join(rng.choice("abcdefghij <>") for _ in range(3000)), None) for i in range(200)]
    folder = write_archives(frame(spark, rows, PAGES), range_bytes=200_000)
    files = [x for x in json.load(open(f"{folder}/manifest.json"))["files"]]
    assert max(x["part"] for x in files) > 0 and max(x["bytes"] for x in files) < 200_000 // 8 + 8000
    assert sorted(r.page_id for r in read_archives(spark, folder).collect()) == list(range(200))


def test_shards(spark):
    rows = corpus(3, 300)
    found = shard_rows(frame(spark, rows), shards=4).toPandas()
    assert len(found) == len(rows) and set(found.law) == {"bytes"} and found.grown_shard.isna().all()
    text = {i: (t or "").encode() for i, t, *_ in rows}
    assert all(size == len(text[i]) + 1 and crc == zlib.crc32(text[i]) for i, size, crc in zip(found.doc_id, found["size"], found.text_crc32))
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    loads = found.groupby("shard")["size"].sum()
    assert found.shard.nunique() == 4 and loads.max() <= max(found.groupby("virtual_slot")["size"].sum().max(), 1.05 * loads.mean())
    together = found[found.text_crc32.map(found.groupby("text_crc32")["size"].sum()) <= found["size"].sum() / 4]
    assert (together.groupby("text_crc32").shard.nunique() == 1).all()
    assert shard_rows(frame(spark, [])).count() == 0
    strange = shard_rows(odd(spark), shards=2).collect()
    assert len(strange) == 7 and {r.shard for r in strange} <= {0, 1}
    for shard in (0, 1):
        assert sorted(r.slot for r in strange if r.shard == shard) == list(range(sum(r.shard == shard for r in strange)))


def test_shards_are_near_equal_and_a_hot_group_is_spread(spark, tmp_path):
    rows = [(i, f"text {i} " * 20, "en", "s", 1) for i in range(6000)] + [(10_000 + i, "the same " * 20, "en", "s", 1) for i in range(3000)]
    folder = str(tmp_path / "maps")
    found = shard_rows(frame(spark, rows), shards=16, folder=folder).toPandas()
    loads = found.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= found["size"].max() and found[found.doc_id >= 10_000].shard.nunique() == 16
    kept = newest(folder)
    assert kept.version == 2 and kept.shards == 16
    again = shard_rows(frame(spark, rows), shards=17, folder=folder).toPandas()
    was, now = (dict(zip(x.doc_id, x.shard)) for x in (found, again))
    assert newest(folder).version == 3 and {now[i] for i in was if now[i] != was[i]} == {16}


def test_equal_texts_stay_together_up_to_a_share(spark):
    """A group of a twentieth of all bytes is in one shard; a third of the rows is null, and one row is repeated often."""
    rows = [(i, f"text {i} " * 20, "en", "s", 1) for i in range(4000)] + [(10_000 + i, "the same " * 20, "en", "s", 1) for i in range(220)]
    rows += [(20_000 + i if i % 3 else None, None, None, None, None) for i in range(2000)] + [(7, "again", "en", "s", 1)] * 500
    found = shard_rows(frame(spark, rows), shards=16).toPandas()
    loads = found.groupby("shard")["size"].sum()
    assert (found.groupby("text_crc32").shard.nunique() == 1).all() and loads.max() - loads.min() < 0.01 * loads.mean()
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_rows_of_one_slot_fill_many_tasks(spark):
    from lakecurator.llm.common import cut
    from lakecurator.operators.scans import Scan

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    same = cut(spark.range(4000).select(F.lit(1).alias("slot"), F.lit(None).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row")))
    scan = Scan(same, ["slot"], [F.asc("doc_id"), F.asc("row")], key_rows=0)
    sizes = [r["count"] for r in scan.rows.groupBy("_range").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and max(sizes) < 2000


def test_rebalancing_narrows_the_shards_and_moves_little():
    sizes = {i: 1000 + (i * 7919) % 900 for i in range(SLOTS)}
    one = SlotMap.first(16)
    two = one.rebalanced(sizes)
    loads = two.loads(sizes)
    assert two.version == 2 and max(loads) - min(loads) < 50
    grown = two.rebalanced(sizes, 17)
    loads = grown.loads(sizes)
    assert grown.version == 3 and max(loads) - min(loads) < 2000
    moved = [i for i in range(SLOTS) if two.assignment[i] != grown.assignment[i]]
    assert len(moved) < SLOTS / 10 and all(grown.assignment[i] == 16 for i in moved)
    hot = sizes | {5: 10**9}
    assert SlotMap.first(4).rebalanced(hot).assignment[5] in range(4)
