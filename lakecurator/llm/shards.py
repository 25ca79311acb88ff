"""Sharding over fixed virtual slots and a versioned slot-to-shard map.

Rows hash into a fixed number of slots, by their text, so that equal texts stay
together. Bytes are summed by slot, so placing and moving data is a matter of a
few thousand numbers, whatever the table's size. A map assigns slots to shards;
rebalancing edits a map into the next version, moving few slots. Every version
is stored, and the newest stored one is where the next run begins.
"""

from __future__ import annotations

import bisect
import json
from dataclasses import asdict, dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, ranks
from .storage import new_folder, opened, write_json

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """version, number of shards and each slot's shard."""

    version: int
    shards: int
    assignment: tuple[int, ...]

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, tuple(i % shards for i in range(slots)))

    def loads(self, sizes: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, size in sizes.items():
            out[self.assignment[slot]] += size
        return out

    def rebalanced(self, sizes: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version: slots first move from the fullest shard to the emptiest while that narrows the two.

        Shards may be added; then the new ones start empty and slots move only into them.
        """
        count = max(self.shards, shards or 0)
        place, loads = list(self.assignment), SlotMap(0, count, self.assignment).loads(sizes)
        held: list[set[int]] = [set() for _ in range(count)]
        for slot, size in sizes.items():
            if size:
                held[place[slot]].add(slot)
        targets = range(self.shards, count) if count > self.shards else range(count)
        for _ in range(8 * len(place)):
            full, empty = max(range(count), key=lambda s: (loads[s], s)), min(targets, key=lambda s: (loads[s], s))
            gap = loads[full] - loads[empty]
            movable = [s for s in held[full] if sizes[s] < gap]
            if not movable:
                break
            slot = min(movable, key=lambda s: (abs(gap - 2 * sizes[s]), s))
            held[full].remove(slot)
            held[empty].add(slot)
            place[slot] = empty
            loads[full] -= sizes[slot]
            loads[empty] += sizes[slot]
        for _ in range(64 * count if count == self.shards else 0):  # then single slots are exchanged, which narrows by less than a slot
            full, empty = (f(range(count), key=lambda s: (loads[s], s)) for f in (max, min))
            gap, other = loads[full] - loads[empty], sorted((sizes[s], s) for s in held[empty])
            best = (gap, -1, -1)
            for slot in sorted(held[full]):
                at = bisect.bisect(other, (sizes[slot] - gap / 2,))
                for size, back in other[max(0, at - 1) : at + 1]:
                    best = min(best, (abs(gap - 2 * (sizes[slot] - size)), slot, back))
            if best[1] < 0:
                break
            for slot, source, target in ((best[1], full, empty), (best[2], empty, full)):
                held[source].remove(slot)
                held[target].add(slot)
                place[slot] = target
                loads[source] -= sizes[slot]
                loads[target] += sizes[slot]
        return SlotMap(self.version + 1, count, tuple(place))


def store(folder: str, slots: SlotMap) -> None:
    write_json(f"{folder}/slot_map_v{slots.version:06d}.json", asdict(slots))


def newest(folder: str) -> SlotMap | None:
    """The stored map with the highest version."""
    system, path = opened(folder)
    found = sorted(x.path for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if "/slot_map_v" in x.path and x.path.endswith(".json"))
    if not found:
        return None
    with system.open_input_stream(found[-1]) as source:
        value = json.loads(source.read())
    return SlotMap(value["version"], value["shards"], tuple(value["assignment"]))


def with_slots(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and row (a number that tells rows apart) of each row.

    The slot is hashed from the text. A group of equal texts that weighs more
    than a shard's share can't be kept together under equal sizes, so its slot
    is hashed from the text and doc_id; fewer than `shards` groups are so large.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"), F.monotonically_increasing_id().alias("row")))
    total = sized.agg(F.sum("size")).first()[0] or 0
    hot = sized.groupBy("group").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * shards > total).select("group", F.lit(True).alias("hot"))
    known = sized.join(F.broadcast(hot), "group", "left")
    drawn = F.when(F.col("hot"), F.xxhash64("group", "doc_id")).otherwise(F.xxhash64("group"))
    return known.select("doc_id", "size", "text_crc32", F.pmod(drawn, F.lit(slots)).cast("int").alias("virtual_slot"), "row")


def shard_rows(docs: DataFrame, shards: int = 16, current: SlotMap | None = None, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot and map_version for each row of docs.

    The law is `bytes`: the shards' sizes are near equal, to about one virtual
    slot. size is the text's UTF-8 bytes plus 1, null counting as empty. slot
    is the row's place in its shard, gapless from 0, by virtual slot and then
    doc_id. Equal texts share a shard, but for groups heavier than a shard's
    share of all bytes, which no law of equal sizes could keep together. A slot
    that many rows share, as the null and empty texts do, is numbered in ranges,
    and rows that repeat wholly fill several of them. Null and repeated doc_ids are rows like any
    other, very long texts too, other columns are ignored, and an empty table
    gives an empty result. A folder that holds maps continues from its newest
    one, or from `current`; maps of this run are stored in it.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = cut(with_slots(docs, shards))
    if current is None and folder:
        current = newest(folder)
    totals = rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row for each slot at most
    start = current or SlotMap.first(shards)
    slots = start.rebalanced({r.virtual_slot: r["size"] for r in totals}, shards)
    folder = folder or new_folder(spark, "slot-maps")
    if current is None:
        store(folder, start)
    store(folder, slots)
    base, table = [0] * slots.shards, []
    for slot, n in sorted((r.virtual_slot, r.n) for r in totals):
        shard = slots.assignment[slot]
        table.append((slot, shard, base[shard]))
        base[shard] += n
    placed = spark.createDataFrame(table, "virtual_slot int, shard int, base long")
    numbered = ranks(rows, "virtual_slot", ["doc_id", "text_crc32", "row"])
    return numbered.join(F.broadcast(placed), "virtual_slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slots.version).alias("map_version"))
