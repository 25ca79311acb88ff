"""One-to-one matching of things with equal names, class by class instead of pair by pair.

Rows of a name that are equal in what is compared (a picture's hashes, a video's
shape) are a class. Distances are worked out for classes, so ten thousand
copies of fifty pictures on either side cost 2,500 of them. Since members of a
class differ in their ids alone, and the pass takes the least ids first, what is
left of a class is always its tail: members are dealt by rank.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Source classes that are compared with all of the other side at once.
_BLOCK = 256


def deal(left: list[list], right: list[list], pairs: list[tuple]) -> tuple[list[tuple], list[int], list[int]]:
    """(distance, a, i, b, j) of the members taken, and how many of each class are.

    left and right: sorted ids of each class. pairs: (distance, a, b). Equals
    the pass over all pairs of members in the order of distance, left and right
    id that takes a pair when both are free.
    """
    used_a, used_b, out = [0] * len(left), [0] * len(right), []
    for distance, level in groupby(sorted(pairs), key=lambda p: p[0]):
        near = defaultdict(list)
        for _, a, b in level:
            if used_a[a] < len(left[a]):
                near[a].append(b)
        heap = [(left[a][used_a[a]], a) for a in near]
        heapq.heapify(heap)
        while heap:
            _, a = heap[0]
            free = [b for b in near[a] if used_b[b] < len(right[b])]
            if not free:  # nor is there any for the rest of the class at this distance
                heapq.heappop(heap)
                continue
            near[a] = free
            b = free[0] if len(free) == 1 else min(free, key=lambda b: right[b][used_b[b]])
            out.append((distance, a, used_a[a], b, used_b[b]))
            used_a[a], used_b[b] = used_a[a] + 1, used_b[b] + 1
            if used_a[a] < len(left[a]):
                heapq.heapreplace(heap, (left[a][used_a[a]], a))
            else:
                heapq.heappop(heap)
    return out, used_a, used_b


def _classes(ids: list, facts: list) -> tuple[list, list[list]]:
    """The distinct facts, and the sorted ids of each."""
    found = defaultdict(list)
    for id_, fact in zip(ids, facts):
        found[fact].append(id_)
    return list(found), [sorted(x) for x in found.values()]


def hash_distances(sources: list[tuple], dests: list[int]) -> np.ndarray:
    """The least distance of each source's hashes to each destination hash."""
    most = max(map(len, sources), default=0)
    own = np.array([[*s, *[s[0]] * (most - len(s))] for s in sources], np.int64).reshape(len(sources), most)
    other, out = np.array(dests, np.int64), np.zeros((len(sources), len(dests)), np.uint8)
    for i in range(0, len(sources), _BLOCK):
        out[i : i + _BLOCK] = np.bitwise_count((own[i : i + _BLOCK, :, None] ^ other).view(np.uint64)).min(axis=1)
    return out


def nearest_pictures(items: DataFrame) -> DataFrame:
    """id, dist, nearest and candidates of each item: the nearest other one of its key, ties by smaller id.

    items: key, id, hash, none of them null; ids are unique. Hashes are
    compared, not items, so copies of one picture cost nothing but their row.
    """
    kind = items.schema["id"].dataType.simpleString()

    def settle(key: tuple, rows: pa.Table) -> pa.Table:
        hashes, members = _classes(rows["id"].to_pylist(), rows["hash"].to_pylist())
        far, out, total = np.array(hashes, np.int64), [], rows.num_rows
        leads = [m[0] for m in members]
        for i in range(0, len(hashes) if total > 1 else 0, _BLOCK):
            gaps = np.bitwise_count((far[i : i + _BLOCK, None] ^ far).view(np.uint64)).astype(np.int64)
            for a, row in enumerate(gaps, i):
                row[a] = 65
                least = int(row.min())
                other = min((leads[b] for b in np.flatnonzero(row == least)), default=None) if least < 65 else None
                for n, id_ in enumerate(members[a]):
                    twin = members[a][1 if n == 0 else 0] if len(members[a]) > 1 else None
                    out.append((id_, *((0, twin) if twin is not None else (least, other)), total - 1))
        columns = list(zip(*out)) or [()] * 4
        types = [rows.schema.field("id").type, pa.int32(), rows.schema.field("id").type, pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "dist", "nearest", "candidates"])

    return items.select("key", "id", "hash").groupBy("key").applyInArrow(settle, f"id {kind}, dist int, nearest {kind}, candidates long")


def match_pictures(sources: DataFrame, dests: DataFrame, same_max: int) -> DataFrame:
    """ref, item_id and dist of the destination item taken for it, near_dist and near_item (the nearest left after all), unreadable, scored.

    sources: key, ref, hashes; dests: key, item_id, hash; ids are unique.
    Items are compared with those of their key; pairs up to same_max are taken,
    closest first, then by ref and item_id. unreadable: a hash is missing on
    either side; scored: there was something to compare. near is null for refs
    that took an item. Only refs whose key has an item are in the result. The
    items of a key meet in one task, which holds their ids, not their pairs.
    """
    ref, item = sources.schema["ref"].dataType.simpleString(), dests.schema["item_id"].dataType.simpleString()

    def settle(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        refs, items = left["ref"].to_pylist(), right["item_id"].to_pylist()
        hashes = [tuple(h for h in hs or () if h is not None) for hs in left["hashes"].to_pylist()]
        own, members = _classes(refs, hashes)
        other, offers = _classes(items, right["hash"].to_pylist())
        readable, known = [a for a, h in enumerate(own) if h], [b for b, h in enumerate(other) if h is not None]
        far = hash_distances([own[a] for a in readable], [other[b] for b in known])
        pairs = [(int(far[i, j]), readable[i], known[j]) for i, j in np.argwhere(far <= same_max).tolist()]
        taken, used, gone = deal(members, offers, pairs)
        rows = {members[a][i]: (offers[b][j], d, None, None) for d, a, i, b, j in taken}
        at = {a: i for i, a in enumerate(readable)}
        left_over = [j for j, b in enumerate(known) if gone[b] < len(offers[b])]
        blind, out = len(known) < len(other), []
        for a, ids in enumerate(members):
            near = (None, None)
            if a in at and left_over and used[a] < len(ids):
                row = far[at[a], left_over]
                least = int(row.min())
                near = (least, min(offers[known[left_over[j]]][gone[known[left_over[j]]]] for j in np.flatnonzero(row == least)))
            for id_ in ids:
                out.append((id_, *rows.get(id_, (None, None, *near)), bool(items) and (blind or a not in at), a in at and bool(known)))
        out = out if items else []
        columns = list(zip(*out)) or [()] * 7
        types = [left.schema.field("ref").type, right.schema.field("item_id").type, pa.int32(), pa.int32(), right.schema.field("item_id").type, pa.bool_(), pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["ref", "item_id", "dist", "near_dist", "near_item", "unreadable", "scored"])

    met = sources.select("key", "ref", "hashes").groupBy("key").cogroup(dests.select("key", "item_id", "hash").join(sources.select("key"), "key", "left_semi").groupBy("key"))
    return met.applyInArrow(settle, f"ref {ref}, item_id {item}, dist int, near_dist int, near_item {item}, unreadable boolean, scored boolean")


def _shape(rows: pa.Table) -> np.ndarray:
    return np.array([[x or 0 for x in rows[c].to_pylist()] for c in ("duration_s", "width", "height")], float).T.reshape(-1, 3)


def shape_gaps(own: np.ndarray, other: np.ndarray, tolerance: float) -> np.ndarray:
    """Seconds between videos of one shape, NaN for others; see functions.shapes.video_gap()."""
    (d, w, h), (e, v, g) = own.T[:, :, None], other.T[:, None, :]
    known, gap = (d > 0) & (e > 0), np.abs(d - e)
    sized = (w > 0) & (h > 0) & (v > 0) & (g > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio, other_ratio = np.maximum(w, h) / np.minimum(w, h), np.maximum(v, g) / np.minimum(v, g)
        fits = (np.abs(ratio - other_ratio) / ratio <= tolerance) & (v * g <= w * h * 1.01)
    return np.where(known & (gap <= np.maximum(0.5, 0.07 * d)) & (~sized | fits), gap, np.nan)


def match_videos(sources: DataFrame, dests: DataFrame, tolerance: float) -> DataFrame:
    """ref, item_id and gap of the destination video taken for it.

    sources: key, ref, duration_s, width, height; dests: key, item_id and the
    same. Pairs are taken by gap, ref and item_id. As match_pictures(), by classes of equal shape.
    """
    ref, item = sources.schema["ref"].dataType.simpleString(), dests.schema["item_id"].dataType.simpleString()
    facts = ["duration_s", "width", "height"]

    def settle(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own, members = _classes(left["ref"].to_pylist(), list(map(tuple, _shape(left).tolist())))
        other, offers = _classes(right["item_id"].to_pylist(), list(map(tuple, _shape(right).tolist())))
        rows, pairs = {}, []
        other_shapes = np.array(other, float).reshape(-1, 3)
        for i in range(0, len(own) if other else 0, _BLOCK):
            gaps = shape_gaps(np.array(own[i : i + _BLOCK], float).reshape(-1, 3), other_shapes, tolerance)
            pairs += [(float(gaps[a, b]), i + a, b) for a, b in np.argwhere(~np.isnan(gaps)).tolist()]
        for gap, a, i, b, j in deal(members, offers, pairs)[0]:
            rows[members[a][i]] = (offers[b][j], gap)
        columns = list(zip(*((id_, *taken) for id_, taken in rows.items()))) or [()] * 3
        types = [left.schema.field("ref").type, right.schema.field("item_id").type, pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["ref", "item_id", "gap"])

    met = sources.select("key", "ref", *facts).groupBy("key").cogroup(dests.select("key", "item_id", *facts).join(sources.select("key"), "key", "left_semi").groupBy("key"))
    return met.applyInArrow(settle, f"ref {ref}, item_id {item}, gap double")


def unknown_items(dests: DataFrame) -> DataFrame:
    """key, and of its destination videos the first by album and id, and the first without a duration."""
    first = F.struct("d_album", "item_id")
    return dests.groupBy("key").agg(F.min(first).alias("any"), F.min(F.when(F.coalesce("duration_s", F.lit(0)) <= 0, first)).alias("blank"))
