"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

A document's set of word shingles is hashed once; the hash's low bits choose a
bucket and the bucket keeps its minimum as a 16-bit register of a leading-zero
count and mantissa bits. Registers are banded into keys; documents that share
a key are candidates. Register agreement, corrected for chance collisions,
estimates the Jaccard similarity and drops pairs far below the threshold; the
rest are confirmed on the full sets, so every reported link is exact.

Groups of copies never meet in one task. Equal sets collapse to one
representative first. Within a key, members are compared with a hub drawn anew
each round and leave once they are in its component. Strays, which are outside
their key's largest component after that, then meet every member outside their
own: as pairs where a key has few, and else in blocks of texts that are
compared inside a task, once for all keys of a cluster. No pair that could
join two components is skipped, and pairs inside a component are not made.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, packed_texts, prepare, unpacked, with_arrow
from .wordhash import LOWER, U64, mix, ngram_hashes, span_hashes, text_slices, word_bounds

REGISTERS = 256
BANDS, BAND_ROWS = 40, 5
MANTISSA = 10
_VALUE_BITS = 52  # a register's hash value, exact as a double
_EMPTY = U64(1 << _VALUE_BITS)
#: Registers of which two bits each travel with a band key, and how many must agree; a pair at 0.8 fails with probability under 1e-7.
_BRIEF, _BRIEF_LEAST = 32, 15
#: Strays times members up to which a key's pairs are made singly, and texts in a block of members or of strays beyond that.
_FEW, _MEMBERS, _STRAYS = 128, 128, 512
#: Standard deviations below the threshold at which an estimate drops a pair.
MARGIN = 5.0


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of a text column: (first row, end row, document index, hash), distinct and sorted by both."""
    for first, end, data, offsets in text_slices(texts):
        lower = LOWER[data]
        starts, ends, doc = word_bounds(lower, offsets)
        words = span_hashes(lower, starts, ends)
        grams = ngram_hashes(words, n)
        whole = doc[n - 1 :] == doc[: len(grams)] if len(grams) else np.zeros(0, bool)
        grams, owner = grams[whole], doc[: len(grams)][whole]
        counts = np.bincount(doc, minlength=end - first)
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):  # too few words: the whole sequence is the one shingle
            at = np.searchsorted(doc, short)
            with np.errstate(over="ignore"):
                extra = np.array([ngram_hashes(words[a : a + counts[d]], int(counts[d]), 7)[0] for d, a in zip(short, at)], U64)
            grams, owner = np.concatenate([grams, extra]), np.concatenate([owner, short])
        order = np.argsort(grams)
        order = order[np.argsort(owner[order], kind="stable")]
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        yield first, end, owner[new], grams[new]


def registers(owner: np.ndarray, grams: np.ndarray, n_docs: int) -> np.ndarray:
    """16-bit registers by document: leading zeros and mantissa of the least value in each bucket; 0 is empty."""
    least = np.full(n_docs * REGISTERS, _EMPTY)
    np.minimum.at(least, owner * REGISTERS + (grams & U64(REGISTERS - 1)).astype(np.int64), grams >> U64(64 - _VALUE_BITS))
    return compress(least).reshape(n_docs, REGISTERS)


def compress(values: np.ndarray) -> np.ndarray:
    bits = np.frexp(values.astype(np.float64))[1].astype(np.int64)  # bit length
    zeros = _VALUE_BITS - bits
    tail = (values << np.clip(zeros + 1, 0, 63).astype(U64)) & U64((1 << _VALUE_BITS) - 1)
    code = ((zeros + 1) << MANTISSA) | (tail >> U64(_VALUE_BITS - MANTISSA)).astype(np.int64)
    return np.where(values == _EMPTY, 0, code).astype(np.uint16)


def _probes() -> np.ndarray:
    """For each register, the order in which other registers lend it a value while it is empty."""
    with np.errstate(over="ignore"):
        keys = mix(np.arange(1, REGISTERS * REGISTERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(REGISTERS, REGISTERS)
    return np.argsort(keys, axis=1)


_ORDER = _probes()


def densified(regs: np.ndarray) -> np.ndarray:
    out = regs.copy()
    rows = np.flatnonzero((regs == 0).any(1) & (regs != 0).any(1))
    for step in range(REGISTERS):
        if not len(rows):
            break
        part = out[rows]
        part = np.where(part == 0, regs[rows][:, _ORDER[:, step]], part)
        out[rows] = part
        rows = rows[(part == 0).any(1)]
    return out


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x bands keys, one 64-bit brief for each document)."""
    full = densified(regs).astype(U64)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U64)), (len(regs), BANDS)).copy()
        for j in range(BAND_ROWS):
            keys = mix(keys * U64(0xC2B2AE3D27D4EB4F) + full[:, j : BANDS * BAND_ROWS : BAND_ROWS])
        two = mix(full[:, REGISTERS - _BRIEF :]) & U64(3)
        brief = (two << (U64(2) * np.arange(_BRIEF, dtype=U64))).sum(1, dtype=U64)
    return keys, brief


def _shares() -> np.ndarray:
    """For two set sizes, in quarters of a doubling: the share of buckets in which registers of disjoint sets agree."""
    level, steps = np.arange(0, 40), np.arange(1 << MANTISSA)
    low = ((1 + steps[None, :] / (1 << MANTISSA)) * 2.0 ** -(level[:, None] + 1)).reshape(-1)
    width = np.repeat(2.0 ** -(level + 1.0 + MANTISSA), len(steps))
    within = np.stack([np.exp(-n * low) - np.exp(-n * (low + width)) for n in 2.0 ** (np.arange(4 * _SIZES) / 4) / REGISTERS])  # the least value lies in the interval
    return within @ within.T


_SIZES = 26  # doublings of a set's size
_tables: list[np.ndarray] = []


def chance_collision(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Expected share of buckets in which registers of disjoint sets of these sizes agree."""
    if not _tables:
        _tables.append(_shares())
    at = [np.clip(np.round(np.log2(np.maximum(1, n)) * 4).astype(np.int64), 0, 4 * _SIZES - 1) for n in (n_a, n_b)]
    return _tables[0][at[0], at[1]]


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and the number of buckets each rests on."""
    used = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    chance = chance_collision(n_a, n_b)
    raw = same / np.maximum(1, used)
    return np.clip((raw - chance) / np.maximum(1e-9, 1 - chance), 0, 1), used


def _sketch(n: int):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch["doc_id"]
        for first, end, owner, grams in shingle_sets(batch["text"], n):
            size = end - first
            counts = np.bincount(owner, minlength=size)
            digests = []
            with np.errstate(over="ignore"):
                for salt in (1, 2):
                    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams + U64(salt)))])
                    edge = np.concatenate([[0], np.cumsum(counts)])
                    digests.append((sums[edge[1:]] - sums[edge[:-1]]).view(np.int64))
            regs = registers(owner, grams, size)
            yield {"doc_id": ids.slice(first, size), "row": batch["row"].slice(first, size), "n_shingles": counts, "d1": digests[0], "d2": digests[1], "regs": [x.tobytes() for x in regs]}

    return run


def _bands(batch: pa.RecordBatch) -> Iterator[dict]:
    regs = np.frombuffer(b"".join(batch["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    keys, brief = band_keys(regs)
    yield {"key": keys.reshape(-1).view(np.int64), "doc": np.repeat(batch["doc_id"].to_numpy(), BANDS), "brief": np.repeat(brief.view(np.int64), BANDS)}


def _confirm(n: int, part: int, whole: int):
    """Pairs (a, b) with texts and registers of both that reach the threshold on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(z: bytes) -> np.ndarray:
            if z not in sets:
                found = [g for _, _, _, g in shingle_sets(unpacked(pa.array([z])), n)]
                sets[z] = found[0] if found else np.zeros(0, U64)
                if len(sets) > 64:
                    sets.popitem(last=False)
            sets.move_to_end(z)
            return sets[z]

        for batch in batches:
            n_a, n_b = (batch[c].to_numpy() for c in ("n_a", "n_b"))
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
            guess, used = estimates(a, b, n_a, n_b)
            least = part / whole
            near = guess + MARGIN * np.sqrt(least * (1 - least) / np.maximum(1, used)) >= least
            near &= whole * np.minimum(n_a, n_b) >= part * np.maximum(n_a, n_b)
            keep = []
            for i in np.flatnonzero(near):
                x, y = of(batch["z_a"][i].as_py()), of(batch["z_b"][i].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if whole * both >= part * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(keep, pa.int64())), batch["b"].take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def _in_blocks(many: DataFrame, facts: DataFrame, n: int, part: int, whole: int) -> DataFrame:
    """Links (a, b) between strays and members of keys that have many of both.

    Keys that share documents form a cluster; its strays and its members are
    dealt into blocks by hash, and a task compares one block of each. Of the
    links that it finds it gives a spanning forest over components, so their
    number doesn't grow with the pairs.
    """
    hubs = cut(many.groupBy("key").agg(F.min("doc").alias("hub")))
    joined = components(many.join(hubs, "key").where("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")))
    docs = many.groupBy("doc", "component").agg(F.max("stray").alias("stray"))
    docs = cut(docs.join(joined.select(F.col("node").alias("doc"), F.col("component").alias("cluster")), "doc"))
    sizes = docs.groupBy("cluster").agg(F.ceil(F.count("*") / _MEMBERS).alias("mbs"), F.ceil(F.count_if("stray") / _STRAYS).alias("sbs"))
    sizes = cut(sizes.where("sbs > 0"))
    deal = lambda df, count: df.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("doc"), F.col(count)))
    texts = facts.select(F.col("doc_id").alias("doc"), "z", "n")
    listed = lambda df: cut(df.join(texts, "doc").groupBy("cluster", "block").agg(F.collect_list(F.struct("doc", "component", "stray", "z", "n")).alias("texts")))
    m, s = listed(deal(docs, "mbs")), listed(deal(docs.where("stray"), "sbs"))
    met = cut(m.select("cluster", F.col("block").alias("mb")).join(s.select("cluster", F.col("block").alias("sb")), "cluster"))
    met = met.join(m.select("cluster", F.col("block").alias("mb"), F.col("texts").alias("m")), ["cluster", "mb"])
    met = met.repartition("cluster", "sb", "mb").join(s.select("cluster", F.col("block").alias("sb"), F.col("texts").alias("s")), ["cluster", "sb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = []
                one, other = (pa.RecordBatch.from_struct_array(batch[c][i].values) for c in ("m", "s"))
                sets = [[next((g for _, _, _, g in shingle_sets(unpacked(x["z"].slice(k, 1)), n)), np.zeros(0, U64)) for k in range(x.num_rows)] for x in (one, other)]
                owner = np.repeat(np.arange(one.num_rows), [len(x) for x in sets[0]])
                grams = np.concatenate(sets[0])
                order = np.argsort(grams, kind="stable")
                grams, owner = grams[order], owner[order]
                n_m, doc_m, root_m, stray_m = (one[c].to_numpy(zero_copy_only=False).copy() for c in ("n", "doc", "component", "stray"))
                doc_s, root_s = (other[c].to_numpy().copy() for c in ("doc", "component"))
                for k, own in enumerate(sets[1]):
                    may = (root_m != root_s[k]) & (~stray_m | (doc_m < doc_s[k])) & (whole * np.minimum(n_m, len(own)) >= part * np.maximum(n_m, len(own)))
                    if not may.any():
                        continue
                    low, high = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
                    count = high - low
                    at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                    both = np.bincount(owner[at], minlength=len(n_m))
                    hit = np.flatnonzero(may & (whole * both >= part * (n_m + len(own) - both)))
                    joined, first = np.unique(root_m[hit], return_index=True)  # one link for each component that this text joins
                    found += [(min(int(doc_s[k]), int(d)), max(int(doc_s[k]), int(d))) for d in doc_m[hit[first]]]
                    for roots in (root_m, root_s):
                        roots[np.isin(roots, joined)] = root_s[k]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], ["a", "b"])

    return cut(met.select("m", "s").mapInArrow(run, "a long, b long").distinct())


def _agree(x, y):
    """How many of the two-bit entries of two briefs agree."""
    differ = x.bitwiseXOR(y)
    low = differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555))
    return _BRIEF - F.bit_count(low)


def near_duplicates(docs: DataFrame, n: int = 5, part: int = 80, whole: int = 100, sampled_rounds: int = 2, partners: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are ignored).

    Words are split at ASCII white space after lower-casing A-Z; a set holds the
    distinct n-word shingles, or the whole sequence of a shorter text. Texts
    with whole * |A & B| >= part * |A | B| are linked; component_id is the
    smallest doc_id reachable. Null and empty texts have an empty set and no
    link. Rows with a null doc_id are returned as kept with a null component.
    Rows that repeat a doc_id are each returned, linked by any of their texts.
    An empty table gives an empty result. Very long texts are hashed whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    sketch = cut(with_arrow(source, _sketch(n), "doc_id long, row long, n_shingles long, d1 long, d2 long, regs binary"))
    equal = cut(sketch.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    first = F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    known = cut(sketch.join(equal, ["d1", "d2", "n_shingles"], "left").select("doc_id", "row", "n_shingles", first.alias("first"), F.when(first == F.col("doc_id"), F.col("regs")).alias("regs")))
    single = known.where("n_shingles > 0 and regs is not null")

    bands = with_arrow(single.select("doc_id", "regs"), _bands, "key long, doc long, brief long")
    shared = cut(bands.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("key"))
    members = cut(bands.join(shared, "key"))
    wanted = cut(members.select(F.col("doc").alias("doc_id")).distinct())
    texts = packed_texts(source, ["row"]).join(wanted, "doc_id").dropDuplicates(["doc_id", "row"])  # a repeated id has its own texts' registers
    facts = cut(texts.join(single.select("doc_id", "row", F.col("n_shingles").alias("n"), "regs").join(wanted, "doc_id").dropDuplicates(["doc_id", "row"]), ["doc_id", "row"]).drop("row"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among pairs (doc, with). Many share a hub, `with`, so it is joined first, to bare ids, and the work is dealt by doc."""
        pairs = pairs.select(F.col("doc").alias("a"), F.col("with").alias("b"))
        side = lambda s: facts.select(F.col("doc_id").alias(s), F.col("z").alias(f"z_{s}"), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))
        return cut(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_confirm(n, part, whole), "a long, b long").distinct())

    labels = wanted.select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("component"))

    def merged(links: DataFrame) -> DataFrame:
        """labels after links between their documents."""
        ends = links.join(labels.select(F.col("doc").alias("a"), F.col("component").alias("ca")), "a").join(labels.select(F.col("doc").alias("b"), F.col("component").alias("cb")), "b")
        new = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct())
        return cut(labels.join(new.select(F.col("node").alias("component"), F.col("component").alias("lower")), "component", "left").select("doc", F.coalesce("lower", "component").alias("component")))

    mixed = None
    for turn in range(sampled_rounds + 1):
        placed = members.join(labels, "doc")
        if turn:
            uneven = cut(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"))
            placed = cut(placed.join(uneven, "key"))
            members = placed.select("key", "doc", "brief")
            if uneven.isEmpty():
                break
        if turn < sampled_rounds:
            hubs = cut(placed.groupBy("key").agg(F.min_by(F.struct("doc", "brief", "component"), F.struct(F.xxhash64("doc", F.lit(turn)), "doc")).alias("hub")))
            near = placed.join(hubs, "key").where((F.col("component") != F.col("hub.component")) & (_agree(F.col("brief"), F.col("hub.brief")) >= _BRIEF_LEAST))
            near = near.groupBy("doc", F.col("hub.doc").alias("with")).agg(F.count("*").alias("keys"))
            best = near.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("keys"), "with"))).where(F.col("place") <= partners)
            links = confirmed(best)
        else:
            sizes = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
            largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("most"))
            largest = cut(largest.select("key", "main", ((F.col("all") - F.col("most")) * F.col("all") > _FEW).alias("many")))
            split = cut(placed.join(largest, "key").withColumn("stray", F.col("component") != F.col("main")))
            few = split.where("not many")
            strays = few.where("stray").select("key", F.col("doc").alias("s"), F.col("brief").alias("sb"), F.col("component").alias("sc"))
            near = strays.join(few, "key").where((F.col("component") != F.col("sc")) & (~F.col("stray") | (F.col("doc") < F.col("s"))) & (_agree(F.col("brief"), F.col("sb")) >= _BRIEF_LEAST))
            links = confirmed(near.select(F.col("s").alias("doc"), F.col("doc").alias("with")).distinct())
            many = split.where("many")
            if not many.isEmpty():
                links = links.union(_in_blocks(many, facts, n, part, whole)).distinct()
        if not links.isEmpty():
            labels = merged(links)

    ends = labels.where("component <> doc").select(F.col("doc").alias("first"), "component")
    out = known.join(ends, "first", "left").select("doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
