"""Vector codes and hard negatives against brute force."""

import math
import re

import numpy as np
import pytest

from lakecurator.llm import hard_negatives
from lakecurator.llm.codes import block_sizes, block_summary, codebooks_digest, compress, nearest
from lakecurator.llm.vectors import LIMIT

SCHEMA = "vec_id long, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def vectors(n, width=32, seed=3):
    """Rows in clusters, with copies of one vector, missing labels, and ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (7, width))
    rows = []
    for i in range(n):
        x = centres[i % 7] + rng.normal(0, 0.1, width)
        rows.append((i * 5, x.astype(np.float32).tolist(), None if i % 17 == 3 else i % 4))
    copied = rows[2][1]
    rows += [(5 * i + 1, copied, 1) for i in range(n // 4)]
    return rows


def odd_vectors(width=32):
    x = [0.25] * width
    return [(2, None, 1), (3, x[:-1] + [None], 1), (4, x[:-1] + [NAN], 1), (6, x[:-1] + [INF], None), (7, x[:-1] + [-INF], 2), (None, x, None), (None, x, 5), (8, x, 5), (8, x, 5), (8, [0.5] * width, 6), (9, x[:-3], 5), (11, [], 5), (12, [3e38] * width, 1), (13, [-0.0] * width, 1), (14, [1e-9] * width, 1), (16, [-1e-9] * width, 1)]


def whole(rows, width):
    out = []
    for vec_id, x, label in rows:
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            v = [max(-LIMIT, min(LIMIT, math.floor(256 * float(np.float32(c))))) for c in x]
            out.append((vec_id, label, v + [0] * (width - len(v))))
    return out


def slow_codes(rows, width, parts, entries, rounds):
    kept = sorted(whole(rows, width), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = width // parts
    cut = lambda v, p: tuple(v[p * size : (p + 1) * size])
    books = [[list(cut(r[2], p)) for r in kept[:entries]] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            chosen = {}
            for r in kept:
                chosen.setdefault(best(cut(r[2], p), books[p])[1], []).append(cut(r[2], p))
            for i, xs in chosen.items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs)]
    out, sums = [], {}
    for vec_id, label, v in kept:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[label] = sums.get(label, 0) + error
        out.append((vec_id, label, bytes(i for _, i in found), error))
    return sorted(((*r, sums[r[1]]) for r in out), key=repr), books


@pytest.mark.parametrize("rows,width,parts,entries", [(vectors(60), 32, 8, 20), (vectors(90, 24) + odd_vectors(24), 24, 4, 16), (odd_vectors(16), 16, 16, 64), (vectors(3, 8), 8, 2, 64)])
def test_codes_equal_brute_force(spark, rows, width, parts, entries):
    extra = [(*r, "x", 1.5, b"c") for r in rows]
    coded, books = compress(spark.createDataFrame(extra, SCHEMA + ", code string, error double, v binary").repartition(3), parts, entries)
    expected, slow = slow_codes(rows, width, parts, entries, 2)
    assert books.tolist() == slow
    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in coded.collect()), key=repr) == expected


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 3), (2, [NAN], None)]):
        coded, books = compress(spark.createDataFrame(rows, SCHEMA))
        assert coded.collect() == [] and books.shape[1] == 0
        assert len(codebooks_digest(books)) == 64


def test_short_vectors_end_in_zeros(spark):
    rows = [(i, [0.1 * (i + j) for j in range(10)], 0) for i in range(5)]
    coded, books = compress(spark.createDataFrame(rows, SCHEMA), parts=4, entries=5)
    assert books.shape == (4, 5, 3) and (books[3, :, 1:] == 0).all()
    assert {r.error for r in coded.collect()} == {0}


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 4, 7, 16):
        x, y = rng.integers(-500, 500, (40, size)), rng.integers(-500, 500, (9, size))
        exact, last = ((x[:, None] - y[None]) ** 2).sum(axis=2), None
        for block in block_sizes(size):
            (m, r), (em, er) = block_summary(x.astype(float), block), block_summary(y.astype(float), block)
            low = ((m[:, None] - em[None]) ** 2 + (r[:, None] - er[None]) ** 2).sum(axis=2)
            assert (low <= exact + 1e-6).all()
            assert last is None or (low >= last - 1e-6).mean() > 0.99 or size in (3, 7)  # finer blocks bound better where they halve evenly
            last = low
        code, least, _ = nearest(x, y)
        assert (least == exact.min(axis=1)).all() and (code == exact.argmin(axis=1)).all()


def test_bounds_spare_distances():
    rng = np.random.default_rng(2)
    y = rng.integers(-100, 100, (64, 8))
    x = y[rng.integers(0, 64, 500)] + rng.integers(-15, 15, (500, 8))
    assert nearest(x, y)[2] < 500 * 64 * 0.5


def test_ties_go_to_the_lower_entry():
    code, least, _ = nearest(np.array([[0, 0], [5, 5]]), np.array([[1, 0], [-1, 0], [0, 1], [1, 0]]))
    assert code.tolist() == [0, 0] and least.tolist() == [1, 41]


NEGATIVES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def slow_negatives(rows, width, every=100, positives=5, k=10, low=30, high=90):
    kept = sorted({(i, label, tuple(v)) for i, label, v in whole(rows, width) if i is not None and label is not None})
    out = []
    for anchor, label, q in kept:
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i, other) for i, other, v in kept if i != anchor)
        for ps, pid, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and low * -ps <= 100 * -r[0] <= high * -ps][:k]
            out += [(anchor, pid, n, i, -ps, -s) for n, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.fixture
def small_tree(monkeypatch):
    """Sizes that make small tables go through several levels, buckets, blocks and waves."""
    monkeypatch.setattr(hard_negatives, "BUCKET", 8)
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "WAVE", 2)


@pytest.mark.parametrize("rows,width,every", [(vectors(300, 16), 16, 20), (vectors(120, 8) + odd_vectors(8), 8, 4), (odd_vectors(4), 4, 1)])
def test_negatives_equal_brute_force(spark, small_tree, rows, width, every):
    extra = [(*r, 1, 2.0, "x") for r in rows]
    found = hard_negatives.hard_negatives(spark.createDataFrame(extra, SCHEMA + ", leaf int, score double, block string").repartition(3), every=every, piece=40, sample=100)
    assert sorted(map(tuple, found.collect())) == slow_negatives(rows, width, every)


def test_negatives_of_copies(spark, small_tree):
    """One vector fills most of the table: ties go by vec_id, over many pieces of one leaf."""
    rng = np.random.default_rng(8)
    rows = [(i, [0.5] * 8 if i % 3 else rng.normal(0, 0.5, 8).tolist(), i % 3) for i in range(500)]
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), piece=30, sample=200)
    assert sorted(map(tuple, found.collect())) == slow_negatives(rows, 8)


def test_negatives_of_nothing(spark):
    for rows in ([], [(100, None, 3), (200, [NAN], 1)], [(100, [1.0], None)], [(100, [1.0], 1)], [(100, [1.0], 1), (101, [1.0], 1)], [(100, [1.0], 1), (101, [-1.0], 1), (102, [0.5], 2)]):
        assert hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_tree_bounds_hold():
    """No row is nearer or farther than the bounds of its leaf and bucket say, and near queries pass over leaves."""
    rng = np.random.default_rng(4)
    x = (rng.normal(0, 20, (12, 6))[rng.integers(0, 12, 900)] + rng.normal(0, 2, (900, 6))).round().astype(np.int64)
    space = hard_negatives.Space(6, int((x**2).sum(axis=1).max()))
    tree = hard_negatives.UpperTree(space, x[:300], 4)
    leaf, path = tree.leaves(x)
    leaves = sorted(set(leaf.tolist()))
    low, high = (np.array([f(path[leaf == i], axis=0) for i in leaves]) for f in (np.min, np.max))
    near, most = hard_negatives._between(space.anchors(x, tree.points), [tree.above(i) for i in leaves], low, high)
    far = space.anchors(x, x)
    spared = 0
    for n, i in enumerate(leaves):
        inside = far[:, leaf == i]
        assert (near[:, [n]] <= inside + space.room).all() and (most[:, [n]] >= inside - space.room).all()
        spared += (near[:, n] > np.sort(far, axis=1)[:, 5]).sum()
    assert spared > 0.3 * len(x) * len(leaves)


def test_products_are_exact_beyond_doubles():
    a = np.array([[LIMIT - 1] * 64, [3] * 64], np.int64)
    assert hard_negatives.products(a, a)[0, 0] == 64 * (LIMIT - 1) ** 2


def test_queries_of_blocks_are_never_broadcast(spark, monkeypatch):
    """Their estimated size is that of the blocks alone, but each is sent with every piece."""
    plans, cut = [], hard_negatives.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(hard_negatives, "cut", seen)
    rows = vectors(120, 8)
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=10, piece=16, sample=20)
    assert found.count()
    pairs = [line for plan in plans for line in plan.splitlines() if re.search(r"Join \[leaf#\d+, piece#\d+\].*Inner", line)]
    assert pairs and not [line for line in pairs if "Broadcast" in line]
