import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lakecurator.llm import classifier, near_duplicates as nd, repeats, rules, wordhash
from lakecurator.llm.common import components, ranks
from lakecurator.llm.decontaminate import decontaminate
from pyspark.sql import functions as F

from .corpora import corpus, frame, odd, sentences

ITEM = "item_id long, text string"


def words5(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words5(text)
    return frozenset(zip(*(w[i:] for i in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(rows, n):
    sets = [(i, shingles(t, n)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: (len(x), find(i), find(i) == i) for i, x in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    rows = corpus(11, 50)
    found = nd.near_duplicates(frame(spark, rows), n=n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == linked(rows, n)
    assert len(found) == len(rows)


@pytest.mark.parametrize("members,strays", [(128, 512), (4, 3)])
def test_strays_in_blocks_equal_brute_force(spark, monkeypatch, members, strays):
    import random

    monkeypatch.setattr(nd, "_FEW", 0)
    monkeypatch.setattr(nd, "_MEMBERS", members)
    monkeypatch.setattr(nd, "_STRAYS", strays)
    rng = random.Random(8)
    base = sentences(rng, 100).split(" ")
    rows = []
    for i in range(60):  # edits of one text, some near the base or each other and some near none
        words = list(base)
        for k in rng.sample(range(100), rng.choice([1, 3, 5, 7, 9, 12])):
            words[k] = f"w{rng.randrange(30)}"
        rows.append((i, " ".join(words), "en", "s", 0))
    found = nd.near_duplicates(frame(spark, rows), n=2, sampled_rounds=1, partners=1).collect()
    expected = linked(rows, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == expected
    assert 2 < sum(kept for *_, kept in expected.values()) < 60


def test_links_grow_with_the_members_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(nd, "_FEW", 16)
    made, blocks = [], nd._in_blocks

    def counted(*args):
        links = blocks(*args)
        made.append(links.count())
        return links

    monkeypatch.setattr(nd, "_in_blocks", counted)
    for size in (100, 200):
        rng, made[:] = random.Random(9), []
        words = sentences(rng, 200).split()
        rows = []
        for i in range(size):  # some pairs reach 0.8, many just miss it
            own = list(words)
            for j in rng.sample(range(200), rng.randrange(4, 14)):
                own[j] = f"w{rng.randrange(10**6)}"
            rows.append((i, " ".join(own), "en", "s", 1))
        found = nd.near_duplicates(frame(spark, rows), n=2).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == linked(rows, 2)
        assert made and max(made) <= 2 * size  # of about size * size / 4 pairs that reach it


def test_near_duplicates_of_odd_tables(spark):
    found = nd.near_duplicates(odd(spark), n=2).collect()
    assert collections.Counter((r.doc_id, r.component_id, r.kept) for r in found) == {(None, None, True): 2, (7, 7, True): 3, (8, 8, True): 1, (9, 9, True): 1}
    assert nd.near_duplicates(frame(spark, [])).count() == 0


def test_chains_of_near_copies_are_one_component(spark):
    import random

    rng = random.Random(2)
    words = sentences(rng, 60).split(" ")
    rows = []
    for i in range(40):  # neighbours are near, the ends are not
        words[(7 * i) % 60] = f"new{i}"
        rows.append((100 - i, " ".join(words), "en", "s", 0))
    found = nd.near_duplicates(frame(spark, rows), n=2, sampled_rounds=1, partners=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == linked(rows, 2)


def test_register_estimates_are_close_and_corrected():
    rng = np.random.default_rng(1)
    for size, share in ((400, 0.8), (5000, 0.5), (60, 0.9)):
        both = int(size * 2 * share / (1 + share))
        pool = rng.integers(0, 1 << 64, 2 * size, dtype=np.uint64)
        a, b = pool[:size], np.concatenate([pool[:both], pool[size : 2 * size - both]])
        owner = np.zeros(size, np.int64)
        x, y = nd.registers(owner, a, 1), nd.registers(owner, b, 1)
        guess, used = nd.estimates(x, y, np.array([size]), np.array([size]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(guess[0] - true) < 5 * np.sqrt(true * (1 - true) / used[0])
    chance = nd.chance_collision(np.array([10000]), np.array([10000]))[0]
    assert 1e-5 < chance < 1e-3
    assert (nd.densified(nd.registers(np.zeros(1, np.int64), pool[:1], 1)) != 0).all()


def removed(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    seen = collections.Counter(tuple(w[j : j + window]) for _, w in texts for j in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return collections.Counter(out)


@pytest.mark.parametrize("window,limit", [(35, 50_000), (35, 3), (8, 50_000), (8, 5)])
def test_repeats_equal_brute_force(spark, monkeypatch, window, limit):
    monkeypatch.setattr(repeats, "GROUP_LIMIT", limit)
    rows = corpus(12, 50)
    found = repeats.remove_repeats(frame(spark, rows), window=window).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == removed(rows, window)


def test_nodes_of_subtrees_equal_brute_force():
    rng = np.random.default_rng(3)
    for window, k, letters in ((12, 10, 2), (35, 10, 2), (14, 10, 3)):
        monkey = rng.integers(0, letters, 400)
        monkey[200:300] = monkey[40:140]
        prefix = monkey[50 : 50 + k]
        texts, anchors = [], []
        for i in range(60):  # every leaf starts with the prefix; around it are copies and noise
            left, right = rng.integers(0, letters, window - k), rng.integers(0, letters, window - k)
            if i % 3:
                left[-(i % 7) :] = 1
                right[: i % 11] = 0
            lo, hi = sorted(rng.integers(0, window - k + 1, 2).tolist())
            whole = np.concatenate([left, prefix, right])
            texts.append(whole[window - k - hi : 2 * window - k - lo])
            anchors.append((lo, hi))
        words, row = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        lo, hi = (np.array([a[j] for a in anchors]) for j in (0, 1))
        leaf, offset = repeats.deep_repeats(words, row, lo, hi, window)
        seen = collections.defaultdict(list)
        for i, t in enumerate(texts):
            for d in range(lo[i], hi[i] + 1):
                seen[(d, tuple(t[hi[i] - d : hi[i] - d + window].tolist()))].append((i, d))
        assert set(zip(leaf.tolist(), offset.tolist())) == {x for v in seen.values() if len(v) > 1 for x in v}


def test_hot_prefixes_grow_to_the_window(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_LIMIT", 8)
    rng = random.Random(6)
    start, passage = sentences(rng, 14), sentences(rng, 80)
    rows = [(i, f"{sentences(rng, 6)} {start} {sentences(rng, 30)}" if i % 2 else f"{sentences(rng, 5)} {passage} {sentences(rng, 5)}", "en", "s", 1) for i in range(120)]
    rows += [(500 + i, f"{sentences(rng, i)} {start} {' '.join(passage.split()[: 20 + i])}", "en", "s", 1) for i in range(12)]
    found = repeats.remove_repeats(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == removed(rows, 35)


def test_repeats_options_and_odd_tables(spark):
    rows = corpus(13, 30)
    plain = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    for r in repeats.remove_repeats(frame(spark, rows), as_text=False).collect():
        assert r.kept == hashlib.sha256(plain[r.doc_id].kept.encode()).hexdigest()
    text = {i: t or "" for i, t, *_ in rows}
    for r in repeats.remove_repeats(frame(spark, rows), original=True, keep=["lang", "n_chars"]).collect():
        assert r.kept == (plain[r.doc_id].kept if r.n_removed else text[r.doc_id]) and r.lang == "en"
    found = repeats.remove_repeats(odd(spark), keep=["label", "z", "kept", "_rid", "n_words"]).collect()
    assert all((r["_rid"], r.kept_in, r.n_words_in) == ("r", "k", None) for r in found)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.label) for r in found) == {(None, 80, 80, "L"): 1, (7, 80, 80, "L"): 2, (7, 2, 0, "L"): 1, (None, 0, 0, "L"): 1, (8, 0, 0, "L"): 1, (9, 0, 0, "L"): 1}
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def hits(rows, items, window=13):
    pattern, lower = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: pattern.findall((t or "").translate(lower))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1) if n else []:
            windows[tuple(w[j : j + n])].add(i)
    lengths, out = {len(x) for x in windows}, []
    for d, t, *_ in rows:
        w = split(t)
        hit, found = [0] * len(w), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if (key := tuple(w[j : j + n])) in windows:
                    found |= windows[key]
                    hit[j : j + n] = [1] * n
        out.append((d, len(w), sum(hit), len(found), tuple(sorted(str(x) for x in found if x is not None)), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return collections.Counter(out)


@pytest.mark.parametrize("window", [13, 5, 20])
def test_decontamination_equals_brute_force(spark, window):
    rows = corpus(14, 40)
    texts = [t or "" for _, t, *_ in rows]
    items = [(i, " ".join(texts[i].split()[2 : 2 + 15 * (i % 3 + 1)])) for i in range(12)]
    items += [(20, "two spaces"), (21, "ONE"), (22, None), (23, ""), (24, items[3][1]), (25, "!!!"), (26, "a " * 40), (27, items[4][1].upper()), (28, " ".join(texts[7].split()[:6])), (None, "one")]
    found = decontaminate(frame(spark, rows), spark.createDataFrame(items, ITEM), window=window).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in found)
    assert got == hits(rows, items, window)


def test_repeated_words_cost_rows_in_proportion(spark, monkeypatch):
    """An item of one word repeated: marks are few, and spans grow with the document's words, not with both."""
    from lakecurator.llm import decontaminate as module

    sizes, kept = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: sizes.append((df.columns, out := kept(df))) or out)
    rows = [(1, "so " * 3000, "en", "s", 1), (2, "and " + "so " * 20 + "on", "en", "s", 1)]
    found = module.decontaminate(frame(spark, rows), spark.createDataFrame([(5, "so " * 200)], ITEM)).collect()
    assert {(r.doc_id, r.n_hit) for r in found} == {(1, 3000), (2, 20)}
    counts = {frozenset(c): df.count() for c, df in sizes}
    assert counts[frozenset(["kind", "gram", "class", "size", "ileft", "iright"])] < 20 and counts[frozenset(["doc", "class", "low", "high"])] < 3100


def test_decontamination_of_odd_tables(spark, monkeypatch):
    from lakecurator.llm import decontaminate as module

    none = spark.createDataFrame([], ITEM)
    assert all(r.n_hit == 0 and not r.contaminated and r["items"] == [] for r in decontaminate(odd(spark), none).collect())
    assert decontaminate(frame(spark, []), spark.createDataFrame([(1, "some item words")], ITEM)).count() == 0
    text = odd(spark).where("doc_id is null and text is not null").first().text
    monkeypatch.setattr(module, "BROADCAST_ROWS", -1)  # the way of large benchmarks
    found = decontaminate(odd(spark), spark.createDataFrame([(5, text), (40, text), (6, "another text")], ITEM)).collect()
    assert collections.Counter((r.doc_id, tuple(r["items"]), r.contaminated) for r in found) == {(None, ("40", "5"), True): 1, (7, ("40", "5"), True): 2, (7, ("6",), True): 1, (None, (), False): 1, (8, (), False): 1, (9, (), False): 1}


def countable(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    has = lambda line: re.search(r"[^\x20\x09-\x0D]", line)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if has(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    cover = [False] * len(w)
    for j in range(len(w) - 7):
        if grams[tuple(w[j : j + 8])] > 1:
            cover[j : j + 8] = [True] * 8
    n = sum(cover)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, n, len(w) < 20 or 100 * n > 30 * len(w))


def quality_rows():
    import random

    rng = random.Random(21)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = sentences(rng, rng.randint(30, 120))
        if not good:
            text = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in text.split(" "))
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_rules_count_and_learn(spark):
    rows, labels = quality_rows()
    extra = [(1000 + i, t, *rest) for i, t, *rest in corpus(15, 20)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in rules.quality_rules(frame(spark, rows + extra), table).collect()}
    for i, t, *_ in rows + extra:
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == countable(t)
        assert not (r.base_failed and r.kept) and 0 <= r.score <= 1
    held = [i for i, *_ in labels if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert np.mean([found[i].kept == (labels[i][1] == 1) for i in held if not found[i].base_failed]) > 0.97
    assert rules.quality_rules(frame(spark, []), table).count() == 0
    assert rules.quality_rules(odd(spark), table.limit(0)).count() == 7


def test_classifier_learns_and_is_calibrated(spark):
    rows, labels = quality_rows()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = classifier.fit(docs, table)
    found = {r.doc_id: r for r in classifier.classify(docs, model).collect()}
    held = [i for i, *_ in labels if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert np.mean([found[i].predicted == labels[i][1] for i in held]) > 0.95
    assert 0.5 <= model["temperature"] <= 8
    again = classifier.fit(frame(spark, rows, partitions=70), table)
    assert np.array_equal(model["vectors"], again["vectors"])
    strange = classifier.classify(odd(spark), model).collect()
    assert len(strange) == 7 and all(0 <= r.score <= 1 and r.label == "L" for r in strange)
    empty = classifier.fit(frame(spark, []), table.limit(0))
    assert all(0 <= r.score <= 1 for r in classifier.classify(odd(spark), empty).collect())


TEXTS = ["the cat sat on the mat", "", None, "ein Straße ein", "x", "AB ab 12 -- !! straße\n12", "the the the the"]


def _laid_out(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def test_context_sums_and_pooling_equal_brute_force(spark):
    dims, signs = classifier.index_vectors()
    slots = []
    for t in TEXTS:
        data, offsets = _laid_out([t])
        slots.append(classifier.tokens(data, offsets)[0].tolist())
        assert len(slots[-1]) == len(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+|[0-9]+|[!-/:-@\[-`{-\x7f]+", t or ""))
    expected = np.zeros((classifier.SLOTS, classifier.DIMENSIONS), np.int64)
    for words in slots:
        for i, own in enumerate(words):
            for j in range(max(0, i - classifier.REACH), min(len(words), i + classifier.REACH + 1)):
                if j != i:
                    for k in range(classifier.NONZERO):
                        expected[own, dims[words[j], k]] += signs[words[j], k]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)])
    assert (classifier.context_table(docs) == expected).all()

    vectors = classifier.word_vectors(expected)
    data, offsets = _laid_out(TEXTS)
    found = classifier.pooled(data, offsets, vectors)
    width = vectors.shape[1]
    for row, words in zip(found, slots):
        v = vectors[words]
        mean = v.mean(0) if words else np.zeros(width)
        spread = v.std(0, ddof=1) if len(words) > 1 else np.zeros(width)
        near = np.mean([v[i, : classifier.DIMENSIONS] @ v[i + 1, : classifier.DIMENSIONS] for i in range(len(words) - 1)]) if len(words) > 1 else 0
        assert np.allclose(row, np.concatenate([mean, spread, [near, np.log1p(len(words)) / 10]]), atol=2e-3)


def test_features_equal_brute_force():
    def slot(values, n, salt, slots):
        return (wordhash.ngram_hashes(np.array(values, np.uint64), n, salt) % np.uint64(slots)).tolist()

    data, offsets = _laid_out(TEXTS)
    found = rules.features(data, offsets)
    for row, t in zip(found, TEXTS):
        words = [int(wordhash.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in (t or "").encode().split()]
        blocks = [[w % rules.SLOTS[0] for w in words], slot(words, 2, 0, rules.SLOTS[1]), slot([ord(c) for c in t or ""], 3, 5, rules.SLOTS[2])]
        expected = []
        for listed, n in zip(blocks, rules.SLOTS):
            counts = np.sqrt(np.bincount(np.array(listed, np.int64), minlength=n))
            expected.append(counts / max(np.linalg.norm(counts), 1e-6))
        assert np.allclose(row, np.concatenate(expected), atol=1e-5)


def test_regression_follows_its_features():
    rng = np.random.default_rng(2)
    X = np.zeros((400, sum(rules.SLOTS)), np.float32)
    y = (rng.random(400) < 0.5).astype(np.float32)
    X[np.arange(400), np.where(y > 0, 5, 9)] = 1
    X[np.arange(400), rng.integers(100, 200, 400)] = 0.5
    model = rules.train(X, y)
    p = 1 / (1 + np.exp(-(model["slope"] * (X @ model["w"] + model["b"]) + model["offset"])))
    assert ((p > 0.5) == (y > 0)).all() and model["w"][5] > 0 > model["w"][9]


def test_word_hashes_follow_words():
    texts = pa.array(["ab c", "", None, "c ab", "abc"])
    ((first, end, data, offsets),) = wordhash.text_slices(texts)
    starts, ends, doc = wordhash.word_bounds(data, offsets)
    h = wordhash.span_hashes(data, starts, ends)
    assert (first, end) == (0, 5) and doc.tolist() == [0, 0, 3, 3, 4]
    assert h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3
    assert [x[:2] for x in wordhash.text_slices(texts, 3)] == [(0, 1), (1, 3), (3, 4), (4, 5)] and not list(wordhash.text_slices(pa.array([], pa.string())))


def test_pairs_at_exactly_the_threshold_are_found(spark):
    """A thousand pairs with 40 shingles in common of 50: none is missed, and pairs just below aren't linked."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3))
    rows = []
    for i in range(1_000):
        same, differ = [word() for _ in range(41)], 5 if i < 900 else 6
        for side in range(2):
            rows.append((2 * i + side, " ".join(same[: 46 - differ] + [word() + str(side) for _ in range(differ)]), "en", "s", 1))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(frame(spark, rows), n=2).collect()}
    assert {n for n, _ in found.values()} == {45}
    assert all(found[2 * i + 1][1] == 2 * i for i in range(900)) and all(found[2 * i + 1][1] == 2 * i + 1 for i in range(900, 1_000))


def test_letters_of_either_case_are_alike(spark):
    text = " ".join(f"Word{i} ÉTÉ" for i in range(30))
    rows = [(1, text, "en", "s", 1), (2, text.replace("Word", "WORD"), "en", "s", 1), (3, text.replace("É", "é"), "en", "s", 1)]
    found = {r.doc_id: r.component_id for r in nd.near_duplicates(frame(spark, rows), n=2).collect()}
    assert found == {1: 1, 2: 1, 3: 3}  # A-Z alone are lowered


def test_kept_columns_never_clash(spark):
    docs = frame(spark, [(1, "a b", "en", "s", 1)]).withColumns({"n_words": F.lit(5), "n_words_in": F.lit(6), "kept": F.lit("k")})
    found = repeats.remove_repeats(docs, keep=["n_words", "n_words_in", "kept"])
    assert len(set(found.columns)) == len(found.columns)
    row = found.first()
    assert (row.n_words, row.n_words_in, row.n_words_in_in, row.kept_in) == (2, 6, 5, "k")


def test_components_and_ranks(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200, 100), (300, 200), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100}
    ranked = ranks(spark.range(1000).withColumn("g", F.col("id") % 3), "g", ["id"]).toPandas()
    for _, part in ranked.groupby("g"):
        assert part.sort_values("id")["rank"].tolist() == list(range(len(part)))
