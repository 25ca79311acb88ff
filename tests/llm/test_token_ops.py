import json
import os
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lakecurator.llm.packing import boundaries, pack
from lakecurator.llm.queries import tokenizer_file
from lakecurator.llm.token_counts import Automaton, token_counts, vocabulary
from lakecurator.llm.token_files import encoder, read_token_files, write_token_files
from pyspark.sql import functions as F

from .corpora import DOCS, corpus, frame, odd

PIECES = tokenizer_file("byte_bpe_50k.tiktoken")


def longest_match(word, first, later):
    count, at = 0, 0
    while at < len(word):
        table = later if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in table), None)
        if end is None:
            return 1
        count, at = count + 1, end
    return count


def split_vocabulary(pieces):
    return {p[1:] for p in pieces if p[:1] == b" " and p[1:].split() == [p[1:]]}, {p for p in pieces if p[:1] != b" " and p.split() == [p]}


def test_automaton_equals_longest_match_on_random_vocabularies():
    rng = random.Random(3)
    for _ in range(200):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        pieces |= {b" " + bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        automaton, (first, later) = Automaton(pieces), split_vocabulary(pieces)
        for _ in range(40):
            word = bytes(rng.choices(b"abcd", weights=[5, 5, 5, 1], k=rng.randint(1, 9)))
            assert automaton.count(word) == longest_match(word, first, later), (pieces, word)


def test_counts_equal_brute_force(spark):
    rows = corpus()
    first, later = split_vocabulary(vocabulary(PIECES))
    found = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(frame(spark, rows), PIECES).collect()}
    seen = {}
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        assert found[i] == (len(words), sum(seen.setdefault(w, longest_match(w, first, later)) for w in words))
    assert token_counts(frame(spark, [], DOCS), PIECES).count() == 0
    strange = token_counts(odd(spark), PIECES, ["n_words", "label", "_rid"]).collect()
    assert len(strange) == 7 and all((r.n_words_in, r.label, r["_rid"]) == (None, "L", "r") for r in strange)


def whole_match(word, first, later):
    at = next((e for e in range(len(word), 0, -1) if word[:e] in first), 0)
    count = 1
    while at < len(word):
        count, at = count + 1, next((e for e in range(len(word), at, -1) if word[at:e] in later), at + 1)
    return count


def test_whole_counts_equal_longest_match_on_random_vocabularies():
    rng = random.Random(23)
    for _ in range(200):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        pieces |= {b" " + bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6))}
        automaton, (first, later) = Automaton(pieces, whole=True), split_vocabulary(pieces)
        for _ in range(40):
            word = bytes(rng.choices(b"abcd", weights=[5, 5, 5, 1], k=rng.randint(1, 9)))
            assert automaton.count(word) == whole_match(word, first, later), (pieces, word)


def test_lengths_of_words_that_no_piece_begins(spark):
    texts = ["中文沒有空格所以很長" * 100, "한국어 문장 입니다", "этот юг яркий щит рядом чай", "plain words", "\U0001f600\U0001f680", None]
    first, later = split_vocabulary(vocabulary(PIECES))
    rows = [(i, t, "xx", "s", 0) for i, t in enumerate(texts)]
    found = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(frame(spark, rows), PIECES, whole=True).collect()}
    assert found == {i: (len(w), sum(whole_match(x, first, later) for x in w)) for i, w in enumerate((t or "").encode().split() for t in texts)}
    assert found[0][1] >= 500 and found[1][1] > 3 and found[2][1] > 6


def test_packing_counts_such_words_whole(spark, tmp_path):
    import corpus_pipeline
    from lakecurator.llm import queries

    spark.createDataFrame([(i, "中文沒有空格所以很長" * 300, "zh", "s", 3000) for i in range(20)] + [(99, "short", "en", "s", 5)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for found in (queries.op7_optimal_length_buckets(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        rows = found.collect()
        sizes = {}
        for r in rows:
            sizes.setdefault((r.bucket, r.batch), []).append(r.bucket_len)
        assert len(rows) == 21 and all(sum(x) <= 16_384 or len(x) == 1 for x in sizes.values())
        assert all(r.n_tokens > 1_000 for r in rows if r.doc_id != 99)


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        lengths, counts = sorted(rng.sample(range(40), n)), [rng.randint(1, 9) for _ in range(n)]
        buckets = rng.randint(1, 5)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))

        from itertools import combinations

        best = min(padding([*some, lengths[-1]]) for k in range(min(buckets, n)) for some in combinations(lengths[:-1], k))
        found = boundaries(lengths, counts, buckets)
        assert len(found) <= buckets and found[-1] == lengths[-1] and padding(found) == best
    assert boundaries([], [], 3) == []


def test_padding_is_least_over_every_length(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([3, 40, 2047, 2049, 2050, 5001, 5003, 70000, 70001])) for i in range(200)]
    found = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=5).toPandas()
    lengths = sorted({n for _, n in rows})
    from itertools import combinations

    least = min(sum(min(b for b in (*some, lengths[-1]) if b >= n) - n for _, n in rows) for some in combinations(lengths[:-1], 4))
    assert found.padding.sum() == least


def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 5, 30, 31, 200, 5000, 70000])) for i in range(500)] + [(None, 3), (7, 30), (7, 30), (501, None)]
    found = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=4, budget=4096).toPandas()
    assert len(found) == len(rows) and found.bucket.nunique() <= 4
    assert (found.padding >= 0).all() and (found.bucket_len - found.n_tokens == found.padding).all()
    for (bucket, batch), part in found.groupby(["bucket", "batch"]):
        assert sorted(part.place) == list(range(len(part)))
        assert len(part) * part.bucket_len.iloc[0] <= 4096 or len(part) == 1
        if batch < found[found.bucket == bucket].batch.max():
            assert len(part) == max(1, 4096 // max(1, part.bucket_len.iloc[0]))
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_encoder_equals_the_library():
    path = tokenizer_file("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), encoder(open(path, encoding="utf-8").read(), 2)
    rng = random.Random(6)
    texts = [t or "" for _, t, *_ in corpus(7, 30)] + ["".join(rng.choices("ab '\n\t  \x1c\x85 's12é!.<|", k=30)) for _ in range(3000)]
    for text, ids in zip(texts, encode(texts)):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text


@pytest.mark.parametrize("shard_bytes", [2000, 1 << 24])
def test_token_files_round_trip(spark, shard_bytes):
    path = tokenizer_file("byte_bpe_50k.json")
    description, tokenizer, rows = open(path, encoding="utf-8").read(), Tokenizer.from_file(path), corpus(2, 40)
    random.Random(1).shuffle(rows)
    folder = write_token_files(frame(spark, rows), description, 2, shard_bytes=shard_bytes)
    found = {r.doc_id: r for r in read_token_files(spark, folder).collect()}
    start = 0
    for i, text, *_ in sorted(rows):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (found[i].start, found[i].n_tokens, zlib.crc32(found[i].ids)) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    local = folder.removeprefix("file:")
    assert not [x for x in os.listdir(local) if x.startswith(".") and not x.endswith(".crc")]
    manifest = json.load(open(f"{local}/manifest.json"))
    assert (len(manifest["shards"]) > 3) == (shard_bytes == 2000)
    again = write_token_files(frame(spark, rows, partitions=5), description, 2, shard_bytes=shard_bytes)
    for name in os.listdir(local):
        assert open(f"{local}/{name}", "rb").read() == open(f"{again.removeprefix('file:')}/{name}", "rb").read()


def test_token_files_of_odd_tables(spark):
    description = open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8").read()
    found = read_token_files(spark, write_token_files(odd(spark), description, 2)).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, None, 7, 7, 7, 8, 9] and found[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(found, found[1:]))
    assert read_token_files(spark, write_token_files(frame(spark, []), description, 2)).count() == 0
