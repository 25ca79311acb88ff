import collections
import random

import corpus_pipeline
import pytest

from .corpora import DOCS, frame, odd, sentences
from .test_text_ops import hits, linked, removed


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(31)
    passage, item = sentences(rng, 60), sentences(rng, 40)
    texts = [sentences(rng, rng.randint(60, 150)) for _ in range(160)]
    for i in range(0, 160, 8):  # bad texts
        texts[i] = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in texts[i].split(" "))
    texts[3], texts[5] = f"{texts[3]}\n{passage} end", f"{passage} {texts[5]}"
    texts[9] = f"{texts[9]} {item} tail"
    texts += [texts[1], texts[2] + " more"]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if i < 160 and i % 8 == 0 else 1, 0) for i in range(162)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "unrelated words of no text at all but many of them to fill")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, item


def test_every_stage_decides(spark, tables, tmp_path):
    folder, rows, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS, name
        kept[k] = {r.doc_id: r for r in docs.collect()}
        inputs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in before.values()] if k < 4 else []
        if k == 0:
            good = {i for i in range(160) if i % 8}
            assert len(good - set(kept[0])) <= 2 and len(set(range(0, 160, 8)) & set(kept[0])) <= 2
            assert all(kept[0][i] == before[i] for i in kept[0])
        elif k == 1:
            assert set(kept[1]) == {i for i, (_, c, keep) in linked(inputs, 5).items() if keep}
            assert 160 not in kept[1] and 161 not in kept[1]
        elif k == 2:
            expected = {d: (n, text) for d, _, n, text in removed(inputs, 35)}
            assert set(kept[2]) == set(before)
            for i, r in kept[2].items():
                n, text = expected[i]
                assert r.text == (text if n else before[i].text or "") and r.n_chars == (len(text) if n else before[i].n_chars)
            assert len(before[3].text) - len(kept[2][3].text) > 200
        elif k == 3:
            bad = {d for d, *_, contaminated in hits(inputs, [(1, item)]) if contaminated}
            assert bad == {9} and set(kept[3]) == set(before) - bad
        else:
            assert set(kept[4]) == set(before)


def test_run_returns_the_last_stage(spark, tables):
    folder, rows, _ = tables
    found = corpus_pipeline.run(spark, folder).toPandas()
    assert {"doc_id", "n_tokens", "bucket", "batch", "place"} <= set(found.columns) and 100 < len(found) < len(rows)


def test_one_row_of_each_group_is_kept(spark):
    rng = random.Random(6)
    alone, near, pair = (sentences(rng, 80) for _ in range(3))
    rows = [(None, alone, "en", "s", 1), (None, near, "en", "s", 2), (4, near + " more", "en", "s", 3), (3, near, "en", "s", 4), (None, pair, "en", "s", 5), (None, pair + " more", "en", "s", 6), (5, sentences(rng, 80), "en", "b", 7)]
    rows += [(5, rows[-1][1], "en", "a", 7)] * 2 + [(5, sentences(rng, 80), "en", "c", 8)]
    found = corpus_pipeline.one_of_each(spark, frame(spark, rows), "").collect()
    ends = collections.Counter(r.n_chars for r in found)
    assert ends.pop(5, 0) + ends.pop(6, 0) == 1 and ends == {1: 1, 4: 1, 7: 1, 8: 1}
    assert [r.source for r in found if r.n_chars == 7] == ["a"]


def stages_on_odd(spark, folder, item):
    """What the stages after the classifier, which drops by quality, leave of odd()."""
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = odd(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        yield docs


def test_stages_of_odd_tables(spark, tmp_path):
    text = odd(spark).where("doc_id = 7 and n_chars = 3").first().text
    stages = list(stages_on_odd(spark, str(tmp_path), "words of no row"))
    for docs in stages[:3]:
        assert collections.Counter((r.doc_id, r.text or "") for r in docs.collect()) == {(7, text): 1, (7, "another text"): 1, (None, ""): 1, (8, ""): 1, (9, ""): 1}
    assert collections.Counter(r.doc_id for r in stages[3].collect()) == {7: 2, None: 1, 8: 1, 9: 1}


def test_contaminated_rows_are_dropped_singly(spark, tmp_path):
    rng = random.Random(9)
    item = sentences(rng, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [item + " tail", "a clean text", item + " end", "another clean text", item + " last"]
    rows = [(i, t, "en", "s", k) for k, (i, t) in enumerate(zip([None, None, 7, 7, 8], texts))] + [(7, texts[2], "en", "s", 5)]
    found = corpus_pipeline.uncontaminated(spark, frame(spark, rows), str(tmp_path))
    assert found.columns == corpus_pipeline.COLUMNS
    assert sorted((r.n_chars, r.doc_id) for r in found.collect()) == [(1, None), (3, 7)]


def test_classifier_stage_of_odd_and_empty_tables(spark, tmp_path):
    """Every odd row is judged; without usable labels nothing is sure to be good, and nothing crashes."""
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality(spark, odd(spark), str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() <= 7
    for docs in (odd(spark).limit(0), odd(spark).where("doc_id = 9")):
        assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() <= docs.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
