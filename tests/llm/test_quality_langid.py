import random
import zlib

import numpy as np

from tidewise.llm import gbt, quality
from tidewise.llm.langid import Encoder, identify


def doc(rng, good):
    words = [rng.choice(["river", "stone", "green", "house", "walks", "evening", "under", "slowly", "paper", "music", "a", "the", "of"]) for _ in range(rng.randint(20, 80))]
    return " ".join(words).capitalize() + "." if good else "!! ".join(w.upper() for w in words[:5] * 8)


def test_trees_learn_and_survive_nothing():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = gbt.fit(x[:1500], y[:1500])
    assert ((trees.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert np.isfinite(gbt.fit(np.ones((50, 2)), np.ones(50)).probability(np.ones((1, 2)))).all()


def test_statistics_of_odd_texts():
    for t in ("", " ", "\n\n", "é🙂", "x" * 3_000_000, "a\x00b", "| a | b |\n" * 50):
        found = quality.statistics(t)
        assert len(found) == len(quality.FEATURES) and np.isfinite(found).all()


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, doc(rng, i % 3 != 0)) for i in range(900)]
    docs = spark.createDataFrame([*((i, t, "en", 5.0) for i, t in rows), (None, None, None, 0.0), (9000, "", None, 0.0), (9000, "", None, 0.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([*((i, int(i % 3 != 0)) for i in range(800)), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 903
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.classify(docs.where("false"), labels).count() == 0
    assert quality.classify(docs, labels.where("false")).count() == 903
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert kept.where("doc_id < 900 and score <> 5.0").count() == 0  # a column of that name is the table's own


def test_labels_of_held_out_rows_teach_nothing(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, doc(rng, i % 2 == 0)) for i in range(300)], "doc_id long, text string")
    true = [(i, int(i % 2 == 0)) for i in range(300)]
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in true]
    a, b = (sorted(map(tuple, quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect())) for x in (true, wrong))
    assert a == b


WORDS = {"en": "the and of that with this house water never", "de": "und der nicht ein schön straße wasser größe ich", "ru": "и не что это вода дом никогда улица красивый"}


def test_bundles_are_sums_of_bound_vectors():
    e = Encoder()
    vectors, n = e.bundles(["ab", "", "12 !", "Ab"])
    want = sum(np.roll(e.letters[a], 0).astype(int) * np.roll(e.letters[b], 1) * np.roll(e.letters[c], 2) for a, b, c in ((0, 97, 98), (97, 98, 0)))
    assert (vectors[0] == want).all() and (vectors[3] == want).all() and n.tolist() == [2, 0, 0, 2] and not vectors[1].any()


def test_languages_of_held_out_rows(spark):
    rng = random.Random(3)
    rows = [(i, lang, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(4, 40)))) for i in range(400) for lang in [rng.choice(list(WORDS))]]
    extra = [(1000, "en", None), (1001, None, "123 !?"), (1002, "en", ""), (None, None, "the house and the water"), (None, None, "the house and the water"), (1003, None, "und der " * 20_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows + extra], "doc_id long, lang string, text string, score string")
    got = identify(docs).collect()
    true = {i: lang for i, lang, _ in rows}
    held = [r for r in got if r.held_out and r.doc_id in true]
    assert len(got) == 406 and held and sum(r.lang_pred == true[r.doc_id] for r in held) / len(held) > 0.97
    odd = [r for r in got if r.doc_id not in true]
    assert sorted((str(r.doc_id), r.lang_pred) for r in odd) == [("1000", "und"), ("1001", "und"), ("1002", "und"), ("1003", "de"), ("None", "en"), ("None", "en")]
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in identify(docs.where("lang is null")).collect()} == {"und"}
