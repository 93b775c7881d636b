import random

import numpy as np

from voxlake.llm.cotraining import _line, features, quality_scores, word_shapes

rng = random.Random(7)
WORDS = ["alpha", "Beta", "gamma", "of", "the", "été"]


def text(good, n):
    words = [rng.choice(WORDS) for _ in range(n)]
    return " ".join(words if good else [w.upper() + "!!" for w in words])


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, label double, shape string").repartition(3)


ROWS = [(i, text(i % 3 != 0, rng.randint(20, 90)), "xx", "clean" if i % 3 else "spam", 100) for i in range(600)]


def labels(spark, ids):
    return spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in ids], "doc_id long, quality int, toxic int")


def test_unlabelled_documents_are_told_apart(spark):
    out = quality_scores(docs(spark, ROWS), labels(spark, range(0, 200))).collect()
    assert len(out) == 600 and all(r["kept"] == (r["doc_id"] % 3 != 0) and 0 <= r["score"] <= 1 for r in out)


def test_one_view_teaches_the_other(spark):
    """Few labels, and none for the source `late`: the text view's sure rows teach the metadata view what it is worth."""
    rows = [(i, t, x, "late" if i >= 300 and i % 3 == 0 else s, n) for i, t, x, s, n in ROWS]
    given = labels(spark, range(0, 150))
    alone = {r["doc_id"]: r for r in quality_scores(docs(spark, rows), given, rounds=0).collect()}
    taught = {r["doc_id"]: r for r in quality_scores(docs(spark, rows), given, rounds=2).collect()}
    assert taught[303]["p_metadata"] < 0.5 < alone[303]["p_metadata"] + 0.5 and taught[303]["p_metadata"] < alone[303]["p_metadata"]


def test_odd_rows(spark):
    rows = ROWS + [(1000, None, None, None, None), (1001, "", "", "", -5), (None, text(True, 30), "xx", "clean", 10), (1002, text(True, 200_000), "xx", "clean", 10), (1, ROWS[1][1], "xx", "clean", 100)]
    given = labels(spark, range(0, 200)).union(spark.createDataFrame([(1, None, 0), (1, 0, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int"))
    out = quality_scores(docs(spark, rows), given).collect()
    assert len(out) == len(rows) and all(r["kept"] for r in out if r["doc_id"] in (None, 1002))
    seen = features(docs(spark, rows), given, doc_id="doc_id", text="text", quality="quality").collect()
    assert {r["label"] for r in seen if r["doc_id"] == 1} == {1} and {r["label"] for r in seen if r["doc_id"] in (None, 1000)} == {None}


def test_nothing_to_learn_from(spark):
    none = labels(spark, [])
    assert all(r["kept"] for r in quality_scores(docs(spark, ROWS[:9]), none).collect())
    assert quality_scores(docs(spark, []), none).collect() == []


def test_shapes_and_calibration():
    assert word_shapes(b"Alpha, beta!! 42% GAMMA|") == {b"Aa,": 1, b"a!": 1, b"0%": 1, b"A|": 1} and not word_shapes(b"")
    assert word_shapes(b"so so so")[b"again"] == 8
    x = np.linspace(-3, 3, 61)
    p = 1 / (1 + np.exp(-(2 * x - 1)))
    a, b = _line(x, 1000 * p, 1000 * (1 - p))
    assert abs(a - 2) < 0.01 and abs(b + 1) < 0.01


def test_vocabulary_alone_tells_apart(spark):
    """All words are five small letters and the metadata are the same; a third of a bad document's words are of another kind."""
    usual, bad = (["".join(rng.choice(letters) for _ in range(5)) for _ in range(n)] for letters, n in (("abcdefgh", 200), ("mnopqrst", 40)))
    rows = [(i, " ".join(rng.choice(bad if i % 3 == 0 and rng.random() < 0.33 else usual) for _ in range(60)), "xx", "s", 100) for i in range(600)]
    out = quality_scores(docs(spark, rows), labels(spark, range(0, 300))).collect()
    assert sum(r["kept"] == (r["doc_id"] % 3 != 0) for r in out) >= 590


def test_words_are_coded_and_read_again():
    from voxlake.llm.cotraining import WORDS, hashed_words, word_buckets

    texts = [b"", b"one", "Zwei wörter, zwei Wörter".encode(), b"  ", b" ".join(b"w%d" % i for i in range(5000))]
    row, bucket = word_buckets([hashed_words(t) for t in texts])
    assert np.bincount(row, minlength=5).tolist()[:4] == [0, 1, 4, 0] and 9000 < (row == 4).sum() < 9999
    assert bucket.min() >= 0 and bucket.max() < WORDS and all((np.diff(bucket[row == r]) > 0).all() for r in range(5))


def test_labels_are_drawn_and_features_stay_where_they_are(spark):
    """More labels than asked for: about so many are drawn, whatever the type of the ids, and the rest still get a score."""
    given = labels(spark, range(0, 400))
    drawn = features(docs(spark, ROWS), given, doc_id="doc_id", text="text", quality="quality", labelled=100).where("label is not null").collect()
    assert 60 < len(drawn) < 140 and all(r["label"] == int(r["doc_id"] % 3 != 0) for r in drawn)
    out = quality_scores(docs(spark, ROWS), given, labelled=150).collect()
    assert len(out) == 600 and sum(r["kept"] == (r["doc_id"] % 3 != 0) for r in out) >= 590
    narrow = given.selectExpr("cast(doc_id as int) doc_id", "quality", "toxic")
    seen = features(docs(spark, ROWS), narrow, doc_id="doc_id", text="text", quality="quality")
    assert seen.where("label is not null").count() == 400
