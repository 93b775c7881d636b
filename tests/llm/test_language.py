import random

import numpy as np

from voxlake.llm.language import KernelClassifier, _grams, fit, fold, identify

rng = random.Random(4)
PARTS = {"aa": ["ka", "lo", "mi", "tun"], "bb": ["sch", "ein", "ber", "lo"], "cc": ["été", "eau", "oi", "mi"]}


def text(lang, n=40):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


ROWS = [(i, text(lang), lang, lang) for i in range(240) for lang in [sorted(PARTS)[i % 3]]]


def frame(spark, rows):
    return spark.createDataFrame([(*r[:3], "clash", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_held_out_languages_are_found(spark):
    docs = frame(spark, ROWS)
    model = fit(docs.where(fold(docs["doc_id"]) != 2), sample_rows=60)
    held = identify(docs.where(fold(docs["doc_id"]) == 2), model, keep=["doc_id", "lang"]).collect()
    assert len(held) > 30 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in held)


def test_folded_weights_give_the_kernel_expansion():
    texts, labels = [r[1] for r in ROWS[:30]], [r[2] for r in ROWS[:30]]
    model = KernelClassifier(texts, labels, landmarks=30)
    sets = [set(_grams(t).tolist()) for t in texts]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    y = np.where(np.array(labels)[:, None] == np.array(model.languages), 1.0, -1.0)
    want = k @ np.linalg.solve(k.T @ k + 1e-3 * 30 * k + 1e-8 * np.eye(30), k.T @ y)
    assert np.abs(model.score(texts) - want).max() < 0.02


def test_texts_without_letters_are_undetermined(spark):
    model = fit(frame(spark, ROWS))
    docs = frame(spark, [(1, None, "aa"), (2, "", "aa"), (3, "12 !!", None), (None, text("bb"), None), (4, text("aa", 60_000), "bb"), (4, text("cc"), "cc"), (4, text("cc"), "cc"), (5, "日本", None)])
    out = identify(docs, model).collect()
    assert [r["lang_pred"] for r in out][:7] == ["und", "und", "und", "bb", "aa", "cc", "cc"] and out[7]["lang_pred"] in PARTS
    assert [r["score"] for r in out][:3] == [0, 0, 0] and set(out[0].asDict()) == {"doc_id", "text", "lang", "lang_pred", "score"}


def test_nothing_to_learn_from_and_nothing_to_say(spark):
    none = frame(spark, [])
    assert fit(none) is None and fit(frame(spark, [(1, "text", None), (2, None, "aa"), (3, "77", "aa")])) is None
    assert identify(none, None).collect() == []
    assert [r["lang_pred"] for r in identify(frame(spark, ROWS[:2]), None).collect()] == ["und", "und"]


def test_folds_follow_the_checksum_of_the_id(spark):
    import zlib

    docs = frame(spark, ROWS)
    got = {r[0]: r[1] for r in docs.select("doc_id", fold(docs["doc_id"])).collect()}
    assert all(v == zlib.crc32(str(k).encode()) % 4 for k, v in got.items())


def test_copies_change_neither_the_sample_nor_the_languages(spark):
    once = [(i, t, lang) for i, (_, t, lang, _) in enumerate(ROWS[:90])]
    often = once + [(1000 + i, ROWS[0][1], "aa") for i in range(6000)] + [(9000 + i, ROWS[1][1], "bb") for i in range(3000)]
    plain, copied = (fit(frame(spark, rows), sample_rows=30) for rows in (once, often))
    assert plain.languages == copied.languages == sorted(PARTS) and np.array_equal(plain.weights, copied.weights)


def test_a_language_of_one_text_in_many_copies_is_a_class(spark):
    rows = [(i, ROWS[i % 2][1], "aa" if i % 2 == 0 else "bb") for i in range(4000)]
    model = fit(frame(spark, rows), sample_rows=4)
    assert model is not None and model.languages == ["aa", "bb"]
    found = identify(frame(spark, rows[:2]), model).collect()
    assert [r["lang_pred"] for r in found] == ["aa", "bb"]


def test_the_pipeline_keeps_documents_when_no_language_is_labelled(spark):
    from corpus_pipeline import language

    docs = spark.createDataFrame([(1, "some text", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in language(spark, docs, "").collect()] == [1]
