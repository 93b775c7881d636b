import random

import duckdb
import pytest
from check import compare

from voxlake.functions import similarity
from voxlake.functions.similarity import _alignment
from voxlake.plans import quality
from voxlake.plans.oracle import ORACLE
from voxlake.plans.registry import QUERIES


def brute(a, b):
    """Every cell of the table: (edits, substitutions, deletions, insertions), least edits and then substitutions first."""
    row = [(j, 0, 0, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [(i + 1, 0, i + 1, 0)]
        for j, y in enumerate(b):
            e, s, d, n = row[j]
            hit = row[j] if x == y else (e + 1, s + 1, d, n)
            e, s, d, n = row[j + 1]
            gone = (e + 1, s, d + 1, n)
            e, s, d, n = new[j]
            put = (e + 1, s, d, n + 1)
            new.append(min(hit, gone, put, key=lambda c: c[:2]))
        row = new
    return row[-1][1:]


def test_alignments_equal_the_full_table():
    rng = random.Random(1)
    seen = set()
    for _ in range(400):
        a = [rng.choice("abcde") for _ in range(rng.randrange(14))]
        b = [w for x in a for w in rng.choice([[x], [x], [x], [], [x, rng.choice("abcz")], [rng.choice("xyz")]])]
        got = _alignment(a, b)
        assert got == brute(a, b)
        seen.update(k for k, n in enumerate(got) if n)
    assert seen == {0, 1, 2}


def test_kinds_per_call_with_nulls_and_empty_texts(spark):
    rows = [(1, "one two three four", "one too three for five"), (2, "A b", "a B"), (3, "", "x y"), (4, "x y", ""), (5, None, "x"), (6, "x", None), (7, "w " * 3000, "w " * 2990 + "v")]
    table = spark.createDataFrame(rows, "call_id int, reference string, hypothesis string")
    got = {r["call_id"]: tuple(r)[1:] for r in quality.word_error_kinds(table.select("call_id", "hypothesis"), table.select("call_id", "reference")).collect()}
    assert got[1] == (4, 2, 0, 1, 2) and got[2] == (2, 0, 0, 0, 2) and got[3] == (0, 0, 0, 2, 0) and got[4] == (2, 0, 2, 0, 0)
    assert got[5][1:] == (None,) * 4 and got[6][1:] == (None,) * 4 and got[7] == (3000, 1, 9, 0, 2990)


@pytest.fixture
def few(spark, tmp_path):
    texts = ["a b c d e f g h i j k l m n", "the the the the the the the the the the the the the", "", None, "One two three four five six seven eight. Nine ten eleven twelve thirteen"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), texts


def test_the_query_equals_brute_force(spark, few):
    folder, texts = few
    got = {r["call_id"]: (r["substitutions"], r["deletions"], r["insertions"]) for r in QUERIES["word_error_kinds"](spark, folder).collect()}
    for i, text in enumerate(texts):
        if text is not None:
            words = text.split()
            heard = [w for j, x in enumerate(words) for w in ({3: [x[::-1]], 7: [], 11: [x, "uh"]}.get(j % 12, [x]))]
            assert got[i] == brute([w.lower() for w in words], [w.lower() for w in heard])


def test_citations_beyond_a_call_stay_orphaned_in_long_calls(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t} of the talk about thing {c} and more") for c, n in ((9, 130), (19, 3), (8, 120)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("citation_recheck", "citation_rejections", "citation_pass_rates", "stored_against_recomputed"):
        assert not compare(spark, con, QUERIES[name], ORACLE[name], str(tmp_path))[0], name


def test_alignments_in_a_band_equal_the_full_table(monkeypatch):
    monkeypatch.setattr(similarity, "BAND_WORDS", 0)
    test_alignments_equal_the_full_table()
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randrange(12))] for _ in range(2))
        assert brute(a, b) == _alignment(a, b)
