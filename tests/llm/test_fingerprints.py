import hashlib
import random

import numpy as np
import pytest

from voxlake.llm.fingerprints import LONGEST, SHORTEST, containment, cuts, edited, fingerprint, fingerprints, from_text

rng = random.Random(8)
PROSE = ["".join(rng.choice("abcdefgh éü") for _ in range(rng.randint(0, 3000))) for _ in range(40)]


def test_chunks_cover_the_text_within_their_bounds():
    for text in (*PROSE, "a" * 5000, "x"):
        data = text.encode()
        ends = cuts(data)
        sizes = np.diff(np.concatenate([[0], ends]))
        assert sizes.sum() == len(data) and (sizes <= LONGEST).all() and (sizes[:-1] >= SHORTEST).all()


def test_an_insertion_moves_few_chunks():
    for text in (x for x in PROSE if len(x) > 1500):
        own = fingerprint(text.encode())
        assert containment(own, fingerprint(("zz" + text).encode())) > 0.8
        assert containment(own, fingerprint((text[:700] + "inserted" + text[700:]).encode())) > 0.7


def test_containment_of_nothing():
    none, some = fingerprint(b""), fingerprint(b"some text")
    assert containment(none, none) == 1 and containment(none, some) == 0 and containment(some, none) == 0


@pytest.mark.parametrize("per_bucket", [5, 1000])
def test_every_row_meets_the_next_one(spark, per_bucket):
    rows = [(i * 3, t) for i, t in enumerate(PROSE)] + [(500, None), (501, ""), (502, "x"), (502, "x"), (502, "second"), (None, "no id"), (None, "none either"), (503, "é" * 200_000)]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, _bucket int, _guest boolean").repartition(3)
    out = fingerprints(docs, per_bucket=per_bucket).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in out) == sorted((str(k), len(t or "")) for k, t in rows)
    texts = sorted({k for k, _ in rows if k is not None} - {502}, reverse=True)
    by_id = {k: t or "" for k, t in rows}
    got = {r["doc_id"]: r for r in out}
    for a, b in zip(texts, texts[1:]):
        if b != 501 and a != 503:
            changed = edited(by_id[a], by_id[b])
            assert got[a]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            assert got[a]["near_edited"] == containment(from_text(got[a]["fingerprint"]), from_text(got[a]["edited_fingerprint"]))
            assert got[a]["near_next"] == containment(fingerprint(by_id[a].encode()), fingerprint(by_id[b].encode()))
    assert len({r["fingerprint"] for r in out if r["doc_id"] == 502 and r["n_chars"] == 1}) == 1
    ends = {hashlib.sha256(edited(x, by_id[503]).encode()).hexdigest() for x in ("no id", "none either")}
    assert ends & {r["edited_sha256"] for r in out if r["doc_id"] is None}  # after the last row comes the first


def test_one_row_and_none(spark):
    one = fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_of_any_type(spark):
    rows = [(f"id{i:04d}", f"text number {i} " * (i % 5)) for i in range(300)] + [("hot", f"again {i}") for i in range(150)] + [(None, "none")]
    out = fingerprints(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), per_bucket=20).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in out) == sorted((str(k), len(t)) for k, t in rows)
    texts = dict(rows)
    got = {r["doc_id"]: r["edited_sha256"] for r in out}
    for i in range(1, 300):
        changed = edited(texts[f"id{i:04d}"], texts[f"id{i - 1:04d}"])
        assert got[f"id{i:04d}"] == hashlib.sha256(changed.encode()).hexdigest()
