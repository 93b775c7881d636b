import random
from collections import defaultdict

import pytest

from voxlake.llm.suffix_dedup import runs, without_repeats


def brute(rows, length):
    seen = defaultdict(int)
    raw = [(k, (t or "").encode()) for k, t in rows]
    for _, b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for k, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        out.append((k, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def run(spark, rows, length, **more):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, d1 int, spans string, row int").repartition(3)
    out = without_repeats(docs, length=length, **more).collect()
    for r in out:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in out), key=repr)


def corpus():
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [prose(n) for n in (60, 120, 300, 61)]
    rows = []
    for i in range(50):
        parts = [prose(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            parts += [p[a : len(p) - rng.randint(0, 20)], prose(rng.randint(0, 90))]
        rows.append("".join(parts))
    near = prose(500)
    rows += [near, near[:250] + "X" + near[251:], near[30:], rows[3], rows[3], "a" * 300, "ab" * 90, "a" * 49, "a" * 50, "", None, None, "é" * 100]
    return list(enumerate(rows)) + [(3, rows[3]), (None, "no id " * 3), (None, near[100:200])]


@pytest.mark.parametrize(("length", "gram", "hot"), [(50, 12, 1024), (50, 12, 2), (17, 8, 1024)])
def test_bytes_match_brute_force(spark, length, gram, hot):
    rows = corpus()
    assert run(spark, rows, length, gram=gram, hot_runs=hot) == brute(rows, length)


def test_production_lengths_and_long_texts(spark):
    rng = random.Random(2)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = prose(700)
    rows = [(1, prose(900) + shared + prose(30)), (2, prose(100) + shared), (3, shared[150:549]), (4, shared[150:551]), (5, prose(30_000))]
    assert run(spark, rows, 400) == brute(rows, 400)


def test_every_suffix_is_in_one_run():
    rng = random.Random(4)
    for n in (0, 49, 50, 51, 700, 5000):
        data = bytes(rng.choice(b"abc") for _ in range(n))
        found = runs(data, 50, 12)
        starts = [s + i for s, m in zip(found[2], found[3]) for i in range(m)] if found else []
        assert starts == list(range(max(0, n - 49)))


def test_empty_table(spark):
    assert run(spark, [], 400) == []
