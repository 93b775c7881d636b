import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from voxlake.llm import collocations as module
from voxlake.llm.collocations import collocations

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, top, covered):
    out = []
    for lang in {x or "und" for x, _ in rows}:
        f = Counter()
        for x, text in rows:
            if (x or "und") == lang:
                for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(SMALL)):
                    w = [v for v in re.split("[ \t]+", piece) if v]
                    f.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        f = {p: c for p, c in f.items() if c >= least}
        found = []
        for p, a in f.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if len(p) > 1 and not any(len(q) > len(p) and inside(q) and 100 * c >= covered * a for q, c in f.items()):
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, x, "p", 3) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, f int").repartition(3)
    return sorted(tuple(r) for r in collocations(docs, **more).collect())


def corpus(seed):
    rng = random.Random(seed)
    words = [f"{c}{i}" for c in "aÉñ" for i in range(12)] + ["The", "OF"]
    rows = []
    for i in range(90):
        lang = rng.choice(["de", "de", "de", "en", None, "und"])
        w = [rng.choice(words[: 8 + 3 * rng.randrange(10)]) for _ in range(rng.choice([0, 1, 5, 40]))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice([["the", "end", "of", "it", "all", "now"], ["ha"] * rng.randrange(1, 9), ["rare", "pair"], ["é", "É"]])
        rows.append((lang, rng.choice([" ", "  ", "\t"]).join(x + rng.choice(["", "", "", "", ".", "\n", "!?"]) for x in w)))
    return rows + [("de", None), ("en", ""), (None, " \t"), ("xx", "lonely"), ("de", rows[0][1])]


@pytest.mark.parametrize(("seed", "least", "longest", "top", "covered"), [(1, 4, 5, 2000, 100), (2, 3, 5, 6, 100), (3, 5, 4, 3, 60)])
def test_equals_brute_force(spark, monkeypatch, seed, least, longest, top, covered):
    monkeypatch.setattr(module, "OPENING", 2)  # many rounds, so that bounds end some of them
    monkeypatch.setattr(module, "SLICE_BYTES", 700)
    rows = corpus(seed)
    got = run(spark, rows, least=least, longest=longest, top=top, covered=covered)
    assert got == brute(rows, least, longest, top, covered) and len(got) > 5


def test_growth_stops_when_the_last_row_is_settled(spark, monkeypatch):
    """Words whose bound is below the last score are never grown."""
    monkeypatch.setattr(module, "OPENING", 2)
    grown = []
    real = module._hashed
    monkeypatch.setattr(module, "_hashed", lambda phrases, about: (grown.extend(r["phrase"] for r in phrases.collect()) if about == module._GROW else None, real(phrases, about))[1])
    rows = [("de", "rare pair")] * 5 + [("de", "twin word")] * 5 + [("de", f"common x{i} common y{i}") for i in range(400)]
    assert [r[2] for r in run(spark, rows, least=5, top=2)] == ["rare pair", "twin word"]
    assert "rare" in grown and "common" not in grown


def test_scores_beyond_64_bits(spark):
    table = lambda rows, columns: spark.createDataFrame(rows, columns)
    big = 10**15
    phrases = table([("de", "a b", 2, big)], "lang string, phrase string, words int, f long")
    counts = table([("de", "a", 1, 3 * big), ("de", "b", 1, 2 * big), ("de", "a b", 2, big)], "lang string, phrase string, words int, f long")
    got = module._scored(phrases, counts, table([("de", 7 * big + 1)], "lang string, n long")).collect()
    assert [r["score"] for r in got] == [1000 * big * (7 * big + 1) // (6 * big * big)]


def test_empty_table_and_one_long_text(spark):
    assert run(spark, []) == [] and run(spark, [(None, None)]) == []
    rows = [("en", "one two " * 60_000)]
    assert run(spark, rows) == brute(rows, 100, 5, 2000, 100)


def test_phrases_leave_a_slice_in_bounded_shares(spark, monkeypatch):
    """However many phrases a slice has, their texts are not taken out all at once."""
    schema = "lang string, phrase string, words int, number long"

    class Docs:
        def mapInArrow(self, scan, kind):
            self.scan = scan
            return spark.createDataFrame([], schema)

    docs, texts = Docs(), [" ".join(f"word{i}" for i in range(k, k + 3000)) for k in (0, 500)] + ["x" * 5000 + " y"]
    module._counted(docs, module._each_word, 0)
    monkeypatch.setattr(module, "PHRASE_BYTES", 4096, raising=False)
    batches = list(docs.scan(iter([pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(texts)], ["lang", "text"])])))
    got = [r for b in batches for r in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
    assert Counter(dict(got)) == Counter(" ".join(texts).split()) and len(got) == len(dict(got))
    assert all(sum(map(len, b.column(1).to_pylist())) <= 4096 or b.num_rows == 1 for b in batches)
