import random

import pytest

from voxlake.llm.decontaminate import WuManber, contamination

SCHEMA = "doc_id long, text string, items string, word long"


def brute(docs, items, size):
    keep = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in t or "").split(" ")
    words = lambda t: [w for w in keep(t) if w]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, it in items:
            iw = words(it)
            for i in range(max(1, len(iw) - size + 1)) if iw else ():
                window = iw[i : i + size]
                for j in range(len(w) - len(window) + 1):
                    if w[j : j + len(window)] == window:
                        hit |= set(range(j, j + len(window)))
                        found |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def both(spark, docs, items, size=4, **more):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(d, b, window=size, **more).collect()
    for r in rows:
        assert r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"])
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows), key=repr)
    assert got == brute(docs, items, size)
    return got


@pytest.mark.parametrize("block", [100_000, 7])
def test_random_texts_match_brute_force_in_one_block_and_in_many(spark, block):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "bb", "the", "of", "Stern", "été", "x9", "long-er", "7"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(1, 9))) for i in range(12)] + [(5, "the of"), (None, "of bb bb"), (40, None), (41, "--"), (42, "")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (61, ""), (None, "the of the"), (62, "THE/of\nthe")]
    got = both(spark, docs, items, block_windows=block)
    assert any(x[2] for x in got) and any(not x[2] for x in got)


def test_long_text_and_repeats_across_segments(spark):
    long = "lorem ipsum dolor sit " * 40_000
    got = both(spark, [(1, long[:22_000] + "needle in hay here " + long[:8_800]), (2, "q" * 300_000)], [(7, "needle in hay here"), (8, "q" * 300_000)])
    assert [x[3] for x in got] == [["7"], ["8"]]


def test_matches_do_not_cross_documents(spark):
    assert [x[2] for x in both(spark, [(1, "one two"), (2, "three four")], [(1, "one two three four")])] == [0, 0]


def test_empty_tables(spark):
    assert both(spark, [(1, "a b")], []) == [(1, 2, 0, [])]
    assert both(spark, [], [(1, "a b")]) == []


def test_search_finds_every_pattern_of_every_length():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab ") for _ in range(20_000))
    patterns = sorted({data[i : i + n] for n in (1, 2, 3, 5, 9, 17, 40, 200) for i in rng.sample(range(19_000), 5)})
    at, which = WuManber(patterns).find(data)
    want = {(i, k) for k, p in enumerate(patterns) for i in range(len(data)) if data.startswith(p, i)}
    assert set(zip(at.tolist(), which.tolist())) == want and len(at) == len(want)
