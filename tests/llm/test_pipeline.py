import random
from collections import defaultdict

import numpy as np
import test_decontaminate
import test_near_dedup
import test_suffix_dedup
from tokenizers import Tokenizer

import corpus_pipeline
from voxlake.llm.queries import word_tokenizer

rng = random.Random(12)
WORDS = [a + b for a in ("ka", "lo", "mi", "tun", "sch", "éte") for b in ("ra", "ne", "so", "vi", "x")]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    item, shared, base = prose(20), prose(120), prose(150)
    texts = [prose(rng.randint(1, 200)) for _ in range(25)]
    texts += [base, base, base + " more", base[:300] + "é" + base[300:], f"{prose(40)} {item} {prose(9)}", f"{prose(30)} {shared} {prose(30)}", f"{prose(50)} {shared} {prose(20)}"]
    texts += ["", "123 456 !!", None, "-", "one word", "q" * 900]
    rng.shuffle(texts)
    return list(enumerate(texts)), [(1, item), (2, prose(12)), (3, None)]


def test_every_stage_matches_brute_force(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "suffix_dedup", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None

    def step(k, frame):
        out = corpus_pipeline.STAGES[k][1](spark, frame, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        return spark.read.parquet(str(tmp_path / f"stage{k}"))

    now = step(0, spark.read.parquet(str(tmp_path / "documents.parquet")))
    want = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == want and now.columns == docs.columns

    now = step(1, now)
    kept = {r[0] for r in test_near_dedup.brute(want, 5) if r[3]}
    want = [x for x in want if x[0] in kept]
    assert len(kept) < len(rows) - 5 and sorted((r["doc_id"], r["text"]) for r in now.collect()) == want

    now = step(2, now)
    cut = test_suffix_dedup.brute(want, 400)
    want = sorted((r[0], r[4].decode("utf-8", "ignore")) for r in cut)
    assert any(r[2] for r in cut) and sorted((r["doc_id"], r["text"]) for r in now.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect())

    now = step(3, now)
    clean = {r[0] for r in test_decontaminate.brute(want, items, 10) if not r[2]}
    want = [x for x in want if x[0] in clean]
    assert len(clean) < len(cut) and sorted((r["doc_id"], r["text"]) for r in now.collect()) == want

    pieces = defaultdict(list)
    for r in step(4, now).collect():
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    library = Tokenizer.from_file(word_tokenizer())
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for i, t in want}
    assert {k: b"".join(x for _, x in sorted(v)) for k, v in pieces.items()} == ids
