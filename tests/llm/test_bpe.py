import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxlake.llm.bpe import PairRanks, WordBpe, decoded, encoded, merge_all

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "   ", "Hello  World's\n don't <|endoftext|> x", "ÀÉ naïve 12 ab12 …", "<|startoftext|>a<|endoftext|><|endoftext|>b", "<|ENDOFTEXT|> q",
    "a\xa0b​﻿ cİ \x00\x01 é", "ΑΣ ΣΑΣ'ſ 'S 'LL 're've''s x'start 'd.'m '", "aaaaaaaaa aaaa aa ahahahahaha", "a\x0bb\x85c d\x1ce\x1f",
    "\U0010ffff a\U0010ffffb \U0010ffff<|endoftext|>", " ́e é", "½²Ⅷ१२ 漢字かな한글 🙂👍🏽 히", "ẞßǅ ﬁ Å ẛ̣", "'s's'l 'v 'r 'll' 'lx ''s",
    "word " * 60_000, "x" * 50_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(PATH)


def brute(symbols, ranks):
    """The pair of the least rank first, the leftmost of equal ones."""
    symbols = list(symbols)
    while pairs := [(ranks[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]:
        _, i = min(pairs)
        symbols[i : i + 2] = [ranks[symbols[i], symbols[i + 1]][1]]
    return symbols


def test_merging_equals_one_pair_at_a_time_whatever_the_order_of_ranks():
    rng = random.Random(5)
    names = "abc"
    for turn in range(60):
        pool, merges = list(names), []
        for _ in range(8):
            a, b = rng.choice(pool), rng.choice(pool)
            if a + b not in pool:
                pool.append(a + b)
                merges.append((a, b))
        if turn % 2:
            rng.shuffle(merges)  # a product may come before what it is made of
        number = {x: i for i, x in enumerate(pool)}
        ranks = {(number[a], number[b]): (r, number[a + b]) for r, (a, b) in enumerate(merges)}
        words = [[rng.randrange(3) for _ in range(rng.randint(1, 14))] for _ in range(12)]
        flat = np.array([s for w in words for s in w], "int32")
        last = np.zeros(len(flat), bool)
        last[np.cumsum([len(w) for w in words]) - 1] = True
        kept = merge_all(flat, last, PairRanks(number, merges))
        assert turn % 2 or PairRanks(number, merges).rising
        assert flat[kept].tolist() == [s for w in words for s in brute(w, ranks)]


def test_the_file_has_rising_ranks(bpe):
    assert bpe.pairs.rising


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAbe'sStlmvrd19 .!é\n\t<|>")), max_size=40), max_size=5))
def test_any_text_equals_the_library(bpe, library, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)]
    assert got == [library.encode(x, add_special_tokens=False).ids for x in texts]


def check(rows, library):
    for r in rows:
        ids = library.encode(r["source"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["text"] == library.decode(ids, skip_special_tokens=False)


def test_table_with_odd_texts_null_ids_repeated_rows_and_clashing_columns(spark, library):
    rows = [(i % 5 or None, t, t, "x") for i, t in enumerate(ODD + ODD[:4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ids string").repartition(3)
    # The source travels as the id, so that each row can be held against it.
    got = decoded(encoded(docs.selectExpr("source as doc_id", "text", "ids"), PATH), PATH).collect()
    assert len(got) == len(rows)
    check([{"source": r["doc_id"], "ids": r["ids"], "text": r["text"]} for r in got], library)
    assert sorted((r["doc_id"] or 0) for r in encoded(docs, PATH).collect()) == sorted((r[0] or 0) for r in rows)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = decoded(encoded(docs, PATH), PATH).collect()
    assert len(got) == len(texts)
    check([{"source": texts[r["doc_id"]], "ids": r["ids"], "text": r["text"]} for r in got], library)


def test_empty_table_and_unknown_ids(spark, bpe):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert decoded(encoded(docs, PATH), PATH).collect() == []
    assert bpe.decode(np.array([0, 900_000, 1], "<u4").tobytes()) == '! "' and bpe.decode(b"") == ""
