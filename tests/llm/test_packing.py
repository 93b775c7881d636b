from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from voxlake.llm.packing import CachedTokenizer, SumOfSquares, packed
from voxlake.llm.queries import word_tokenizer

TEXTS = [
    "Plain words, with marks; and MORE words!!! 42 times (or 7.5)...",
    "It's the dog's day: we've, I'll, don't|won't",
    "ÉÇ été, naïve straße µm 5×3 ª x\ttab\r\nline\x0bend ",
    "日本語のテキスト and 한국어, é å, ΣΑΣ, İstanbul, ​zero",
    "<|endoftext|> text <|startoftext|>x <|x|>",
    "",
    "   ",
    "\n\n",
    "%%% a%%% --- _x_ \"quoted\" `b` [c]{d}~^\\",
]


def test_ids_are_those_of_the_library():
    library, own = Tokenizer.from_file(word_tokenizer()), CachedTokenizer(word_tokenizer())
    for texts in (TEXTS, TEXTS[::-1], ["".join(TEXTS)]):
        want = [np.array(library.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
        assert own.encode(texts) == want
    own.chunks.size = own.words.size = 3
    for x in TEXTS * 2:
        assert own.encode([x])[0] == np.array(library.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_place_takes_the_level_with_the_least_sum_of_squares():
    rng, packer, size = np.random.default_rng(5), SumOfSquares(12), 12
    counts, fill = [0] * 13, {}
    for _ in range(400):
        n = int(rng.integers(1, 12))

        def after(level):
            c = counts[:]
            if level:
                c[level] -= 1
            if level + n < size:
                c[level + n] += 1
            return sum(x * x for x in c)

        best = min(after(lv) for lv in range(0, size - n + 1) if lv == 0 or counts[lv])
        window, at = packer.place(n)
        assert at == fill.get(window, 0) and after(at) == best
        fill[window] = at + n
        if at:
            counts[at] -= 1
        if at + n < size:
            counts[at + n] += 1


@pytest.mark.parametrize("parts", [1, 3])
def test_pieces_hold_every_id_once_with_little_padding(spark, parts):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "gamma!", "été"], int(n))) for n in rng.integers(0, 90, 150)]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (None, "no id"), (3, texts[3]), (902, "word " * 5000)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, start int, ids string").repartition(parts)
    out = packed(docs, word_tokenizer(), size=64).collect()
    library = Tokenizer.from_file(word_tokenizer())
    want = sorted(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for _, t in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        n = len(r["ids"]) // 4
        assert 0 < n <= 64 and r["doc_id"] in {x[0] for x in rows}
        by_doc[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        by_sequence[r["sequence_id"]].append((r["offset"], n))
    joined = sorted(b"".join(x for _, x, _ in sorted(v)) for k, v in by_doc.items() if k != 3)
    assert joined == sorted(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for k, t in rows if k != 3)
    assert sum(len(x) for v in by_doc.values() for _, x, _ in v) == sum(map(len, want))
    for v in by_sequence.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 64
    assert sum(sum(n for _, n in v) < 64 for v in by_sequence.values()) <= parts


def test_no_documents(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string"), word_tokenizer()).collect() == []


def test_what_a_worker_remembers_is_bounded():
    small, large = CachedTokenizer(word_tokenizer(), remember=50), CachedTokenizer(word_tokenizer())
    for i in range(40):
        texts = [f"word{i}x{j}, and more" for j in range(20)]
        assert small.encode(texts) == large.encode(texts)
    held = [small.chunks, small.words]
    assert max(len(x.young) + len(x.old) for x in held) <= 2 * (50 + 45) < len(large.chunks.young)
