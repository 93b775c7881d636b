"""Byte-pair encoding and decoding by an index of pair occurrences.

A task works on slices of its partition. Every different piece of text between blanks enters a slice's symbols once; an index
maps each pair of neighbouring symbols, by its rank, to all positions where it occurs. The active ranks are applied in
ascending order, each at all of its positions at once, and the positions whose pairs change go to the lists of their new
ranks. No shuffle takes place and nothing is kept from slice to slice.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.batches import pieces

#: Bytes of text whose pieces are encoded together.
SLICE_BYTES = 4 << 20
_NONE = np.int32(1 << 30)
#: A position that an earlier one has swallowed.
_GONE = np.int32(1 << 30 | 1)
_FENCE = "\U0010ffff"
_PLAIN = re.compile(r"[!-~]+")
_SPACE, _LETTER, _NUMBER, _MARK, _EDGE = 1, 2, 3, 4, 5


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones of Latin-1 for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256)]


class PairRanks:
    """Rank and product of each pair of symbols, by binary search."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.left = np.array([vocabulary[a] for a, _ in merges], "int64")
        self.right = np.array([vocabulary[b] for _, b in merges], "int64")
        self.product = np.array([vocabulary[a + b] for a, b in merges], "int32")
        keys = self.left << 32 | self.right
        # Of a pair that is listed twice the later rank counts.
        self.rank = len(keys) - 1 - np.unique(keys[::-1], return_index=True)[1].astype("int32")
        self.keys = keys[self.rank]
        # Whether no product leads to a pair of a lower rank than its own, as where the ranks were learned one by one.
        made = np.full(1 + max([0, *vocabulary.values()]), -1)
        made[self.product] = np.arange(len(keys))
        self.rising = bool((np.maximum(made[self.left], made[self.right]) < np.arange(len(keys))).all())

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype("int64") << 32 | right
        if not len(self.keys):
            return np.full(len(key), _NONE)
        at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE).astype("int32")


def merge_all(symbols: np.ndarray, last: np.ndarray, pairs: PairRanks) -> np.ndarray:
    """Merge the symbols (in place) of all words, whose last ones are flagged; returns which positions are left.

    A word merges its pair of the lowest rank first, the leftmost of equal ones. Where ranks rise from pair to product, all
    occurrences of a pair can go at once; else a word gives one at a time.
    """
    word = None if pairs.rising else np.cumsum(last) - last
    n = len(symbols)
    following, before, last = np.arange(1, n + 1), np.arange(-1, n - 1), last.copy()
    rank = np.full(n, _NONE)
    rank[:-1] = pairs.of(symbols[:-1], symbols[1:])
    rank[last] = _NONE
    found = np.flatnonzero(rank != _NONE)
    index: dict[int, list[np.ndarray]] = {}

    def enter(positions: np.ndarray, ranks: np.ndarray) -> list[int]:
        """Put positions on the lists of their ranks; the ranks that were not active."""
        if len(positions) > 1:
            order = ranks.argsort(kind="stable")
            positions, ranks = positions[order], ranks[order]
        cut = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        new = []
        for (a, b), r in zip(pairwise(cut), ranks[cut[:-1]].tolist()):
            if r in index:
                index[r].append(positions[a:b])
            else:
                index[r] = [positions[a:b]]
                new.append(r)
        return new

    active = enter(found, rank[found]) if len(found) else []
    heapq.heapify(active)
    left, right, product = pairs.left.tolist(), pairs.right.tolist(), pairs.product.tolist()
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = at[rank[at] == r]
        if not len(at):
            continue
        if word is not None:
            at = np.sort(at)
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            if not first.all():
                index[r] = [at[~first]]
                heapq.heappush(active, r)
            at = at[first]
        elif left[r] == right[r] and len(at) > 1:  # of overlapping ones every second, from the left
            at = np.sort(at)
            head = np.concatenate([[True], following[at[:-1]] != at[1:]])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
        swallowed = following[at]
        beyond = following[swallowed]
        symbols[at] = product[r]
        following[at] = beyond
        rank[swallowed] = _GONE
        ends = last[swallowed]
        last[at] = ends
        inner, beyond = at[~ends], beyond[~ends]
        before[beyond] = inner
        front = before[at]
        front = front[front >= 0]
        front = front[~last[front] & (rank[front] != r)]
        rank[at] = _NONE
        changed = np.concatenate([inner, front])
        if len(changed):
            now = pairs.of(symbols[changed], symbols[following[changed]])
            rank[changed] = now
            known = now != _NONE
            if known.any():
                for x in enter(changed[known], now[known]):
                    heapq.heappush(active, x)
    return rank != _GONE


class WordBpe:
    """A tokenizer file of this kind: words of letters, single digits and marks, bytes as symbols, an end of word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model, self.library = parts["model"], Tokenizer.from_file(path)
        self.vocabulary: dict[str, int] = model["vocab"]
        self.pairs = PairRanks(self.vocabulary, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        end = model["end_of_word_suffix"]
        if not end or parts["decoder"] or model.get("dropout") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in parts["added_tokens"]):
            raise ValueError(f"{path} is not a word-level tokenizer with an end of word and plain added tokens")
        names = byte_symbols()
        self.inside = np.array([self.vocabulary[c] for c in names], "int32")
        self.closing = np.array([self.vocabulary[c + end] for c in names], "int32")
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.kinds = np.zeros(0x110000, "uint8")
        self.kinds[ord(_FENCE)] = _EDGE
        self.kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
        names = {**{v: k for k, v in self.vocabulary.items()}, **{v: k for k, v in self.added.items()}}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        """Space, letter, number or mark, as the file's own pattern takes the characters."""
        for code in np.unique(codes[self.kinds[codes] == 0]).tolist():
            split = self.library.pre_tokenizer.pre_tokenize_str
            c = chr(code)
            if not split(c):
                kind = _SPACE
            elif len(split("a" + c)) == 1:
                kind = _LETTER
            elif len(split("!" + c)) == 1:
                kind = _MARK
            else:
                kind = _NUMBER
            self.kinds[code] = kind
        return self.kinds[codes]

    def _words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words begin and end in a text that is normalised and fenced on both sides."""
        kind = self._kinds(codes)
        begins = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)])
        # A lone apostrophe takes the letters of a contraction with it; the letters behind are a word of their own.
        lone = np.flatnonzero((codes == 0x27) & begins)
        lone = lone[begins[lone + 1]]
        one, two = codes[lone + 1], codes[np.minimum(lone + 2, len(codes) - 1)]
        c = {x: ord(x) for x in "stmdrvel"}
        single = (one == c["s"]) | (one == c["t"])
        double = ((one == c["r"]) | (one == c["v"])) & (two == c["e"]) | (one == c["l"]) & (two == c["l"])
        single |= (one == c["m"]) | (one == c["d"])
        taken = np.where(single, 1, np.where(double, 2, 0))
        lone, taken = lone[taken > 0], taken[taken > 0]
        begins[lone + 1] = False
        begins[lone + 1 + taken] = True
        start = np.flatnonzero(begins)
        end = np.concatenate([start[1:], [len(codes)]])
        real = (kind[start] != _SPACE) & (kind[start] != _EDGE)
        return start[real], end[real]

    def _encode_pieces(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of the texts, none of which holds the fence."""
        if not chunks:
            return []
        joined = _FENCE + _FENCE.join(chunks) + _FENCE
        joined = joined.lower() if joined.replace(_FENCE, "").isascii() and not re.search(r"[\x00-\x20\x7f]", joined) else self.library.normalizer.normalize_str(joined)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        start, end = self._words(codes)
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype("int64")
        byte_at = np.concatenate([[0], np.cumsum(width)])
        raw = np.frombuffer(joined.encode(), "uint8")
        final = np.zeros(len(raw), bool)
        final[byte_at[end] - 1] = True
        in_word = np.zeros(len(raw) + 1, "int64")
        np.add.at(in_word, byte_at[start], 1)
        np.add.at(in_word, byte_at[end], -1)
        used = np.flatnonzero(np.cumsum(in_word)[:-1])
        symbols, last = np.where(final[used], self.closing[raw[used]], self.inside[raw[used]]), final[used]
        kept = merge_all(symbols, last, self.pairs) if len(symbols) else np.zeros(0, bool)
        ids = symbols[kept].astype("<u4").tobytes()
        fences = byte_at[np.flatnonzero(codes == ord(_FENCE))]
        cut = (4 * np.concatenate([[0], np.cumsum(kept)])[np.searchsorted(used, fences)]).tolist()
        return [ids[a:b] for a, b in pairwise(cut)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, unsigned 32-bit and little endian."""
        ids = {k: np.array([v], "<u4").tobytes() for k, v in self.added.items()}
        split, distinct = [], set()
        for text in texts:
            text = text.replace("\n", " ").replace("\t", " ")
            # Nothing joins across an added token, or across a blank.
            parts = [text] if self.cut is None or not self.cut.search(text) else self.cut.split(text)
            words = [w for part in parts for w in ([part] if part in self.added else part.split(" "))]
            split.append(words)
            distinct.update(words)
        distinct.difference_update(ids)
        plain = [x for x in distinct if _PLAIN.fullmatch(x)]
        other = list(distinct.difference(plain))
        odd = [x for x in other if _FENCE in x]
        other = [x for x in other if _FENCE not in x]
        for group in (plain, other):
            ids.update(zip(group, self._encode_pieces(group)))
        for x in odd:  # marks of the noncharacter that fences the others
            ids[x] = np.array(self.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        return [b"".join(map(ids.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """The names of the tokens with blanks between them; ids that the file does not know are left out."""
        names, size = self.names, len(self.names)
        known = np.frombuffer(ids, "<u4")
        if len(known) and known.max() >= size:
            known = known[known < size]
        return " ".join(filter(None, map(names.__getitem__, known.tolist())))


def encoded(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, ids)` for each row: the ids of the whole text, unsigned 32-bit and little endian in a binary.

    A null or empty text has no ids. Null ids, repeated rows and equal texts go through row by row; of other columns none is
    read. A slice holds about SLICE_BYTES of text, or one longer text as a whole. An empty table gives an empty one.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(tokenizer_path)
        for rows in _gathered(batches):
            ids = bpe.encode([x.decode() for _, texts in rows for x in texts])
            at = 0
            for batch, texts in rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[at : at + len(texts)], pa.binary())], ["doc_id", "ids"])
                at += len(texts)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, f"doc_id {kind}, ids binary")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[pa.RecordBatch, list[bytes]]]]:
    """Batches put together to slices, so that words that many texts share are encoded once."""
    waiting, size = [], 0
    for batch, texts in pieces(batches, "text", SLICE_BYTES // 4):
        waiting.append((batch, texts))
        size += sum(map(len, texts))
        if size >= SLICE_BYTES:
            yield waiting
            waiting, size = [], 0
    if waiting:
        yield waiting


def decoded(tokens: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`(doc_id, ids, text)` for each row of ids as `encoded` gives them; null or no ids are an empty text."""
    kind = tokens.schema[doc_id].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(tokenizer_path)
        for batch, rows in pieces(batches, "ids"):
            text = pa.array([bpe.decode(x) for x in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], ["doc_id", "ids", "text"])

    return tokens.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(decode, f"doc_id {kind}, ids binary, text string")
