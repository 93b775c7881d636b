"""Benchmark decontamination by Wu-Manber multi-pattern search.

The benchmark is cut into windows of consecutive words. They are the patterns; tables over them are built in blocks of
bounded size, so that a benchmark of any size fits, and every document is searched for every block in one pass without a
shuffle. In a block, a shift table over hashed byte blocks says how far a position can be moved without missing an
occurrence; where it says zero, the suffix hash selects the patterns of a bucket, and their bytes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.llm.batches import pieces

#: A-Z become a-z; digits, letters and everything beyond ASCII belong to words.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Windows in one block of tables: about 10 MB.
BLOCK_WINDOWS = 100_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 4096


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def _padded(words: list[bytes]) -> bytes:
    """Every word stands between blanks, so that a match of bytes is a match of words."""
    return b" " + b" ".join(words) + b" " if words else b""


def _blocks_at(data: bytes) -> np.ndarray:
    """The eight bytes from each position on; the data ends with padding."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


class _Table:
    """Wu-Manber tables of patterns of similar length."""

    def __init__(self, patterns: list[tuple[int, bytes]]):
        self.ids = np.array([i for i, _ in patterns])
        self.bytes = b"".join(p for _, p in patterns) + bytes(8)
        self.length = np.array([len(p) for _, p in patterns])
        self.start = np.cumsum(self.length) - self.length
        self.shortest = int(self.length.min())
        self.block = min(8, max(1, self.shortest // 2))
        self.bits = max(12, min(22, int(len(patterns) * self.shortest * 4).bit_length()))
        at = _blocks_at(self.bytes)
        last = self.shortest - self.block
        self.shift = np.full(1 << self.bits, last + 1, dtype="int32")
        for offset in range(last + 1):
            hashed = self._hash(at[self.start + offset])
            self.shift[hashed] = np.minimum(self.shift[hashed], last - offset)
        suffix = self._hash(at[self.start + last])
        self.order = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.order], np.arange((1 << self.bits) + 1))
        self.prefix = at[self.start] & self._mask(min(8, self.shortest))

    @staticmethod
    def _mask(n: int) -> np.uint64:
        return np.uint64((1 << (8 * n)) - 1)

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks & self._mask(self.block)) * _FACTOR >> np.uint64(64 - self.bits)).astype("int64")

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the (padded) data and the ids of the patterns that start there. All segments move in step."""
        n = len(data) - 8
        at, last = _blocks_at(data), self.shortest - self.block
        here = np.arange(0, max(0, n - self.shortest + 1), _SEGMENT)
        stop = np.minimum(here + _SEGMENT, n - self.shortest + 1)
        found, hashes = [], []
        while len(here):
            hashed = self._hash(at[here + last])
            shift = self.shift[hashed]
            zero = shift == 0
            if zero.any():
                found.append(here[zero])
                hashes.append(hashed[zero])
            here = here + np.maximum(shift, 1)
            going = here < stop
            here, stop = here[going], stop[going]
        if not found:
            return np.zeros(0, "int64"), np.zeros(0, "int64")
        out = [self._compare(data, at, p[i : i + 20_000], h[i : i + 20_000]) for p, h in [(np.concatenate(found), np.concatenate(hashes))] for i in range(0, len(p), 20_000)]
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _compare(self, data: bytes, at: np.ndarray, here: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, many = self.bucket[hashed], self.bucket[hashed + 1] - self.bucket[hashed]
        here = np.repeat(here, many)
        which = self.order[np.arange(len(here)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
        likely = (at[here] & self._mask(min(8, self.shortest)) == self.prefix[which]) & (here + self.length[which] <= len(data) - 8)
        here, which = here[likely], which[likely]
        text, own = np.frombuffer(data, "uint8"), np.frombuffer(self.bytes, "uint8")
        equal = np.zeros(len(here), dtype=bool)
        for length in np.unique(self.length[which]):
            rows = np.flatnonzero(self.length[which] == length)
            for i in range(0, len(rows), 20_000):
                some, span = rows[i : i + 20_000], np.arange(length)
                equal[some] = (text[here[some][:, None] + span] == own[self.start[which[some]][:, None] + span]).all(axis=1)
        return here[equal], self.ids[which[equal]]


class WuManber:
    """A search for many byte patterns; patterns of unlike length have tables of their own, as the shortest limits the shift."""

    def __init__(self, patterns: list[bytes]):
        by_size: dict[int, list[tuple[int, bytes]]] = {}
        for i, p in enumerate(patterns):
            by_size.setdefault(min(len(p).bit_length(), 7), []).append((i, p))
        self.tables = [_Table(x) for _, x in sorted(by_size.items())]

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        data += bytes(8)
        found = [t.find(data) for t in self.tables]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """`(item, window)`: each distinct window of each item; an item of fewer words, but not none, is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), texts):
                words = words_of(text)
                rows += [(item, _padded(words[i : i + size])) for i in range(max(1, len(words) - size + 1)) if words]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["item", "window"])

    named = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return named.mapInArrow(cut, "item string, window binary").distinct()


def _tables(found: DataFrame, block_windows: int) -> list[Broadcast]:
    """The tables of each block of windows. The driver holds one block at a time, whose size is bounded."""
    context = found.sparkSession.sparkContext
    n = -(-found.count() // block_windows)
    placed = found.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(max(n, 1))))
    out = []
    for block in range(n):
        rows = sorted((bytes(r["window"]), r["item"] or "", r["item"] is None) for r in placed.where(F.col("block") == block).collect())
        patterns = sorted({r[0] for r in rows})
        index = {p: i for i, p in enumerate(patterns)}
        items: list[list[str]] = [[] for _ in patterns]
        for window, item, unnamed in rows:
            if not unnamed:
                items[index[window]].append(item)
        out.append(context.broadcast((WuManber(patterns), np.array([p.count(b" ") - 1 for p in patterns]), items)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_windows: int = BLOCK_WINDOWS, carry: bool = False) -> DataFrame:
    """What each document shares with the benchmark.

    Out: `doc_id`, `n_words`, `n_hit` (words inside any occurrence of a window), `items` (ids as strings, sorted) and
    `spans` (hit words as ascending `(start, end)` runs), one row for each input row, repeated rows included. Texts are
    searched whole. A null or empty text has no words and no hits; a null or empty item has no windows; an item without
    an id hits words but is not listed; equal items are all listed. Without documents or items the result is empty or
    without hits. Other columns of the inputs don't matter; with `carry` all columns
    of a document come along in the struct `row`.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), *([F.struct(*docs.columns).alias("row")] if carry else []), F.col(text).alias("text"))
    head = rows.drop("text").schema
    blocks = _tables(windows(benchmark, item_id, item_text, window), block_windows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            carried = [batch.column(i) for i in range(len(head.names))]
            lists = [words_of(x) for x in texts]
            padded = [_padded(x) for x in lists]
            data = b"\n".join(padded) + b"\n"
            starts = np.cumsum([0] + [len(x) + 1 for x in padded])
            n_words = np.array([len(x) for x in lists])
            blanks = np.flatnonzero(np.frombuffer(data, "uint8") == 32)
            first = np.searchsorted(blanks, starts)  # the blank before word w of document d is number first[d] + w
            change = np.zeros(len(blanks) + 1, dtype="int64")
            items: list[set[str]] = [set() for _ in texts]
            for block in blocks:
                tables, length, listed = block.value
                at, which = tables.find(data)
                if len(at):
                    word = np.searchsorted(blanks, at)
                    np.add.at(change, word, 1)
                    np.add.at(change, word + length[which], -1)
                    doc = np.searchsorted(starts, at, "right") - 1
                    for pair in np.unique(doc * len(listed) + which):
                        items[pair // len(listed)].update(listed[pair % len(listed)])
                if len(blocks) > 1:
                    block.__dict__.pop("_value", None)  # a task holds one block's tables; they are read again from its disk
            hit = np.cumsum(change[:-1]) > 0
            edges = np.diff(np.concatenate([[0], hit.astype("int8"), [0]]))
            begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            doc = np.searchsorted(first, begin, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(begin - first[doc]), pa.array(end - first[doc])], ["start", "end"])
            offsets = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype("int32"))
            n_hit = np.bincount(doc, weights=end - begin, minlength=len(texts)).astype("int64")
            yield pa.RecordBatch.from_arrays(
                [*carried, pa.array(n_words, pa.int64()), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.ListArray.from_arrays(offsets, spans)],
                [*head.names, "n_words", "n_hit", "items", "spans"],
            )

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([*head.fields]).add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("spans", span)
    return rows.mapInArrow(search, out)
