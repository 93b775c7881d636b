"""Sum-of-squares online packing of tokenised documents into windows of fixed length.

Each task packs the documents of its own partition as they come, without a shuffle. A document's whole windows are closed at
once; its rest goes into the partially filled window that leaves the sum over all fill levels of (windows at that
level)^2 smallest (Csirik et al. 2006), or opens a new one. An array counts the windows at each level. What is still open
when the partition ends is closed by cutting: the emptiest windows' pieces fill up the fullest, so that a task leaves one
window with padding at most.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.batches import pieces

#: Pieces of text whose ids a worker remembers, in each of two generations.
CACHE = 600_000
#: A line of letters of Latin-1 and then marks of ASCII: the tokenizer makes one word of the letters, in lower case, and one of
#: the marks. Any other line is the third group.
_LINE = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]*)([!#$%&()*+,./:;<=>?@\\^_`{|}~\[\]\"-]*)|(.*))$", re.MULTILINE)
_tokenizers: dict[tuple[str, int], "CachedTokenizer"] = {}


class _Generations:
    """A dictionary that keeps what was used lately: when the young generation is full, it becomes the old one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        lacking = keys.difference(self.young)
        kept = {k: self.old[k] for k in lacking if k in self.old}
        self.young.update(kept)
        return list(lacking.difference(kept)) if kept else list(lacking)

    def turn(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class CachedTokenizer:
    """The ids (unsigned 32-bit, little endian) that a tokenizer file gives a text.

    Its words never cross white space, so texts are cut there and the library sees each new piece once.
    """

    def __init__(self, path: str, remember: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.chunks, self.words = _Generations(remember), _Generations(remember)

    def _ask(self, texts: list[str]) -> list[bytes]:
        """All texts in one call, with blanks between; the offsets tell whose the ids are."""
        if not texts:
            return []
        got = self.library.encode(" ".join(texts), add_special_tokens=False)
        at = np.array([a for a, _ in got.offsets], dtype="int64")
        first = np.cumsum([0] + [len(x) + 1 for x in texts])
        cut = 4 * np.searchsorted(at, first)
        raw = np.array(got.ids, dtype="<u4").tobytes()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def _learn(self, chunks: list[str]) -> None:
        parts = _LINE.findall("\n".join(chunks)) if chunks else []
        lower = [letters.lower() for letters, _, _ in parts]
        words = {marks for _, marks, _ in parts}.union(lower)
        words.discard("")
        new = self.words.missing(words)
        known = self.words.young
        known.update(zip(new, self._ask(new)))
        known[""] = b""
        self.chunks.young.update(zip(chunks, [known[a] + known[p[1]] for a, p in zip(lower, parts)]))
        for x, p in zip(chunks, parts):
            if p[2]:
                self.chunks.young[x] = np.array(self.library.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self.words.turn()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [x.split(" ") if "\n" not in x else x.replace("\n", " ").split(" ") for x in texts]
        distinct: set[str] = set()
        for x in split:
            distinct.update(x)
        distinct.discard("")
        self._learn(self.chunks.missing(distinct))
        ids = self.chunks.young
        ids[""] = b""
        out = [b"".join(map(ids.__getitem__, x)) for x in split]
        self.chunks.turn()
        return out


def tokenizer(path: str, remember: int = CACHE) -> CachedTokenizer:
    if (path, remember) not in _tokenizers:
        _tokenizers[path, remember] = CachedTokenizer(path, remember)
    return _tokenizers[path, remember]


class SumOfSquares:
    """Open windows by fill level, and their number in an array that the choice is made from."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, dtype="int64")
        self.open: dict[int, list[int]] = {}
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The window and the offset in it for a piece of 1 to size - 1 tokens."""
        level = np.arange(1, self.size - length + 1)
        change = 2 * (self.count[length + 1 : self.size + 1] - self.count[1 : self.size - length + 1]) + 2
        change[-1] -= 1  # a full window is not counted any more
        change[self.count[1 : self.size - length + 1] == 0] = np.iinfo("int64").max
        best = int(change.argmin())
        if change[best] <= 2 * self.count[length] + 1:
            at = int(level[best])
            window = self.open[at].pop()
            self.count[at] -= 1
        else:
            at, window = 0, self.take()
        if at + length < self.size:
            self.count[at + length] += 1
            self.open.setdefault(at + length, []).append(window)
        return window, at

    def take(self) -> int:
        self.made += 1
        return self.made - 1


def _close(pieces_of: dict[int, list[list]], levels: dict[int, int], size: int) -> None:
    """Cut up the emptiest open windows to fill the fullest. A piece is [document, start, length]."""
    rising = sorted(levels, key=lambda w: (levels[w], w))
    low = 0
    for high in reversed(range(len(rising))):
        room = size - levels[rising[high]]
        while room and low < high:
            source = pieces_of[rising[low]]
            part = source[-1]
            n = min(room, part[2])
            pieces_of[rising[high]].append([part[0], part[1] + part[2] - n, n])
            part[2] -= n
            room -= n
            if not part[2]:
                source.pop()
            if not source:
                low += 1


def packed(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1, release: bool = False, remember: int = CACHE) -> DataFrame:
    """One row for each piece of a document: `doc_id`, `start` (ids of its document before it), `ids` (little-endian
    unsigned 32-bit), `doc_tokens`, `sequence_id`, `offset` (in the sequence, gapless from 0).

    A document is its ids and the end id; a null or empty text is the end id alone. Every row counts, repeated ones too;
    sequence ids are unique, not gapless. An empty table gives no pieces. Only the two columns named are read. A very long
    text is encoded whole and cut into windows like any other. With `release`, what a worker remembers goes when its task
    ends, so that stages that reuse the worker have its memory; else the next task starts with it. `remember` bounds the
    pieces of text that a worker remembers: about 200 MB for 600,000, in return for calls of the library.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        encode = tokenizer(tokenizer_path, remember).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        packer = SumOfSquares(size)
        waiting: dict[int, list[list]] = {}  # window: pieces [document, start, length]
        rest_of: dict[int, tuple] = {}  # document: its id, the ids that wait, how many were before them, how many in all
        number = 0

        def rows(parts: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*parts)) or [[]] * 6
            kinds = [id_kind, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        def finished(window: int) -> list[tuple]:
            out, at = [], 0
            for document, start, length in waiting.pop(window):
                key, ids, before, n = rest_of[document]
                out.append((key, start, ids[4 * (start - before) : 4 * (start - before + length)], n, base + window, at))
                at += length
            return out

        id_kind = None
        for batch, texts in pieces(batches, "text", 2 << 20):
            id_kind = batch.column(0).type
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), encode([x.decode() for x in texts])):
                ids += end
                n = len(ids) // 4
                rest = n % size
                for start in range(0, n - rest, size):
                    out.append((key, start, ids[4 * start : 4 * (start + size)], n, base + packer.take(), 0))
                if rest:
                    rest_of[number] = key, ids[4 * (n - rest) :], n - rest, n
                    window, at = packer.place(rest)
                    waiting.setdefault(window, []).append([number, n - rest, rest])
                    if at + rest == size:
                        done = [p[0] for p in waiting[window]]
                        out += finished(window)
                        for d in done:
                            del rest_of[d]
                    number += 1
            yield rows(out)
        if waiting:
            levels = {w: sum(p[2] for p in x) for w, x in waiting.items()}
            _close(waiting, levels, size)
            for window in [w for w, x in waiting.items() if x]:
                yield rows(finished(window))
        if release:
            _tokenizers.clear()

    out = f"doc_id {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, out)
