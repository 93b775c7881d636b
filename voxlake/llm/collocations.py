"""Collocations by best-first branch-and-bound growth.

Words are counted first. A phrase that begins with word w scores 1000 * n / f(w) at most, as its rest occurs at least as
often as the whole; so the words with few occurrences are opened first. Each round reads the corpus once and counts, of the
frontier, the phrases that are one word longer, and what the phrases found in the round before still need: their rests, for
the score, and the phrases with one word more in front, for their being covered. All of that is asked for by hashes in a
bitmap of fixed size, which the counts by full text follow. Growth ends for a language when no prefix that is left could
reach the score of its last row that counts, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.batches import CHUNK_BYTES, RollingHash, mix, pieces
from voxlake.llm.filters import bitmap_of, passes
from voxlake.session import settle

#: Bytes of text that are counted together before they leave a task.
SLICE_BYTES = 8 << 20
#: Bytes of phrases that are taken out of a slice at once.
PHRASE_BYTES = 1 << 20
#: The first words opened occur so many times the least count at most; each further round opens so many times more.
OPENING = 64
_STEP = np.uint64(0x9FB21C651E98DF25)
_BLANK, _BREAK = 1, 2
_CLASS = np.zeros(256, "uint8")
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
#: What a bitmap's hash is about: a frequent word, a prefix to grow, a phrase to count, a phrase to lengthen in front.
_WORD, _GROW, _COUNT, _FRONT = range(4)
_ABOUT = mix(np.arange(1, 5, dtype="uint64"))


class _Words:
    """The words of several texts, as positions and hashes that differ by language; pieces don't cross texts."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.data = b"\n".join(texts).lower() + b"\n"
        raw = np.frombuffer(self.data, "uint8")
        kind = _CLASS[raw]
        edges = np.diff(np.concatenate([[True], kind > 0]).astype("int8"))
        self.start, self.end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        self.piece = np.cumsum(kind == _BREAK, dtype="int32")[self.start]
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, "right")
        self.names, self.lang = np.unique(np.array(langs, object), return_inverse=True)
        # A word and the next one with a single blank between are a phrase as they stand.
        self.tight = (self.start[1:] - self.end[:-1] == 1) & (raw[self.end[:-1]] == 0x20)
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.names.tolist()], "uint64")
        self.hash = mix(self._hashes() + salt[self.lang[self.text]]) if len(self.start) else np.zeros(0, "uint64")

    def _hashes(self) -> np.ndarray:
        """A hash of each word alone, over parts of the text that begin with a word."""
        cut = [0, *(np.searchsorted(self.start, np.arange(CHUNK_BYTES, len(self.data), CHUNK_BYTES)).tolist()), len(self.start)]
        parts = []
        for a, b in zip(cut, cut[1:]):
            if a < b:
                base = self.start[a]
                parts.append(RollingHash(self.data[base : self.end[b - 1]]).of(self.start[a:b] - base, self.end[a:b] - base))
        return np.concatenate(parts)

    def phrases(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """By first word: the hash of so many words, and whether they lie in one piece. Shorter by words - 1."""
        n = max(0, len(self.hash) - words + 1)
        out = self.hash[:n].copy()
        for i in range(1, words):
            out = out * _STEP + self.hash[i : i + n]
        return mix(out), self.piece[:n] == self.piece[words - 1 : words - 1 + n]

    def shares(self, first: np.ndarray, words: int) -> Iterator[slice]:
        """The phrases of so many words that begin there, in shares of about `PHRASE_BYTES` bytes (one phrase at least)."""
        ends = np.cumsum(self.end[first + words - 1] - self.start[first])
        at = 0
        while at < len(first):
            after = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PHRASE_BYTES, "right")))
            yield slice(at, after)
            at = after

    def strings(self, first: np.ndarray, words: int) -> pa.Array:
        """The phrases of so many words that begin there, with a blank between the words."""
        last = first + words - 1
        loose = np.zeros(len(first), bool)
        for i in range(words - 1):
            loose |= ~self.tight[first + i]
        begin, end, data = self.start[first].copy(), self.end[last].copy(), self.data
        if loose.any():
            made = [b" ".join(data[self.start[i] : self.end[i]] for i in range(f, f + words)) for f in first[loose].tolist()]
            ends = len(data) + np.cumsum([len(x) for x in made])
            begin[loose], end[loose], data = ends - [len(x) for x in made], ends, data + b"".join(made)
        offsets = np.concatenate([[0], np.cumsum(end - begin)])
        taken = np.frombuffer(data, "uint8")[np.repeat(begin - offsets[:-1], end - begin) + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype("int64")), pa.py_buffer(taken)).cast(pa.string())

    def langs(self, first: np.ndarray) -> pa.Array:
        codes = pa.array(self.lang[self.text[first]].astype("int32"))
        return pa.DictionaryArray.from_arrays(codes, pa.array(self.names.tolist(), pa.string())).cast(pa.string())


def _asked(about: int, hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ _ABOUT[about])


def _hashed(phrases: DataFrame, about: int) -> DataFrame:
    """`(h)`: the hash by which a scan asks for phrases `(lang, phrase)`."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "phrase"):
            words = _Words(texts, batch.column(0).to_pylist())
            first = np.searchsorted(words.text, np.arange(len(texts)))
            length = np.searchsorted(words.text, np.arange(len(texts)), "right") - first
            out = np.zeros(len(texts), "uint64")
            for m in np.unique(length):
                of_length = length == m
                out[of_length] = _asked(about, words.phrases(int(m))[0][first[of_length]])
            yield pa.RecordBatch.from_arrays([pa.array(out.view("int64"))], ["h"])

    return phrases.select("lang", "phrase").mapInArrow(take, "h long")


def _counted(docs: DataFrame, emit, least: int) -> DataFrame:
    """`(lang, phrase, words, f)` of what `emit(words)` yields as (first, length, number), summed; from `least` on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", SLICE_BYTES):
            words = _Words(texts, batch.column(0).to_pylist())
            for every, length, number in emit(words):
                for share in words.shares(every, length):
                    first = every[share]
                    columns = [words.langs(first), words.strings(first, length), pa.array(np.full(len(first), length, "int32")), pa.array(number[share])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "number"])

    found = docs.mapInArrow(scan, "lang string, phrase string, words int, number long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("number").alias("f")).where(F.col("f") >= least)


def _each_word(words: _Words) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    _, first, number = np.unique(words.hash, return_index=True, return_counts=True)
    yield first, 1, number


def _wanted(bitmap: Broadcast, longest: int):
    """What a round counts: phrases of frequent words whose prefix grows, that are asked for, or that one in front leads to."""

    def emit(words: _Words) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        asked = lambda about, hashes: passes(bitmap, _asked(about, hashes))
        single = mix(words.hash)
        frequent, grows, fronts = asked(_WORD, single), asked(_GROW, single), np.zeros(len(single), bool)
        all_frequent = frequent
        for m in range(2, longest + 1):
            hashes, whole = words.phrases(m)
            n = len(hashes)
            if not n:
                return
            all_frequent = all_frequent[:n] & frequent[m - 1 : m - 1 + n]
            taken = np.flatnonzero(whole & all_frequent)
            own = hashes[taken]
            ok = grows[taken] | fronts[taken + 1] | asked(_COUNT, own)
            _, first, number = np.unique(own[ok], return_index=True, return_counts=True)
            yield taken[ok][first], m, number
            if m < longest:
                grows, fronts = np.zeros(n, bool), np.zeros(n + 1, bool)
                grows[taken], fronts[taken] = asked(_GROW, own), asked(_FRONT, own)

    return emit


def _part(first: Column, count: Column) -> Column:
    """Words of the phrase, from number `first` (from 1) on."""
    return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")


def _scored(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """`phrases` (lang, phrase, words, f) with l, r, n and score of the cut that scores least, the first of equal ones."""
    cuts = phrases.select("lang", "phrase", "words", "f", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    ends = cuts.select("*", _part(F.lit(1), F.col("k")).alias("front"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    of = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    both = ends.join(of("front", "l"), ["lang", "front"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(1000 * cast(f as decimal(16, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r", "n"))
    return both.groupBy("lang", "phrase", "words", "f").agg(least.alias("x")).select("lang", "phrase", "words", "f", "x.l", "x.r", "x.n", "x.score")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, covered: int = 100) -> DataFrame:
    """`(lang, rank, phrase, a, l, r, n, score)`: the first `top` phrases of 2 to `longest` words of each language.

    A-Z become small; `.,;:!?` and line ends cut texts into pieces, blanks and tabs those into words. n are all word
    occurrences of the language, a those of the phrase inside pieces, overlapping ones too. Phrases with a >= `least` count.
    Of the cuts in two the one with the least floor(1000 * a * n / (l * r)) counts, the first of equal ones. A phrase is left
    out if one that holds it, of up to `longest` words, has at least `covered` percent of its occurrences. Order: score, then a,
    both falling, then the phrase by its bytes.

    A null language is `und`, with the rows that say so themselves. A null text or one without words adds nothing; repeated
    rows count each. A text is never cut, whatever its length. An empty table gives no rows. Only the two columns named are
    read. Equal phrases inside a slice of a task are found by 64-bit hashes.
    """
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text is not null")
    every = settle(_counted(read, _each_word, 0).groupBy("lang", F.when(F.col("f") >= least, F.col("phrase")).alias("phrase")).agg(F.sum("f").alias("f")))
    totals = settle(every.groupBy("lang").agg(F.sum("f").alias("n")))
    words = settle(every.where("phrase is not null").select("lang", "phrase", F.lit(1).alias("words"), "f"))
    largest = words.agg(F.max("f")).first()[0]
    counts, new, found = words, None, None  # all counts, what the last round has grown, what is scored
    opened, reach = 0, least * OPENING
    limits = totals.select("lang", F.lit(0).cast("long").alias("limit"))
    bound = F.expr("1000 * cast(n as decimal(20, 0)) div f")  # for phrases that begin with a word of f occurrences
    while True:
        hopeful = words.join(totals, "lang").join(limits, "lang").where(bound >= F.col("limit"))
        first = hopeful.select("lang", F.col("phrase").alias("head"))
        fresh = hopeful.where((F.col("f") > opened) & (F.col("f") <= reach)).select("lang", "phrase") if opened < (largest or 0) else None
        if fresh is not None and fresh.isEmpty():
            fresh = None
        if new is None and fresh is None:
            if not largest or opened >= largest or hopeful.where(F.col("f") > opened).isEmpty():
                break
            opened, reach = reach, reach * OPENING
            continue
        asked = [_hashed(words, _WORD)]
        frontier = fresh
        if new is not None:
            grown = new.where(F.col("words") < longest)
            hopes = grown.withColumn("head", F.element_at(F.split("phrase", " "), 1)).join(first, ["lang", "head"], "left_semi").select("lang", "phrase")
            frontier = hopes if fresh is None else hopes.union(fresh)
            rests = new.where("words > 2").select("lang", F.explode(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: _part(k, F.col("words")))).alias("phrase"))
            asked += [_hashed(rests.distinct(), _COUNT), _hashed(grown, _FRONT)]
        frontier = settle(frontier)
        asked.append(_hashed(frontier, _GROW))
        union = asked[0]
        for more in asked[1:]:
            union = union.union(more)
        bitmap = bitmap_of(union, "h")
        seen = settle(_counted(read, _wanted(bitmap, longest), least))
        # What was counted before is counted the same again.
        counts = settle(counts.union(seen.join(counts, ["lang", "phrase"], "left_anti").select(*counts.columns)))
        if new is not None:
            scored = settle(_scored(new, counts, totals))
            found = scored if found is None else found.unionByName(scored)
        prefix = seen.withColumn("prefix", _part(F.lit(1), F.col("words") - 1))
        grown = settle(prefix.join(frontier.withColumnRenamed("phrase", "prefix"), ["lang", "prefix"], "left_semi").select(*counts.columns))
        new = None if grown.isEmpty() else grown
        bitmap.unpersist()
        if found is not None:
            left = settle(_uncovered(found, counts, covered))
            by_score = Window.partitionBy("lang").orderBy(F.desc("score"))
            last = left.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == top).select("lang", "score")
            limits = settle(totals.select("lang").join(last, "lang", "left").select("lang", F.coalesce("score", F.lit(0)).alias("limit")))
        opened, reach = max(opened, reach), reach * OPENING

    if found is None:
        found = _scored(words.where("false"), counts, totals)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), F.asc("phrase"))
    ranked = _uncovered(found, counts, covered).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def _uncovered(found: DataFrame, counts: DataFrame, covered: int) -> DataFrame:
    """Phrases of which no longer one has the share of occurrences: if one has, so has one with a single word more."""
    longer = counts.where("words > 2")
    inner = lambda at: longer.select("lang", _part(F.lit(at), F.col("words") - 1).alias("phrase"), "f")
    most = inner(1).union(inner(2)).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return found.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("f"))).drop("most")
