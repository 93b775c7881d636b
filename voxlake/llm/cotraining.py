"""Quality scores by co-training a text view and a metadata view.

The text view sees a document's words, pairs of neighbouring words and the shapes of words, the metadata view its language, source and length. Each is a naive
Bayes classifier, whose counts are sums over all rows and are made by Spark. In every round each view names the rows
without a label that it is sure of, and the other view learns from those too. Views are calibrated on a fold of labelled
rows that neither learned from, and their calibrated odds together score every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.batches import pieces
from voxlake.session import settle

ROUNDS, SURE = 3, 0.97
SHAPES, FACTS = 2048, 512
#: Buckets of words and word pairs; a word that fewer documents than RARE have held says little.
WORDS, RARE = 1 << 18, 4
#: Labelled documents to learn from, about: more are drawn by a hash of their ids, and the rest count as rows without a label.
LABELLED = 200_000
#: Every so many-th labelled row, by a hash of its id, calibrates and is not learned from.
CALIBRATE = 4
#: A document of so many features counts half of what they say on average.
FEW = 4
_BINS, _WIDTH = 800, 0.025
#: A letter is A or a, a digit 0; blanks of all kinds are one; marks stand for themselves.
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 if c <= 32 else c for c in range(256))
#: Small letters, digits and bytes beyond ASCII are in words; all else is blank.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_FAR = 65535


def hashed_words(text: bytes) -> bytes:
    """The buckets of all words and pairs of neighbours, each once, in order: the steps between them in two bytes each."""
    h = np.array([zlib.crc32(w) for w in text.translate(_WORD).split()], dtype="uint64")
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(46)
    steps = np.diff(np.unique(np.concatenate([h % np.uint64(WORDS), pairs])).astype("int64"), prepend=0)
    far = steps // _FAR  # _FAR stands for a step that goes on
    out = np.full(len(steps) + int(far.sum()), _FAR, dtype="<u2")
    out[np.cumsum(far + 1) - 1] = steps % _FAR
    return out.tobytes()


def word_buckets(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The row and the bucket of every word and pair of the rows."""
    steps = np.frombuffer(b"".join(coded), "<u2").astype("int64")
    row = np.repeat(np.arange(len(coded)), [len(x) // 2 for x in coded])
    sums = np.concatenate([[0], np.cumsum(steps)])
    start = np.cumsum([0, *[len(x) // 2 for x in coded]])[:-1]
    last = steps != _FAR
    return row[last], (sums[1:] - sums[start][row])[last]


def word_shapes(text: bytes) -> Counter:
    """How often each word shape occurs, runs of one kind as one: `Aa`, `a,`, `A!`, `a%`."""
    s = np.frombuffer(b" " + text.translate(_SHAPE), "uint8")
    shapes = Counter(s[np.concatenate([s[1:] != s[:-1], [True]])].tobytes().split())
    n = sum(shapes.values())
    if n:
        words = text.lower().split()
        again = sum(map(bytes.__eq__, words, words[1:]))
        if again:
            shapes[b"again"] = 4 * again
        if n >= 8:
            shapes[b"distinct %d" % int(8 * len(set(words)) / len(words))] = n // 8  # an eighth of the weight of all words
    return shapes


def _facts(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    size = "none" if n_chars is None else str(int(2 * np.log2(max(0, n_chars) + 1)))
    return [zlib.crc32(f"{k}={v}".encode()) % FACTS for k, v in (("lang", lang), ("source", source), ("size", size))]


class Views:
    """Both classifiers: log odds of each feature, and the line from a mean log odds to calibrated odds."""

    def __init__(self, counts: dict[tuple[int, int], np.ndarray]):
        self.odds = []
        for view, size in ((0, SHAPES), (1, FACTS)):
            bad, good = (counts.get((view, c), np.zeros(size)) + 0.5 for c in (0, 1))
            self.odds.append(np.log(good / good.sum()) - np.log(bad / bad.sum()))
        bad, good = (counts.get((2, c), np.zeros(WORDS + 1)) for c in (0, 1))  # documents with the word, and at the end all
        n_bad, n_good = bad[-1] + 0.5, good[-1] + 0.5
        shares = [(x[:-1] + RARE * n / (n_bad + n_good)) / n for x, n in ((bad, n_bad), (good, n_good))]
        self.word_odds = (np.log(shares[1]) - np.log(shares[0])).astype("float32")
        self.lines = [(1.0, 0.0), (1.0, 0.0)]
        self.prior = 0.0

    def raw(self, batch: pa.RecordBatch, coded: list[bytes]) -> np.ndarray:
        """A row for each document: the mean log odds of its features in each view; none is 0. Those of words and shapes add up."""
        out = np.zeros((batch.num_rows, 2))
        for view, (i, n) in enumerate((("shape", "shape_n"), ("fact", "fact_n"))):
            ids, sizes = batch.column(i), np.diff(batch.column(i).offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            weight = batch.column(n).flatten().to_numpy()
            total = np.bincount(row, weight, batch.num_rows)
            value = np.bincount(row, weight * self.odds[view][ids.flatten().to_numpy()], batch.num_rows)
            out[:, view] = value / (total + FEW)
        row, bucket = word_buckets(coded)
        out[:, 0] += np.bincount(row, self.word_odds[bucket], batch.num_rows) / (np.bincount(row, minlength=batch.num_rows) + FEW)
        return out

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """The log odds of good quality by each view, and by both together: what each adds to the prior."""
        each = np.stack([a * raw[:, v] + b for v, (a, b) in enumerate(self.lines)], axis=1)
        return np.column_stack([each, each.sum(axis=1) - self.prior])


def _line(score: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable, by Newton's method; the counts at the scores are what there is to fit."""
    n = good + bad
    a, b = 0.0, float(np.log((good.sum() + 1) / (bad.sum() + 1)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([((good - n * p) * score).sum() - 1e-3 * a, (good - n * p).sum()])
        h = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum()]])
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(0.0, float(a)), float(b)


def drawn_labels(labels: DataFrame, *, doc_id: str, quality: str, labelled: int) -> DataFrame:
    """`(key, label)` of about `labelled` documents at most: a hash of the id, and the majority of its labels, good in a tie."""
    told = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull())
    known = settle(told.groupBy(F.col(doc_id).alias("doc_id")).agg((F.avg(quality) >= 0.5).cast("int").alias("label")))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 32)) * n < F.lit(labelled) * F.lit(1 << 32)
    chosen = known if n <= labelled else known.where(draw)
    return chosen.select(F.xxhash64(F.col("doc_id").cast("string")).alias("key"), "label")


def features(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, quality: str, labelled: int = LABELLED) -> DataFrame:
    """What both views see of each row, with its label (0, 1 or null) and whether it calibrates.

    Neither texts nor features move: the drawn labels, whose number is bounded, are sent to where the documents are read.
    They are told by a 64-bit hash of the id.
    """

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            shapes = [word_shapes(x) for x in texts]
            ids = [[zlib.crc32(k) % SHAPES for k in s] for s in shapes]
            facts = [_facts(*x) for x in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)])]
            ints = pa.list_(pa.int32())
            columns = [batch.column(0), pa.array(ids, ints), pa.array([list(s.values()) for s in shapes], ints), pa.array(facts, ints), pa.array([[1] * len(x) for x in facts], ints), pa.array([hashed_words(x) for x in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shape", "shape_n", "fact", "fact_n", "words"])

    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))])
    seen = named.mapInArrow(see, f"doc_id {kind}, shape array<int>, shape_n array<int>, fact array<int>, fact_n array<int>, words binary")
    known = drawn_labels(labels, doc_id=doc_id, quality=quality, labelled=labelled).dropDuplicates(["key"])
    keyed = seen.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string"))))
    told = keyed.join(F.broadcast(known), "key", "left").drop("key")
    return settle(told.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(CALIBRATE)) == 0))


def _learn(rows: DataFrame, views: Views | None) -> Views:
    """Counts over all rows: labels teach both views, what one view is sure of teaches the other."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {(v, c): np.zeros(n) for v, n in ((0, SHAPES), (1, FACTS), (2, WORDS + 1)) for c in (0, 1)}
        for batch, coded in pieces(batches, "words"):
            label = batch.column("label").fill_null(-1).to_numpy()
            own = np.where(batch.column("calibrates").to_numpy(zero_copy_only=False), -2, label)
            told = np.stack([own, own])
            if views is not None:
                odds = views.calibrated(views.raw(batch, coded))
                limit = np.log(SURE / (1 - SURE))
                for v in (0, 1):
                    other = odds[:, 1 - v]
                    told[v] = np.where(label != -1, own, np.where(other > limit, 1, np.where(other < -limit, 0, -1)))
            for v, (i, n) in enumerate((("shape", "shape_n"), ("fact", "fact_n"))):
                row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(i).offsets.to_numpy()))
                ids, weight = batch.column(i).flatten().to_numpy(), batch.column(n).flatten().to_numpy()
                share = weight / np.maximum(np.bincount(row, weight, batch.num_rows), 1)[row]  # a long document counts as one
                for c in (0, 1):
                    mine = told[v][row] == c
                    totals[v, c] += np.bincount(ids[mine], share[mine], len(totals[v, c]))
            row, bucket = word_buckets(coded)
            for c in (0, 1):
                mine = told[0] == c
                totals[2, c] += np.bincount(bucket[mine[row]], minlength=WORDS + 1)
                totals[2, c][WORDS] += mine.sum()
        for (v, c), x in totals.items():
            used = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), v)), pa.array(np.full(len(used), c)), pa.array(used), pa.array(x[used])], ["view", "label", "feature", "n"])

    # Few tasks that stream over many rows: each gives as many sums as there are features.
    few = rows.coalesce(max(2, rows.sparkSession.sparkContext.defaultParallelism))
    sums = few.mapInArrow(count, "view long, label long, feature long, n double").groupBy("view", "label", "feature").agg(F.sum("n").alias("n"))
    counts: dict[tuple[int, int], np.ndarray] = {}
    found = sums.toArrow()  # at most two numbers for each feature
    view, label, feature, n = (found.column(i).to_numpy() for i in range(4))
    for v, size in ((0, SHAPES), (1, FACTS), (2, WORDS + 1)):
        for c in (0, 1):
            mine = (view == v) & (label == c)
            counts[v, c] = np.zeros(size)
            counts[v, c][feature[mine]] = n[mine]
    return Views(counts)


def _calibrate(rows: DataFrame, views: Views) -> None:
    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, coded in pieces(batches, "words"):
            at = np.clip(np.round(views.raw(batch, coded) / _WIDTH), -_BINS, _BINS).astype("int64")
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(at[:, 0]), pa.array(at[:, 1])], ["label", "b0", "b1"])

    found = rows.where("calibrates and label is not null").mapInArrow(bins, "label int, b0 long, b1 long")
    seen = found.select("label", F.posexplode(F.array("b0", "b1")).alias("view", "b")).groupBy("view", "b", "label").count().collect()
    for view in (0, 1):
        score = np.arange(-_BINS, _BINS + 1) * _WIDTH
        good, bad = (np.array([0.0] * len(score)) for _ in range(2))
        for r in seen:
            if r["view"] == view:
                (good if r["label"] else bad)[r["b"] + _BINS] += r["count"]
        views.lines[view] = _line(score, good, bad)
        views.prior = float(np.log((good.sum() + 1) / (bad.sum() + 1)))


def quality_scores(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", rounds: int = ROUNDS, labelled: int = LABELLED) -> DataFrame:
    """`(doc_id, p_content, p_metadata, score, kept)` of every row: the probability of good quality by each view and by both,
    and whether the last is at least one half.

    Whole texts are seen. `lang`, `source` and `n_chars` are used where there are such columns; nulls are values of their
    own. A null or empty text has no words, so the text view says only what is usual. A document with several labels has
    their majority, good in a tie; repeated rows are scored alike and each counts; a row without an id has no label.
    Without labels of both kinds nothing is told apart and everything is kept. An empty table gives an empty one. Of more
    than `labelled` labelled documents about so many are drawn by a hash of the id; the others count as unlabelled.
    """
    rows = features(docs, labels, doc_id=doc_id, text=text, quality=quality, labelled=labelled)
    views = None
    for _ in range(rounds + 1):
        views = _learn(rows, views)
        _calibrate(rows, views)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, coded in pieces(batches, "words"):
            p = 1 / (1 + np.exp(-np.clip(views.calibrated(views.raw(batch, coded)), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(p[:, i]) for i in range(3)], pa.array(p[:, 2] >= 0.5)], ["doc_id", "p_content", "p_metadata", "score", "kept"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, p_content double, p_metadata double, score double, kept boolean")
