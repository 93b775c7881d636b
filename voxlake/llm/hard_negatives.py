"""Hard negatives by angular triangle filtering.

The angles of every row to a few reference directions are stored once. For an anchor and a window of rows they give, by the
triangle inequality, an interval of the angle between the two; its cosines times the norms bound the score, with room for
rounding. Rows are sorted by label, nearest reference and angle, so that the windows are narrow. Windows whose bounds don't
overlap what an anchor still looks for are passed over, the others get integer scores.

The anchors come in blocks of bounded size. For each block all rows are read twice, in place: once for the positives, once
for the negatives that fit them. A task keeps the best few for each anchor of the block, and they meet by anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.session import settle

#: Reference directions, chosen one after the other, each the farthest from those before, among so many rows.
REFERENCES, REFERENCE_SAMPLE = 16, 256
#: Bytes of anchors, as 64-bit numbers, that a block takes at most.
BLOCK_BYTES = 32 << 20
#: Rows of a window, and anchors that are bounded or scored at once.
WINDOW, ANCHORS_AT_ONCE = 256, 4096
#: More than what 32-bit angles and the arc cosine lose together.
ANGLE_SLACK = 2e-6


@dataclass
class Layout:
    """How vectors of whole numbers are stored and multiplied without loss."""

    dims: int
    largest: float
    scale: int
    window: int = WINDOW

    @property
    def stored(self) -> str:
        return "<i2" if self.largest < 1 << 15 else "<i4" if self.largest < 1 << 31 else "<f8"

    @property
    def exact(self) -> type:
        """A type in which no sum of products loses a digit."""
        most = self.largest * self.largest * max(1, self.dims)
        return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object

    def vectors(self, column: pa.Array) -> np.ndarray:
        raw = b"".join(column.to_pylist())
        return np.frombuffer(raw, self.stored).reshape(len(column), self.dims)

    def numbers(self, whole: np.ndarray) -> np.ndarray:
        if self.exact is object:
            return np.array([[int(v) for v in row] for row in whole.tolist()], object).reshape(whole.shape)
        return whole.astype(self.exact)


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype("float64") ** 2).sum(axis=1))


def _angles(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Radians to unit directions; a null vector is at a right angle to all."""
    norms = _norms(vectors)
    cosines = vectors.astype("float64") @ directions.T / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1)).astype("<f4")


def _directions(rows: DataFrame, layout: Layout) -> np.ndarray:
    """Unit vectors of REFERENCES rows, or fewer, out of REFERENCE_SAMPLE that a hash of the id draws."""
    sample = rows.orderBy(F.xxhash64("id"), "id", "label").limit(REFERENCE_SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    vectors = _padded(sample, layout.dims)
    norms = _norms(vectors)
    units = vectors[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.ones((1, layout.dims)) / max(1, layout.dims) ** 0.5
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(REFERENCES, len(units)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of one length; what a shorter one lacks is 0."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _windows(angles: np.ndarray, norms: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Least and greatest angles and norms of each window of consecutive rows."""
    at = np.arange(0, len(norms), size)
    return np.minimum.reduceat(angles, at), np.maximum.reduceat(angles, at), np.minimum.reduceat(norms, at), np.maximum.reduceat(norms, at)


def bounds(anchor_angles: np.ndarray, anchor_norms: np.ndarray, windows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and window the least and the greatest score that the angles allow, rounded away from each other."""
    low, high, least, most = windows
    a = anchor_angles.astype("float64")[:, None, :]
    low, high = low.astype("float64")[None], high.astype("float64")[None]
    nearest = np.maximum(np.maximum(a - high, low - a), 0).max(axis=2) - ANGLE_SLACK
    total_low, total_high = a + low, a + high
    farthest = np.where(total_high <= np.pi, total_high, np.where(total_low >= np.pi, 2 * np.pi - total_low, np.pi)).min(axis=2) + ANGLE_SLACK
    upper, lower = np.cos(np.maximum(nearest, 0)), np.cos(np.minimum(farthest, np.pi))
    norm = anchor_norms[:, None]
    greatest = upper * norm * np.where(upper > 0, most, least)
    smallest = lower * norm * np.where(lower > 0, least, most)
    room = 1 + 1e-9 * norm * most
    return np.floor(smallest - room), np.ceil(greatest + room)


class Best:
    """The first few (score, id) of each slot: higher scores first, ties by smaller id."""

    def __init__(self, size: int, floor: np.ndarray):
        """`floor`: what a score must reach in each slot as long as that is not full."""
        self.size = size
        self.slot, self.score, self.id = (np.zeros(0, "int64") for _ in range(3))
        self.needed = floor.copy()

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.zeros(len(self.needed), bool)
        touched[slot] = True
        old = touched[self.slot]
        slot, score, ids = (np.concatenate([a[old], b]) for a, b in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
        last = rank == self.size - 1
        self.needed[slot[last]] = score[last]
        keep = rank < self.size
        self.slot, self.score, self.id = (np.concatenate([a[~old], b[keep]]) for a, b in ((self.slot, slot), (self.score, score), (self.id, ids)))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    yield from zip(cut[:-1].tolist(), cut[1:].tolist())


@dataclass
class Block:
    """Anchors, sorted by label."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # as stored
    angles: np.ndarray

    def of_label(self, label: object) -> tuple[int, int]:
        a, b = np.searchsorted(self.labels, [label], "left")[0], np.searchsorted(self.labels, [label], "right")[0]
        return int(a), int(b)


def _parsed(batch: pa.RecordBatch, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    vectors = layout.vectors(batch.column(2))
    angles = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<f4").reshape(len(ids), -1)
    return ids, labels, vectors, angles


def _scored(layout: Layout, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left @ right.T).astype("int64")


def _find_positives(rows: DataFrame, block: Block, layout: Layout, size: int) -> DataFrame:
    """`(slot, score, id)`: of each anchor of the block, in each task, the best rows of its label."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        norms, numbers = _norms(block.vectors), layout.numbers(block.vectors)
        best = Best(size, np.full(len(block.ids), np.iinfo("int64").min + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, vectors, angles = _parsed(batch, layout)
            for a, b in _runs(labels):
                first, end = block.of_label(labels[a])
                for c in range(first, end, ANCHORS_AT_ONCE):
                    d = min(end, c + ANCHORS_AT_ONCE)
                    _, upper = bounds(block.angles[c:d], norms[c:d], _windows(angles[a:b], _norms(vectors[a:b]), layout.window))
                    for w, at in enumerate(range(a, b, layout.window)):
                        open_ = np.flatnonzero(upper[:, w] >= best.needed[c:d]) + c
                        if not len(open_):
                            continue
                        to = min(b, at + layout.window)
                        scores = _scored(layout, numbers[open_], layout.numbers(vectors[at:to]))
                        i, j = np.nonzero((scores >= best.needed[open_][:, None]) & (block.ids[open_][:, None] != ids[None, at:to]))
                        best.add(open_[i], scores[i, j], ids[at + j])
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.score), pa.array(best.id)], ["slot", "score", "id"])

    return rows.mapInArrow(search, "slot long, score long, id long")


def _find_negatives(rows: DataFrame, block: Block, positives: np.ndarray, layout: Layout, size: int, span: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """`(slot, score, id)` with slot = anchor * positives + number of the positive: rows of other labels in its span of scores.

    `positives` holds the scores (anchors x positives), the least long where there is none.
    """
    shared = rows.sparkSession.sparkContext.broadcast((block, positives))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, positives = shared.value
        norms, numbers = _norms(block.vectors), layout.numbers(block.vectors)
        k = positives.shape[1]
        none = positives == np.iinfo("int64").min
        low, high = span(np.where(none, 0, positives))
        low, high = np.where(none, np.iinfo("int64").max, low), np.where(none, np.iinfo("int64").min, high)
        best = Best(size, low.ravel())
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, vectors, angles = _parsed(batch, layout)
            spans = _windows(angles, _norms(vectors), layout.window)
            for c in range(0, len(norms), ANCHORS_AT_ONCE):
                d = min(len(norms), c + ANCHORS_AT_ONCE)
                lower, upper = bounds(block.angles[c:d], norms[c:d], spans)
                for w, at in enumerate(range(0, len(ids), layout.window)):
                    to = min(len(ids), at + layout.window)
                    needed = best.needed.reshape(-1, k)[c:d]
                    overlap = (upper[:, w, None] >= needed) & (lower[:, w, None] <= high[c:d]) & (needed <= high[c:d])
                    if labels[at] == labels[to - 1] == labels[at:to].min() == labels[at:to].max():
                        overlap &= (block.labels[c:d] != labels[at])[:, None]
                    open_ = np.flatnonzero(overlap.any(axis=1))
                    if not len(open_):
                        continue
                    scores = _scored(layout, numbers[open_ + c], layout.numbers(vectors[at:to]))
                    i, j = np.nonzero(scores >= needed[open_].min(axis=1)[:, None])
                    other = block.labels[open_[i] + c] != labels[at + j]
                    i, j = i[other], j[other]
                    score, anchor = scores[i, j], open_[i] + c
                    fits = (score[:, None] >= best.needed.reshape(-1, k)[anchor]) & (score[:, None] <= high[anchor])
                    x, p = np.nonzero(fits)
                    best.add(anchor[x] * k + p, score[x], ids[at + j[x]])
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.score), pa.array(best.id)], ["slot", "score", "id"])

    return rows.mapInArrow(search, "slot long, score long, id long")


def _first(found: DataFrame, size: int) -> DataFrame:
    """The best of what the tasks have found for each slot, with its rank from 1."""
    best = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)


def stored_angles(rows: DataFrame, layout: Layout, directions: np.ndarray) -> DataFrame:
    """`(id, label, vector, angles, anchor)`, by label, nearest direction and angle; a row that is there again is left out."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            whole = np.floor(_padded(column if isinstance(column, pa.ListArray) else column.cast(pa.list_(pa.float64())), layout.dims) * layout.scale)
            angles = _angles(whole, directions)
            home = angles.argmin(axis=1).astype("int32") if len(angles) else np.zeros(0, "int32")
            own = angles[np.arange(len(home)), home].astype("float32")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([x.tobytes() for x in whole.astype(layout.stored)], pa.binary()),
                    pa.array([x.tobytes() for x in angles], pa.binary()),
                    batch.column(3),
                    pa.array(home),
                    pa.array(own),
                ],
                ["id", "label", "vector", "angles", "anchor", "home", "angle"],
            )

    out = f"id {kinds['id']}, label {kinds['label']}, vector binary, angles binary, anchor boolean, home int, angle float"
    placed = rows.select("id", "label", "vector", "anchor").mapInArrow(measure, out)
    ordered = placed.repartitionByRange("label", "home", "angle", "id").sortWithinPartitions("label", "home", "angle", "id", "vector")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            new = [x != y for x, y in zip(keys, [before, *keys])]
            before = keys[-1] if keys else before
            yield batch.select([0, 1, 2, 3, 4]).filter(pa.array(new, pa.bool_()))

    return settle(ordered.mapInArrow(once, out.rsplit(", home", 1)[0]))


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    *,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)` for the rows where `anchor` holds.

    Each component x counts as floor(scale * x). An anchor's positives are the first `positives` other rows of its label;
    for each of them come the first `negatives` rows of other labels whose score is from `least` to `most` percent of the
    positive's. Scores are exact inner products, higher ones come first, ties by smaller id. Ids are whole numbers.

    A row without id, label or vector or with a null or non-finite component takes no part. A row that is there again with
    the same label and vector counts once; rows with one id and other vectors are rows of their own, but no partners of
    each other. Vectors of unlike length are filled up with zeros. An empty table, or none of a label, gives no rows.
    Scores must fit 64 bits. Of other columns none is read.
    """
    x = F.col("vector")
    kept = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & sound)
    largest = F.max(F.greatest(F.abs(F.array_max(x)), F.abs(F.array_min(x))))
    shape = kept.agg(F.max(F.size(x)).alias("dims"), largest.alias("largest")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if shape["dims"] is None:
        return rows.sparkSession.createDataFrame([], out)
    layout = Layout(max(1, shape["dims"]), (shape["largest"] or 0.0) * scale + 1, scale, window)
    stored = stored_angles(kept, layout, _directions(kept, layout))

    anchors = stored.where("anchor")
    limit = max(1, block_bytes // (8 * layout.dims))
    count = -(-2 * anchors.count() // limit)
    while count:  # blocks by a hash of the id, until the largest keeps to the limit
        number = F.pmod(F.xxhash64("id"), F.lit(count))
        if anchors.groupBy(number).count().agg(F.max("count")).first()[0] <= limit:
            break
        count *= 2

    span = lambda p: (-(-least * p // 100), most * p // 100)
    results = None
    for i in range(count):
        table = anchors.where(F.pmod(F.xxhash64("id"), F.lit(count)) == i).orderBy("label", "id").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        block = Block(*_parsed(table.to_batches()[0], layout))
        found = _first(_find_positives(stored, block, layout, positives), positives).toArrow()
        slot, rank = found.column("slot").to_numpy(), found.column("rank").to_numpy() - 1
        scores = np.full((len(block.ids), positives), np.iinfo("int64").min)
        scores[slot, rank] = found.column("score").to_numpy()
        partners = np.zeros_like(scores)
        partners[slot, rank] = found.column("id").to_numpy()
        near = _first(_find_negatives(stored, block, scores, layout, negatives, span), negatives)
        named = rows.sparkSession.sparkContext.broadcast((block.ids, partners, scores))

        def name(batches: Iterator[pa.RecordBatch], named=named) -> Iterator[pa.RecordBatch]:
            ids, partners, scores = named.value
            for batch in batches:
                slot = batch.column(0).to_numpy()
                a, p = slot // partners.shape[1], slot % partners.shape[1]
                columns = [pa.array(ids[a]), pa.array(partners[a, p]), batch.column(1), batch.column(2), pa.array(scores[a, p]), batch.column(3)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        part = settle(near.select("slot", "rank", "id", "score").mapInArrow(name, out))
        results = part if results is None else results.unionByName(part)
    return rows.sparkSession.createDataFrame([], out) if results is None else results
