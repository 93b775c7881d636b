"""Removal of long byte strings that repeat anywhere in the corpus, by hashes of runs and, for the rest, by sorting suffixes by keys.

A string of `length` bytes repeats if the suffixes that start with it are neighbours in the sorted order. Two suffixes can be
that only if they share a leading token: the piece of `GRAM` bytes with the smallest hash among the first `length` bytes.
Suffixes in a row that have the same token at the same place form a run, which is the unit that moves:

1. Tokens are counted; runs whose token is met once hold nothing that repeats.
2. A run that occurs as a whole again (token, place and a hash of all its bytes) repeats from end to end.
3. The bytes of the other runs are range-partitioned by token with Spark's sampled splitters. A bucket sorts the suffixes of
   its runs key by key with lexsort (token, place, 16 bytes, then two hashes of the rest) and drops what stands alone at
   each key; what is left repeats. No order of suffixes by all their bytes comes about. Buckets share no token, except those of
4. tokens with very many runs: their suffixes are spread over all buckets by the whole key, and counted across them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.llm.batches import RollingHash, pieces
from voxlake.llm.filters import bitmap_of, passes
from voxlake.session import settle

LENGTH, GRAM = 400, 100
#: Runs of one token that a task sorts together: about 10 MB of text, and 150 MB to sort their suffixes.
HOT_RUNS = 16_384
_SEGMENT = 8 << 20
_PLACE = np.uint64(0xFFFFFF)
_RUN = "d1 long, d2 long, token long, whole long, first int, n int, lead int"


def runs(data: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The runs of a text's suffixes of at least `length` bytes: token, hash of all bytes, first start, number of starts,
    place of the token after the first start."""
    parts = []
    for base in range(0, max(1, len(data) - length + 1), _SEGMENT):
        part = data[base : base + _SEGMENT + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            continue
        hashes = RollingHash(part)
        grams = hashes.windows(gram)
        wide = length - gram + 1
        ranked = grams & ~_PLACE | np.arange(len(grams), dtype="uint64")  # by hash, then by place
        blocks = np.full(-(-len(ranked) // wide) * wide, ~np.uint64(0))
        blocks[: len(ranked)] = ranked
        blocks = blocks.reshape(-1, wide)
        rising = np.minimum.accumulate(blocks, axis=1).ravel()
        falling = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(falling[:n], rising[wide - 1 : wide - 1 + n]) & _PLACE).astype("int64")
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        after = np.concatenate([first[1:], [n]])
        at = at[first]
        parts.append((grams[at], hashes.of(first, after - 1 + length), first + base, after - first, at - first))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else ()


def _all_runs(docs: DataFrame, length: int, gram: int, tokens: Broadcast | None) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            d1, d2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = []
            for i, text in enumerate(texts):
                if found := runs(text, length, gram):
                    token, whole, first, n, lead = found
                    pick = slice(None) if tokens is None else passes(tokens, token)
                    token = token[pick]
                    out.append((np.full(len(token), d1[i]), np.full(len(token), d2[i]), token.view("int64"), whole[pick].view("int64"), *[x[pick].astype("int32") for x in (first, n, lead)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], [c.split(" ")[0] for c in _RUN.split(", ")])

    return docs.mapInArrow(find, _RUN)


def repeated_in_sorted_order(texts: list[bytes], token: np.ndarray, lead: np.ndarray, length: int) -> list[np.ndarray]:
    """For the suffixes of each run (its text less `length` - 1 bytes) whether they repeat, by lexsort key by key."""
    data = b"".join(texts) + bytes(16)
    size = np.array([len(t) for t in texts])
    many = size - length + 1
    run = np.repeat(np.arange(len(texts)), many)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    at = (np.cumsum(size) - size)[run] + inside
    hashes = RollingHash(data)
    bytes_at = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    keys = [
        lambda rows: token[run[rows]].view("uint64"),
        lambda rows: (lead[run[rows]] - inside[rows]).astype("uint64"),
        lambda rows: bytes_at[at[rows]].byteswap(),
        lambda rows: bytes_at[at[rows] + min(8, length - 8)].byteswap(),
        lambda rows: hashes.of(at[rows] + length // 8, at[rows] + length // 2),
        lambda rows: hashes.of(at[rows], at[rows] + length),
    ]
    rows, group = np.arange(len(run)), np.zeros(len(run), dtype="int64")
    for key in keys:
        value = key(rows)
        order = np.lexsort((value, group))
        rows, group, value = rows[order], group[order], value[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
        group = np.cumsum(new) - 1
        together = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        rows, group = rows[together], group[together]
        if not len(rows):
            break
    repeats = np.zeros(len(run), dtype=bool)
    repeats[rows] = True
    return np.split(repeats, np.cumsum(many)[:-1]) if len(texts) else []


def _spans(first: int, repeats: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], repeats.astype("int8"), [0]]))
    return first + np.flatnonzero(edges == 1), first + np.flatnonzero(edges == -1) - 1 + length


def _sorted_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of the runs `(d1, d2, token, first, lead, bytes)` that repeat in others of their token."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def result(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            marked = repeated_in_sorted_order([r[5] for r in rows], np.array([r[2] for r in rows]), np.array([r[4] for r in rows]), length)
            out = [(r[0], r[1], s, e) for r, x in zip(rows, marked) if x.any() for s, e in zip(*_spans(r[3], x, length))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["d1", "d2", "start", "end"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size > 1 << 20 and row[2] != held[-1][2]:
                    yield from result(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from result(held)

    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = contexts.repartitionByRange(n, "token").sortWithinPartitions("token")
    return bucketed.select("d1", "d2", "token", "first", "lead", "bytes").mapInArrow(sort, "d1 long, d2 long, start long, end long")


def _across_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """The same for tokens with very many runs: every suffix by itself, as hashes, combined before it moves."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d1, d2, token, first, lead, raw in zip(*[c.to_pylist() for c in batch.columns]):
                whole = RollingHash(raw).windows(length)
                half = RollingHash(raw).windows(length // 2)[: len(whole)]
                n = len(whole)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, v)) for v in (d1, d2, token)] + [pa.array(first + np.arange(n)), pa.array(lead - np.arange(n)), pa.array(whole.view("int64")), pa.array(half.view("int64"))],
                    ["d1", "d2", "token", "start", "place", "whole", "half"],
                )

    spread = contexts.select("d1", "d2", "token", F.col("first").cast("long"), F.col("lead").cast("long"), "bytes").mapInArrow(suffixes, "d1 long, d2 long, token long, start long, place long, whole long, half long")
    key = ["token", "place", "whole", "half"]
    often = settle(spread.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1").select(*key))
    return spread.join(often, key, "left_semi").select("d1", "d2", "start", (F.col("start") + length).alias("end"))


def identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows as `(d1, d2, row, text)`: two hashes of id and text together, nulls told from empty, and all other columns."""
    missing = F.concat_ws("", F.col(doc_id).isNull().cast("string"), F.col(text).isNull().cast("string"))
    return docs.select(
        F.xxhash64(doc_id, text, missing).alias("d1"),
        F.xxhash64(F.lit(7), missing, text, doc_id).alias("d2"),
        F.struct(*[c for c in docs.columns if c != text]).alias("row"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """`(d1, d2, spans)` for each distinct (id, text) with bytes that a repeated string of `length` bytes covers; d1 and d2
    are hashes that name it (see `identified`), the spans may overlap."""
    texts = identified(docs, doc_id, text).select("d1", "d2", "text")
    tokens = settle(_all_runs(texts, length, gram, None).groupBy("token").agg(F.count("*").alias("m")).where("m > 1"))
    likely = settle(_all_runs(texts, length, gram, bitmap_of(tokens, "token")).join(tokens, "token"))
    same = ["token", "whole", "n", "lead"]
    again = settle(likely.groupBy(*same).agg(F.count("*").alias("c"), F.min(F.struct("d1", "d2", "first", "m")).alias("x")).where("c > 1"))
    whole = likely.join(again.select(*same), same, "left_semi").select("d1", "d2", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("n") - 1 + length).cast("long").alias("end"))
    alone = likely.join(again.select(*same), same, "left_anti")
    # One of the runs that occur again stands for all: the other runs of its token may still repeat a part of it.
    other = alone.unionByName(again.select("x.d1", "x.d2", "token", "whole", "x.first", "n", "lead", "x.m"))
    open_tokens = settle(alone.select("token").distinct())
    parts = settle(other.join(open_tokens, "token", "left_semi").groupBy("d1", "d2").agg(F.collect_list(F.struct("token", "first", "n", "lead", "m")).alias("runs")))
    known = bitmap_of(parts, "d1")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(known, batch.column(0).to_numpy())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in pieces(batches, "text"):
            rows = []
            for d1, d2, found, data in zip(*[batch.column(i).to_pylist() for i in range(3)], raw):
                rows += [(d1, d2, r["token"], r["first"], r["lead"], data[r["first"] : r["first"] + r["n"] - 1 + length], r["m"]) for r in found]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["d1", "d2", "token", "first", "lead", "bytes", "m"])

    own = texts.mapInArrow(needed, texts.schema)
    contexts = own.join(parts, ["d1", "d2"]).select("d1", "d2", "runs", "text").mapInArrow(cut, "d1 long, d2 long, token long, first int, lead int, bytes binary, m long")
    contexts = settle(contexts)
    few = _sorted_buckets(contexts.where(F.col("m") <= hot_runs), length)
    many = _across_buckets(contexts.where(F.col("m") > hot_runs), length)
    found = whole.union(few).union(many).groupBy("d1", "d2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return settle(found)


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Every row as `(row, n_bytes, n_removed, spans, kept, text)`: all its columns but the text in `row`, the bytes of its text, how many of them
    a string of `length` bytes covers that starts also anywhere else (in this or another text of the input, overlaps
    included), the maximal removed runs as ascending `(start, end)`, the remaining bytes, and these as `text`, without
    characters that were cut in two.

    Texts are UTF-8 and are judged whole, before anything is removed; strings never cross texts. A null text is empty, and
    one shorter than `length` is kept as it is. Rows that repeat lose what they repeat, all of them. Any columns may be
    there, under any names. An empty table gives an empty one.
    """
    spans = repeated_spans(docs, doc_id=doc_id, text=text, length=length, gram=gram, hot_runs=hot_runs)
    joined = identified(docs, doc_id, text).join(spans, ["d1", "d2"], "left").select("row", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            sizes, removed, merged, kept = [], [], [], []
            for found, data in zip(batch.column(2).to_pylist(), texts):
                runs_, at, left = [], 0, []
                for x in sorted(found or [], key=lambda x: x["start"]):
                    if runs_ and x["start"] <= runs_[-1]["end"]:
                        runs_[-1]["end"] = max(runs_[-1]["end"], x["end"])
                    else:
                        runs_.append(dict(x))
                for x in runs_:
                    left.append(data[at : x["start"]])
                    at = x["end"]
                left.append(data[at:])
                sizes.append(len(data))
                removed.append(sum(x["end"] - x["start"] for x in runs_))
                merged.append(runs_)
                kept.append(b"".join(left))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())], ["row", "n_bytes", "n_removed", "spans", "kept", "text"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = joined.select("row").schema.add("n_bytes", "long").add("n_removed", "long").add("spans", span).add("kept", "binary").add("text", "string")
    return joined.mapInArrow(remove, out)
