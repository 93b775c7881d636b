"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes decides where a text is cut: below the normal length only where many of its bits are zero,
beyond it where few are, so that lengths gather around the normal one. An insertion moves only the cuts near it. The
fingerprint is the set of the chunks' digests with their lengths; how much of a document another one contains is the length
of the chunks that both have over the length of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from voxlake.llm.batches import BYTE_VALUES, RollingHash

SHORTEST, NORMAL, LONGEST = 12, 32, 128
#: Zero bits asked for before and beyond the normal length.
HARD, EASY = np.uint32(0xFC000000), np.uint32(0xE0000000)
_GEAR = (BYTE_VALUES >> np.uint64(32)).astype("uint32")
_ENTRY = np.dtype([("digest", "<u8"), ("length", "<u2")])


def cuts(data: bytes) -> np.ndarray:
    """Where the chunks end."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype="int64")
    h = _GEAR[np.frombuffer(data, "uint8")]
    for step in (1, 2, 4, 8, 16):  # h[i] = sum of gear[byte i - j] << j for j < 32
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    hard = (np.flatnonzero((h & HARD) == 0) + 1).tolist()
    easy = (np.flatnonzero((h & EASY) == 0) + 1).tolist()
    hard.append(n)
    easy.append(n)
    out, start, i, j = [], 0, 0, 0
    while start < n:
        while hard[i] < start + SHORTEST and hard[i] < n:
            i += 1
        end = hard[i]
        if end > start + NORMAL:
            while easy[j] < start + NORMAL and easy[j] < n:
                j += 1
            end = min(easy[j], start + LONGEST)
        out.append(end)
        start = end
    return np.array(out)


def fingerprint(data: bytes) -> np.ndarray:
    """The chunks' digests and lengths, in the order of the digests, each once."""
    end = cuts(data)
    start = np.concatenate([[0], end[:-1]]).astype("int64")
    out = np.zeros(len(end), dtype=_ENTRY)
    if len(end):
        out["digest"], out["length"] = RollingHash(data).of(start, end), end - start
        _, first = np.unique(out["digest"], return_index=True)
        out = out[first]
    return out


def containment(own: np.ndarray, other: np.ndarray) -> float:
    """The part of `own`, by length, that `other` has; of nothing, all is in nothing and none in anything else."""
    if not len(own):
        return float(not len(other))
    shared = np.isin(own["digest"], other["digest"], assume_unique=True)
    return float(own["length"][shared].sum() / own["length"].sum())


def to_text(entries: np.ndarray) -> str:
    return base64.b64encode(entries.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=_ENTRY)


def edited(text: str, following: str) -> str:
    """The last half of the text, rounded down, gives way to as many characters from the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _borders(docs: DataFrame, buckets: int) -> list:
    """Ids that cut the table in about equal parts: quantiles of numbers, or of 16 ids a bucket that a hash draws."""
    if isinstance(docs.schema["doc_id"].dataType, NumericType):
        return sorted(set(docs.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))))
    drawn = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).orderBy("h", "doc_id").limit(16 * buckets)
    ids = sorted(r["doc_id"] for r in drawn.collect())
    return sorted({ids[i * len(ids) // buckets] for i in range(1, buckets)}) if ids else []


def _followed(docs: DataFrame, per_bucket: int) -> DataFrame:
    """Rows in buckets of falling ids, as `(_bucket, _guest, doc_id, text)`. Each bucket also has, as a guest, the row that
    comes after its last one; after the very last, the first.

    The buckets' borders are quantiles of the ids, so that the texts move once; the ids that start buckets are few.
    """
    n = docs.count()
    spark = docs.sparkSession
    buckets = max(1, min(4096, -(-n // per_bucket)))
    borders = _borders(docs.where("doc_id is not null"), buckets) if buckets > 1 else []
    below = F.array(*[F.lit(x) for x in borders]) if borders else None
    place = F.lit(0) if below is None else F.aggregate(below, F.lit(0), lambda n, b: n + F.when(F.col("doc_id") <= b, 1).otherwise(0))
    # Falling ids, nulls at the end: bucket 0 has the largest ids.
    placed = docs.withColumn("_bucket", F.when(F.col("doc_id").isNull(), F.lit(len(borders) + 1)).otherwise(place).cast("int"))
    heads = sorted((r["_bucket"], r["head"]) for r in placed.select("_bucket", "doc_id").groupBy("_bucket").agg(F.max("doc_id").alias("head")).collect())
    targets = {}
    for (_, head), (bucket, _) in zip(heads, [heads[-1], *heads[:-1]] if heads else []):
        targets.setdefault(head, []).append(bucket)
    named = [(k, v) for k, vs in targets.items() for v in vs if k is not None]
    kind = docs.schema["doc_id"].dataType.simpleString()
    starts = spark.createDataFrame(named, f"doc_id {kind}, _to int")
    guests = docs.join(F.broadcast(starts), "doc_id").select("doc_id", "text", F.col("_to").alias("_bucket"), F.lit(True).alias("_guest"))
    if None in targets:
        guests = guests.union(docs.where("doc_id is null").select("doc_id", "text", F.lit(targets[None][0]).alias("_bucket"), F.lit(True)).orderBy(F.xxhash64("text"), "text").limit(1))
    everyone = placed.select("doc_id", "text", "_bucket", F.lit(False).alias("_guest")).union(guests.select("doc_id", "text", "_bucket", "_guest"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(heads) // 8))
    return everyone.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", per_bucket: int = 1024) -> DataFrame:
    """For each row: `doc_id`, `n_chars`, `edited_text_sha256`, the `fingerprint` of the text, that of the text edited with
    the next document, and how much of the first fingerprint is in the second (`near_edited`) and in that of the next
    document (`near_next`).

    The next document has the next smaller id; rows of one id follow each other by their texts' hashes, a null id comes
    last, and after the last row comes the first. A null text is empty. A single row is followed by itself; equal texts
    have equal fingerprints; an empty table gives an empty one. Only the two columns named are read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, size = None, [], 0  # last: bucket, guest, id, text, fingerprint

        def result() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_kind), *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], names)

        for batch in batches:
            id_kind = batch.column(0).type
            for key, words, bucket, guest in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if last is not None and last[1] and last[0] == bucket:
                    continue  # a second row of a guest's id
                now = (bucket, guest, key, words, fingerprint(words.encode()))
                if last is not None and not last[1] and last[0] == bucket:
                    changed = edited(last[3], words).encode()
                    other = fingerprint(changed)
                    out.append((last[2], len(last[3]), hashlib.sha256(changed).hexdigest(), to_text(last[4]), to_text(other), containment(last[4], other), containment(last[4], now[4])))
                    size += len(last[3])
                    if size > 4 << 20:
                        yield result()
                        out, size = [], 0
                last = now
        if out:
            yield result()

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _followed(rows, per_bucket).mapInArrow(each, schema)
