"""Two-pass external shuffle of records into shards, with DataFrame functions only.

Pass one counts, from the ids alone, how many records each bucket gets, and scatters the records: a seeded hash of the id
names the shard (the highest of one hash a shard, so that a further shard only takes records away), another one the bucket
inside it, with as many buckets as keep each within a memory-sized target. Pass two brings each bucket into one row,
permutes it by Spark's `shuffle`, which is a seeded Fisher-Yates, and numbers the records after those of the earlier
buckets. Nothing larger than a bucket is ever in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType
from pyspark.sql.window import Window

#: Records in a bucket, on average. At a few kB each that is some MB in memory.
BUCKET_ROWS = 1000
#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 16 << 20


def _hash(key: Column, *salt: Column | int) -> Column:
    return F.xxhash64(key, *[F.lit(x) if isinstance(x, int) else x for x in salt])


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: decided by the key and the number of shards; with one more, records move only into that one."""
    ranked = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(_hash(key, s, seed).alias("h"), s.alias("shard")))
    return F.array_max(ranked)["shard"]


def bucketed(rows: DataFrame, key: str, shards: int, seed: int, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, Column]:
    """The number of buckets of a shard, from the rows and from the bytes of their texts, and the bucket of a row.

    The key decides the shard; the whole record decides the bucket in it, so that rows of one key are spread.
    """
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in rows.schema if isinstance(f.dataType, (StringType, BinaryType))]
    size = rows.agg(F.count("*").alias("n"), F.sum(sum(wide, F.lit(0).cast("long"))).alias("bytes")).first()
    buckets = max(1, -(-size["n"] // (bucket_rows * shards)), -(-(size["bytes"] or 0) // (bucket_bytes * shards)))
    inside = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns], F.lit(seed + 1)), F.lit(buckets))
    return buckets, (shard_of(F.col(key), shards, seed) * F.lit(buckets).cast("long") + inside).alias("_bucket")


def shuffled_shards(records: DataFrame, key: str, shards: int, *, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All records with `shard` (0 to `shards` - 1), `slot` (place in the shard, gapless from 0) and `grown_shard`
    (the shard, were there one more).

    The order is a seeded permutation: the same for the same input, however often a task runs. A null key is a key like
    others; records of one key share a shard, but only those that are equal in all columns share a bucket for certain, and
    a bucket passes through one task. Equal records are all kept. An empty table gives an empty one. Columns of the records with the names of the new ones are replaced.
    """
    spark = records.sparkSession
    fields = [c for c in records.columns if c not in ("shard", "slot", "grown_shard")]
    rows = records.select("*") if len(fields) == len(records.columns) else records.select(*fields)
    buckets, bucket = bucketed(rows, key, shards, seed, bucket_rows)

    shard = F.expr(f"cast(_bucket div {buckets} as int)")
    counts = rows.select(bucket).groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-buckets * shards // 8))
    record = F.struct(F.xxhash64(key, F.lit(seed)).alias("_h"), F.struct(*fields).alias("r"))
    gathered = (
        rows.select(bucket, record.alias("_record"))
        .repartition(tasks, "_bucket")
        .groupBy("_bucket")
        .agg(F.sort_array(F.collect_list("_record")).alias("_records"))
        .join(first, "_bucket")
        .sortWithinPartitions("_bucket")  # Fisher-Yates draws from one stream in each task: every bucket has its turn in it
    )
    return gathered.select("_bucket", "_first", F.posexplode(F.shuffle("_records", seed + 2)).alias("_at", "_record")).select(
        *[F.col("_record.r")[c].alias(c) for c in fields],
        shard.alias("shard"),
        (F.col("_first") + F.col("_at")).alias("slot"),
        shard_of(F.col("_record.r")[key], shards + 1, seed).alias("grown_shard"),
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Each shard in a folder of its own. A file holds whole buckets, in the order of their slots."""
    placed.write.partitionBy("shard").parquet(path)
