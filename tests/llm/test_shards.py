import zlib
from collections import Counter

from voxlake.llm.shards import bucketed, shuffled_shards, write_shards


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, slot string, _h int")


ROWS = [(i, f"text {i % 7}" * (i % 50), "clash", i) for i in range(3000)] + [(3000, None, None, None), (None, "x", "s", 1), (3001, "", "", 2), (5, "text 5" * 5, "clash", 5), (3002, "z" * 400_000, "s", 3)]


def test_every_record_arrives_once_and_slots_have_no_gaps(spark):
    out = shuffled_shards(table(spark, ROWS), "doc_id", 6, bucket_rows=40).collect()
    assert Counter((r["doc_id"], r["text"], r["_h"]) for r in out) == Counter((r[0], r[1], r[3]) for r in ROWS)
    for s in range(6):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_one_more_shard_only_takes_records(spark):
    old = {r["doc_id"]: r for r in shuffled_shards(table(spark, ROWS), "doc_id", 6).collect()}
    new = {r["doc_id"]: r["shard"] for r in shuffled_shards(table(spark, ROWS), "doc_id", 7).collect()}
    assert all(new[k] == r["grown_shard"] and new[k] in (r["shard"], 6) for k, r in old.items())
    assert 200 < sum(v == 6 for v in new.values()) < 700


def test_order_is_repeatable_and_mixed(spark):
    def run(n):
        out = shuffled_shards(table(spark, ROWS).repartition(n), "doc_id", 3, bucket_rows=100).collect()
        return {(r["doc_id"], zlib.crc32((r["text"] or "").encode())): (r["shard"], r["slot"]) for r in out}

    first = run(1)
    assert first == run(5)
    ids = [k[0] for k, v in sorted(first.items(), key=lambda x: x[1]) if v[0] == 0 and k[0] is not None]
    assert 0.4 < sum(a < b for a, b in zip(ids, ids[1:])) / len(ids) < 0.6


def test_only_native_operators(spark, capsys):
    shuffled_shards(table(spark, ROWS), "doc_id", 6).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Arrow", "Pandas"))


def test_empty_table_and_files(spark, tmp_path):
    assert shuffled_shards(table(spark, []), "doc_id", 4).collect() == []
    placed = shuffled_shards(table(spark, ROWS), "doc_id", 4)
    write_shards(placed, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == [f"shard={i}" for i in range(4)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS)


def test_rows_of_one_key_are_spread_over_buckets(spark):
    """A third of the rows under one id, a third under none."""
    rows = [(i if i % 3 == 0 else 7 if i % 3 == 1 else None, f"text {i}", "s", i) for i in range(3000)]
    docs = table(spark, rows)
    buckets, bucket = bucketed(docs, "doc_id", 4, 17, bucket_rows=25)
    sizes = [r["count"] for r in docs.groupBy(bucket).count().collect()]
    assert buckets == 30 and max(sizes) < 130
    out = shuffled_shards(docs, "doc_id", 4, bucket_rows=25).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r[0], r[1]) for r in rows)
    assert len({r["shard"] for r in out if r["doc_id"] == 7}) == len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    for s in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_long_texts_make_more_buckets(spark):
    docs = table(spark, [(i, "x" * 1000, "s", i) for i in range(64)])
    assert bucketed(docs, "doc_id", 2, 17, bucket_bytes=4000)[0] == 9  # 64,064 bytes with the slots
