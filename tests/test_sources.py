import datetime as dt
import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from voxlake.functions import text as tx
from voxlake.sources import readers, tables

NAMES = ["Iva Lund", "Bo", "Zoë d'Arc", "N. 7 Quist-Ek"]


def record(i):
    """Metadata of made-up call number i: an hour and i minutes after day i, i + 2.25 seconds long."""
    start = (i * 86_400 + 3_600 + 60 * i) * 1000
    return {
        "sid": f"m{i:03d}", "start_time_ms": start, "end_time_ms": start + i * 1000 + 2250, "session": f"s{i % 3}",
        "agent": {"metadata": {"agent_name": NAMES[(i + 1) % 4]}, "speaker_id": i},
        "caller": {"metadata": {"first and last name": NAMES[i % 4]}, "speaker_id": i * 2},
        "labels": {"lhvb_script": 1.0, "caller_mos": i / 8, "agent_mos": None},
    }


def put(folder, name, obj):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_text(obj if isinstance(obj, str) else json.dumps(obj, indent=1), encoding="utf-8")


def test_metadata_of_many_files(spark, tmp_path):
    for i in range(40):
        put(tmp_path / "m", f"{i}.json", record(i))
    rows = readers.read_call_metadata(spark, str(tmp_path / "m")).orderBy("call_id").collect()
    day = dt.date(1970, 1, 1)
    assert [(r["call_id"], r["customer_name"], r["agent_name"], r["session"]) for r in rows] == [(f"m{i:03d}", NAMES[i % 4], NAMES[(i + 1) % 4], f"s{i % 3}") for i in range(40)]
    assert [(r["call_date"], r["duration_seconds"], r["caller_mos"]) for r in rows] == [(day + dt.timedelta(days=i), pytest.approx(i + 2.25), i / 8) for i in range(40)]
    slugs = {r["customer_name"]: r["customer_id"] for r in rows}
    assert slugs == {"Iva Lund": "iva-lund", "Bo": "bo", "Zoë d'Arc": "zo-d-arc", "N. 7 Quist-Ek": "n-7-quist-ek"}


@pytest.mark.parametrize(("path", "said"), [(("sid",), "sid"), (("caller", "metadata", "first and last name"), "first and last name"), (("agent", "metadata", "agent_name"), "agent_name"), (("end_time_ms",), "end_time_ms")])
def test_a_missing_field_fails_loudly(spark, tmp_path, path, said):
    broken = record(3)
    *above, last = path
    at = broken
    for k in above:
        at = at[k]
    at[last] = None
    put(tmp_path / "m", "x.json", broken)
    with pytest.raises(Exception, match=said):
        readers.read_call_metadata(spark, str(tmp_path / "m")).collect()


def test_clocks_go_back_and_forth(spark):
    rng = random.Random(1)
    seconds = [rng.randint(0, 200_000) for _ in range(200)]
    t = spark.createDataFrame([(float(s),) for s in seconds], "s double")
    clock, short = zip(*t.select(tx.clock(F.col("s")), tx.short_clock(F.col("s"))).collect())
    plain = lambda s: f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    assert list(clock) == [plain(s) for s in seconds]
    assert list(short) == [f"{s // 60:02d}:{s % 60:02d}" if s < 3600 else f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}" for s in seconds]
    back = spark.createDataFrame([(c,) for c in clock], "t string").select(tx.clock_seconds(F.col("t"))).collect()
    assert [r[0] for r in back] == seconds


def test_ordinals_and_slugs(spark):
    o = spark.range(0, 130).select(tx.ordinal(F.col("id").cast("int"))).collect()
    ends = {n: "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th") for n in range(130)}
    assert [r[0] for r in o] == [f"{n}{e}" for n, e in ends.items()]
    rng = random.Random(2)
    names = ["".join(rng.choice("aB7 -_'é") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(tx.slug(F.col("n"))).collect()]
    assert got == [re.sub("[^a-z0-9]+", "-", n.strip().lower()).strip("-") or "unknown" for n in names]


def test_only_calls_with_audio(spark, tmp_path):
    put(tmp_path / "audio", "b.mp3", "x")
    put(tmp_path / "audio", "c.mp3", "x")
    put(tmp_path / "audio", "a.txt", "x")
    calls = spark.createDataFrame([("a",), ("c",), ("b",)], "call_id string")
    assert [r[0] for r in readers.with_audio(calls, spark, str(tmp_path / "audio"), limit=1).collect()] == ["b"]
    assert readers.with_audio(calls, spark, str(tmp_path / "audio")).count() == 2


def test_transcripts_with_quarantine_and_references(spark, tmp_path):
    word = {"text": "hi", "start": 0.0, "end": 0.4, "confidence": 0.9}
    good = {"call_id": "a", "provider": "p", "segments": [{"speaker": "agent", "start": 0.0, "end": 0.4, "text": "hi", "words": [word]}]}
    put(tmp_path / "t", "a.p.json", good)
    put(tmp_path / "t", "b.p.json", json.dumps(good)[:40])
    segments, broken = readers.read_transcripts(spark, str(tmp_path / "t"))
    assert [(r["call_id"], r["words"][0]["text"]) for r in segments.collect()] == [("a", "hi")]
    assert [r["file"].split("/")[-1] for r in broken.collect()] == ["b.p.json"] and (tmp_path / "t" / "b.p.json").exists()
    tables.write_transcripts(segments, str(tmp_path / "cache"))
    tables.write_transcripts(segments, str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1
    put(tmp_path / "gold", "a.txt", "line one\nline two")
    assert readers.read_reference_texts(spark, str(tmp_path / "gold")).first().asDict() == {"call_id": "a", "reference": "line one\nline two"}


def test_roles_by_channel_then_by_label(spark):
    from voxlake import schemas

    cases = list(itertools.product([None, "1", " 2 ", "3", "x"], [None, "", "a", " A", "1", "C"]))
    said = [(c, s, 40 * i, 40 * i + 30, f"t{i}", [(f"t{i}", 40 * i, 40 * i + 30, None if i % 2 else 0.25)]) for i, (c, s) in enumerate(cases)]
    rows = readers.multichannel_segments(spark.createDataFrame([("q", said)], schemas.UTTERANCES)).orderBy("segment_no").collect()
    for i, ((channel, label), r) in enumerate(zip(cases, rows)):
        by_channel = {"1": "agent", "2": "customer"}.get((channel or "").strip())
        assert r["speaker"] == (by_channel or ("agent" if (label or "").strip().upper() in ("A", "1") else "customer"))
        assert r["channel_fallback"] == (channel is not None and by_channel is None)
        assert (r["start"], r["end"], r["words"][0]["confidence"]) == (i * 0.04, pytest.approx(i * 0.04 + 0.03), 1.0 if i % 2 else 0.25)
    counted = readers.channel_fallbacks(readers.multichannel_segments(spark.createDataFrame([("q", said)], schemas.UTTERANCES))).first()
    assert (counted["segments"], counted["channel_fallbacks"]) == (30, 12)


def test_upkeep(spark):
    calls = spark.createDataFrame(
        [("a", "old", "p1", "s1", "resolved"), ("b", "old", "p1", "s1", None)],
        "call_id string, audio_path string, transcript_provider string, session string, resolution_status string",
    )
    new = spark.createDataFrame([("b", "new", "p2", "s2"), ("c", "new", "p2", "s2")], "call_id string, audio_path string, transcript_provider string, session string")
    got = {r["call_id"]: tuple(r)[1:] for r in tables.upsert_calls(calls, new).collect()}
    assert got == {"a": ("old", "p1", "s1", "resolved"), "b": ("new", "p2", "s1", None), "c": ("new", "p2", "s2", None)}
    turns = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "call_id string, turn_index int")
    again = spark.createDataFrame([("a", 0)], "call_id string, turn_index int")
    assert sorted(map(tuple, tables.replace_calls(turns, again).collect())) == [("a", 0), ("b", 0)]
    known = spark.createDataFrame([("x", "X")], "id string, name string")
    batch = spark.createDataFrame([("x", 1, "other"), ("y", 2, "late"), ("y", 1, "early")], "id string, at int, name string")
    assert [tuple(r) for r in tables.upsert_dimension(known, batch, "id", "at").collect()] == [("y", "early")]


def test_runs_and_clusters(spark, tmp_path):
    path = str(tmp_path / "evidence")
    row = lambda *r: spark.createDataFrame(list(r), "call_id string, quote string")
    assert tables.read_or_empty(spark, path, "call_id string, quote string, run_id bigint").count() == 0
    tables.append_run(row(("a", "1"), ("a", "2"), ("b", "1")), path, 1)
    for _ in range(2):  # a run that is written again is there once
        tables.append_run(row(("a", "3")), path, 2)
    stored = spark.read.parquet(path)
    assert sorted((r["call_id"], r["quote"]) for r in tables.latest(stored).collect()) == [("a", "3"), ("b", "1")]
    emptied = spark.createDataFrame([("b", 3)], "call_id string, run_id int")
    assert [r["call_id"] for r in tables.latest(stored, touched=emptied).collect()] == ["a"]
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", None)], "id string, cluster_id string")
    names = spark.createDataFrame([("a", "card / lost")], "cluster_id string, label string")
    for _ in range(2):
        state = tables.refresh_clusters(labels, names, str(tmp_path / "clusters"))
    assert state.number == 2
    assert state.read(spark, "issue_clusters").count() == 1 and state.read(spark, "call_clusters").count() == 2
