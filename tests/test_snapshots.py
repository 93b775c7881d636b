import pytest
from pyspark.sql import functions as F

from voxlake.sources.snapshots import Snapshots


def values(state, spark):
    return {name: sorted(r["v"] for r in state.read(spark, name).collect()) for name in state.tables}


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "tables"))


def frame(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "v long")


def test_readers_see_whole_states(spark, store):
    assert store.current() is None and store.orphans() == []
    first = store.commit({"a": frame(spark, 1), "b": frame(spark, 1)})
    second = store.commit({"a": frame(spark, 2)})
    assert values(first, spark) == {"a": [1], "b": [1]}  # a reader that began before goes on
    assert values(store.current(), spark) == {"a": [2], "b": [1]} and second.number == 2


def test_a_reader_between_two_writes_and_a_failed_run(spark, store):
    store.commit({"a": frame(spark, 1), "b": frame(spark, 1)})
    seen = []
    real = frame(spark, 2)
    broken = real.withColumn("v", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": real, "b": broken})
    seen.append(values(store.current(), spark))
    assert seen == [{"a": [1], "b": [1]}]
    left = store.orphans()
    assert len(left) == 1 and store.clean() == [] and store.clean(min_age=-1.0) == left and store.orphans() == []
    assert values(store.current(), spark) == {"a": [1], "b": [1]}


def test_two_writers_do_not_both_win(spark, store):
    base = store.commit({"a": frame(spark, 1)})
    store.commit({"a": frame(spark, 2)}, base)
    with pytest.raises(RuntimeError):
        store.commit({"a": frame(spark, 3)}, base)
    numbers = Snapshots._numbers
    late = Snapshots(spark, store.root)
    late.current = lambda: base  # has looked before the other one was done
    with pytest.raises(Exception, match="(?i)exist"):
        late.commit({"a": frame(spark, 4)})
    assert numbers(store) == [1, 2] and values(store.current(), spark) == {"a": [2]}


def test_old_states_go_and_shared_tables_stay(spark, store):
    store.commit({"a": frame(spark, 1), "b": frame(spark, 7)})
    for v in (2, 3):
        store.commit({"a": frame(spark, v)})
    assert len(store.clean(keep=1, min_age=-1.0)) == 1  # the first data folder goes on with b
    assert values(store.current(), spark) == {"a": [3], "b": [7]}
    assert values(store.commit({"c": frame(spark)}), spark) == {"a": [3], "b": [7], "c": []}
