"""Appends that happen once: replays, jobs that die between write and commit, versions, compaction."""

from collections import Counter

import pytest
from pyspark.sql import types as T

from revlens.sources import ledger as L
from revlens.streaming import ingest

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])


def frame(spark, *ids):
    return spark.createDataFrame([(i, f"text, \"{i}\"\nnext") for i in ids], SCHEMA)


def ids(spark, table):
    return Counter(r.id for r in L.read_committed(spark, table, SCHEMA).collect())


@pytest.fixture
def table(tmp_path):
    return f"file:{tmp_path}/table"


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_a_batch_counts_once(spark, table, fmt):
    assert ids(spark, table) == Counter()
    assert L.append_once(frame(spark, 1, 2), table, "w", 0, fmt)
    assert not L.append_once(frame(spark, 1, 2), table, "w", 0, fmt)
    assert L.append_once(frame(spark, 3), table, "w", 1, fmt)
    assert L.append_once(frame(spark, 1, 2), table, "another writer/é", 0, fmt)
    assert ids(spark, table) == Counter({1: 2, 2: 2, 3: 1})
    texts = {r.t for r in L.read_committed(spark, table, SCHEMA).collect()}
    assert "text, \"3\"\nnext" in texts


def test_a_replayed_batch_is_not_computed(spark, table):
    L.append_once(frame(spark, 1), table, "w", 0)
    failing = frame(spark, 1).selectExpr("raise_error('computed') as id", "t")
    assert not L.append_once(failing, table, "w", 0)


def test_a_job_that_dies_before_the_commit_shows_nothing(spark, table):
    L.append_once(frame(spark, 1), table, "w", 0)
    part = L.write_part(frame(spark, 2), table)              # and here the job ends
    assert ids(spark, table) == Counter([1]) and L.orphans(spark, table) == [part]
    assert L.append_once(frame(spark, 2), table, "w", 1)
    assert ids(spark, table) == Counter([1, 2])
    assert L.sweep(spark, table) == 1 and L.orphans(spark, table) == []
    assert ids(spark, table) == Counter([1, 2])


def test_the_first_of_two_commits_counts(spark, table):
    one, two = L.write_part(frame(spark, 7), table), L.write_part(frame(spark, 7), table)
    assert L.commit(spark, table, "w", 0, two) and not L.commit(spark, table, "w", 0, one)
    assert ids(spark, table) == Counter([7]) and L.orphans(spark, table) == []


def test_formats_of_one_table_may_differ(spark, table):
    L.append_once(frame(spark, 1), table, "w", 0, "csv")
    L.append_once(frame(spark, 2), table, "w", 1, "parquet")
    assert ids(spark, table) == Counter([1, 2])


def test_compaction_keeps_what_is_committed(spark, table):
    for i in range(6):
        L.append_once(frame(spark, i), table, "w", i)
    assert L.compact(spark, table, keep=10) == 0 and L.compact(spark, table, keep=2) == 6
    assert ids(spark, table) == Counter(range(6))
    assert not L.append_once(frame(spark, 3), table, "w", 3) and L.append_once(frame(spark, 9), table, "w", 9)
    assert L.compact(spark, table, keep=0) == 1
    assert ids(spark, table) == Counter([*range(6), 9])


def test_versions_replace_each_other_whole(spark, table):
    assert L.read_version(spark, table, SCHEMA).count() == 0
    for v in range(4):
        assert L.publish(frame(spark, v, v + 1), table, v)
        assert sorted(r.id for r in L.read_version(spark, table, SCHEMA).collect()) == [v, v + 1]
    assert not L.publish(frame(spark, 99), table, 3)
    L.write_part(frame(spark, 50), table)                    # a writer that died in the middle of version 4
    assert sorted(r.id for r in L.read_version(spark, table, SCHEMA).collect()) == [3, 4]
    assert len(L._entries(L._Store(spark, table))) == 2      # the newest and the one before


# ------------------------------------------------------------------ streams

def staged(spark, tmp_path, n=5):
    path = f"{tmp_path}/src"
    for i in range(n):
        frame(spark, 2 * i, 2 * i + 1).coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_batches_that_run_again_change_nothing(spark, tmp_path, table):
    src = staged(spark, tmp_path)
    want = Counter(range(10))
    assert Counter(r.id for r in ingest.ingest_exactly_once(spark, src, SCHEMA, table, f"{tmp_path}/c1", max_bytes=1).collect()) == want
    # the checkpoint is lost: every batch is handed out again under its number
    assert Counter(r.id for r in ingest.ingest_exactly_once(spark, src, SCHEMA, table, f"{tmp_path}/c2", max_bytes=1).collect()) == want
    frame(spark, 100).coalesce(1).write.mode("append").parquet(src)
    got = ingest.ingest_exactly_once(spark, src, SCHEMA, table, f"{tmp_path}/c1", max_bytes=1)
    assert Counter(r.id for r in got.collect()) == want + Counter([100])


def test_stream_killed_between_write_and_commit(spark, tmp_path, table, monkeypatch):
    src, real, calls = staged(spark, tmp_path, 3), L.commit, []

    def dies(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(*args)
    monkeypatch.setattr(L, "commit", dies)
    with pytest.raises(Exception):
        ingest.ingest_exactly_once(spark, src, SCHEMA, table, f"{tmp_path}/c", max_bytes=1)
    assert sum(ids(spark, table).values()) == 2 and len(L.orphans(spark, table)) == 1
    monkeypatch.setattr(L, "commit", real)
    got = ingest.ingest_exactly_once(spark, src, SCHEMA, table, f"{tmp_path}/c", max_bytes=1)
    assert Counter(r.id for r in got.collect()) == Counter(range(6))
