"""The keyed table: touched buckets, replay, pruning, new columns."""

import os
import random

import pytest

from quarryline.sources import shared
from quarryline.streaming import upserts

DDL = "id string, crawl_version int, v string"


def table(spark, tmp_path, buckets=16):
    return upserts.KeyedTable(spark, f"{tmp_path}/table", buckets=buckets)


def rows_of(spark, rows, ddl=DDL):
    return spark.createDataFrame(rows, ddl)


def state_of(t):
    return {r["id"]: (r["crawl_version"], r["v"]) for r in t.read().collect()}


def data_bytes(path):
    return {os.path.relpath(os.path.join(d, f), path): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")}


def test_batches_and_replays_give_the_same_table(spark, tmp_path):
    rng, t, want = random.Random(3), table(spark, tmp_path), {}
    for n in range(5):
        batch = [(f"k{rng.randrange(60)}", n * 10 + rng.randrange(5), f"{n}.{i}") for i in range(25)]
        latest = {}
        for k, version, v in sorted(batch, key=lambda r: (r[0], -r[1], r[2])):
            latest.setdefault(k, (version, v))
        want |= latest
        t.merge(rows_of(spark, batch), n)
        assert state_of(t) == want
        if n == 3:
            t.merge(rows_of(spark, batch), n)  # the same batch again
            assert state_of(t) == want


def test_a_failed_batch_is_not_seen_and_runs_again(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.merge(rows_of(spark, [("a", 1, "x"), ("b", 1, "y")]), 0)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(upserts, "write_marker", fail)
        t.merge(rows_of(spark, [("a", 2, "z")]), 1)
    assert state_of(t) == {"a": (1, "x"), "b": (1, "y")}
    t.merge(rows_of(spark, [("a", 2, "z")]), 1)
    assert state_of(t) == {"a": (2, "z"), "b": (1, "y")}


def test_a_small_batch_rewrites_little_and_old_states_go(spark, tmp_path):
    t = table(spark, tmp_path, buckets=32)
    t.merge(rows_of(spark, [(f"k{i}", 1, str(i)) for i in range(2000)]), 0)
    whole = sum(data_bytes(t.path).values())
    for n in range(1, 6):
        before = set(data_bytes(t.path))
        t.merge(rows_of(spark, [("k7", n + 1, "new"), (f"more{n}", 1, "m")]), n)
        new = {f: b for f, b in data_bytes(t.path).items() if f not in before}
        assert sum(new.values()) < whole / 8
    assert len(shared.names(spark, f"{t.path}/commits")) == len(shared.names(spark, f"{t.path}/manifest")) == 2
    assert sum(data_bytes(t.path).values()) < 1.5 * whole and len(state_of(t)) == 2005


def test_pruning_rewrites_only_buckets_with_old_rows(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(rows_of(spark, [(f"k{i}", 5, str(i)) for i in range(200)]), 0)
    t.merge(rows_of(spark, [("old", 1, "o")]), 1)
    places = t.state().places
    t.prune(3, 2)
    moved = [b for b, p in t.state().places.items() if p != places[b]]
    assert len(moved) == 1 and "old" not in state_of(t) and len(state_of(t)) == 200
    t.prune(9, 3)
    assert state_of(t) == {}
    t.merge(rows_of(spark, [("a", 9, "x")]), 4)
    assert state_of(t) == {"a": (9, "x")}


def test_new_columns_and_empty_batches(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(rows_of(spark, []), 0)
    assert t.read().columns == ["id", "crawl_version", "v"] and t.read().count() == 0
    t.merge(rows_of(spark, [("a", 1, "x"), (None, 1, "n")]), 1)
    t.merge(rows_of(spark, [("b", 1, "x", 2.5)], DDL + ", score double"), 2)
    assert {(r["id"], r["score"]) for r in t.read().collect()} == {("a", None), ("b", 2.5), (None, None)}
    assert upserts.current(spark, t.path).count() == 3
