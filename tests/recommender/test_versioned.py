"""Tables that change at once: retries, failures, conflicts, buckets that stay, change sets, runs and daily profiles."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewalk.operators import runs
from tidewalk.sources.versioned import Conflict, KeyedTable, VersionedTables, change_set

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType()), T.StructField("x", T.DoubleType())])


def _files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_rewrites_only_what_changes(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=8)
    assert table.rows().collect() == []
    first = [(i, f"s{i}", i / 2) for i in range(200)]
    assert table.upsert(spark.createDataFrame(first, SCHEMA), "load") and _rows(table.rows()) == sorted(first, key=repr)
    before = table.state()["tables"]["rows"]
    change = spark.createDataFrame([(5, "new", None, False), (900, "more", 1.0, None), (7, None, None, True)], "k long, s string, x double, gone boolean")
    assert table.upsert(change, "c1", deleted="gone")
    want = {k: (k, s, x) for k, s, x in first} | {5: (5, "new", None), 900: (900, "more", 1.0)}
    del want[7]
    assert _rows(table.rows()) == sorted(want.values(), key=repr)
    after, touched = table.state()["tables"]["rows"], {str(b) for b in table.touched("rows", change)}
    assert {b for b in before if before[b] != after.get(b)} <= touched and len(touched) < 8
    assert not table.upsert(change.withColumn("s", F.lit("again")), "c1", deleted="gone") and _rows(table.rows()) == sorted(want.values(), key=repr)
    n = len(_files(tmp_path))
    table.vacuum()
    assert _rows(table.rows()) == sorted(want.values(), key=repr) and len(_files(tmp_path)) <= n
    assert table.upsert(spark.createDataFrame([(k, None, None, True) for k in want], change.schema), deleted="gone") and table.rows().collect() == []


def test_a_failure_leaves_nothing_and_a_second_writer_fails(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=4)
    one, two = (spark.createDataFrame([(k, "a", 1.0)], SCHEMA) for k in (1, 2))
    table.upsert(one, "1")
    commit = VersionedTables.commit
    monkeypatch.setattr(VersionedTables, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(two, "2")
    monkeypatch.setattr(VersionedTables, "commit", commit)
    assert _rows(table.rows()) == [(1, "a", 1.0)]
    assert table.upsert(two, "2") and _rows(table.rows()) == [(1, "a", 1.0), (2, "a", 1.0)]
    old = table.state()
    table.upsert(spark.createDataFrame([(3, "a", 1.0)], SCHEMA), "3")
    with pytest.raises(Conflict):
        table.commit(old, {}, "late")
    assert table.vacuum() >= 1 and len(_rows(table.rows())) == 3  # what the failed change and replaced buckets left


def test_change_set(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0), (4, None, None)], SCHEMA)
    new = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (4, None, None), (5, "e", 5.0)], SCHEMA)
    assert _rows(change_set(old, new, ["k"])) == [(2, "b", 2.0, "update"), (3, "c", 3.0, "delete"), (5, "e", 5.0, "insert")]
    assert change_set(old, old, ["k"]).collect() == [] and len(change_set(old.limit(0), new, ["k"]).collect()) == 4


def _run(spark, user, k):
    at = f"2024-01-{k:02} 00:00:00"
    one = spark.createDataFrame([(user, f"{user}@{k}", at)], "user_id long, run_id string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    return one, spark.createDataFrame([(user, f"{user}@{k}", p) for p in (1, 2)], "user_id long, run_id string, project_id long")


def test_a_run_is_stored_once_or_not_at_all(spark, tmp_path, monkeypatch):
    store = runs.RunStore(spark, str(tmp_path), buckets=4)
    write, seen = VersionedTables.write, []

    def failing(self, name, rows):
        seen.append(name)
        if len(seen) == 2:
            raise OSError("between both writes")
        return write(self, name, rows)

    monkeypatch.setattr(VersionedTables, "write", failing)
    with pytest.raises(OSError):
        store.record(*_run(spark, 1, 1), "b1")
    with pytest.raises(ValueError):
        store.runs()
    assert store.record(*_run(spark, 1, 1), "b1") and not store.record(*_run(spark, 1, 1), "b1")
    assert store.runs().count() == 1 and store.results().count() == 2


def test_older_runs_go_in_place(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path), buckets=16)
    for user, k in [(1, 1), (1, 2), (1, 3), (2, 1), (3, 5)]:
        store.record(*_run(spark, user, k), f"{user}-{k}")
    before = store.tables.state()["tables"]
    rewritten = store.retain(2)
    after = store.tables.state()["tables"]
    assert len(rewritten) == 1
    assert all(after[name][b] == before[name][b] for name in before for b in before[name] if int(b) not in rewritten)
    assert sorted(r.run_id for r in store.tables.read("runs").collect()) == ["1@2", "1@3", "2@1", "3@5"] and store.tables.read("results").count() == 8
    assert store.retain(2) == []


def test_a_feed_that_cannot_be_recorded_is_shown(spark, tmp_path, monkeypatch):
    class Shown:
        def diversified(self, limit):
            return spark.createDataFrame([(1, 2)], "user_id long, project_id long")

    monkeypatch.setattr(runs, "snapshot", lambda *a: (_ for _ in ()).throw(OSError("full")))
    shown, why = runs.served(Shown(), runs.RunStore(spark, str(tmp_path)), "b")
    assert _rows(shown) == [(1, 2)] and isinstance(why, OSError)


def test_daily_profiles_equal_the_whole(spark, tmp_path):
    """After each of several days, with a late retry, days without events, and pairs that leave the window."""
    import random
    from datetime import date, datetime, timedelta

    from tidewalk.operators.rolling import RollingSignals

    r, T0 = random.Random(9), datetime(2024, 1, 1)
    times = [T0, T0 + timedelta(days=3), T0 + timedelta(days=4) - timedelta(microseconds=1)] + [T0 + timedelta(days=r.choice([0, 1, 2, 3, 5, 6, 8]), seconds=r.randrange(86_400)) for _ in range(300)]
    rows = [(r.randrange(6), r.randrange(5), t, r.choice([0.0, 0.5, 2.0, -1.0, -3.0])) for t in times]
    events = spark.createDataFrame(rows, "user_id long, project_id long, created_at timestamp_ntz, weight double")
    features = spark.createDataFrame([(p, f"f{k}", 1.0 + p * k) for p in range(5) for k in range(2)], "project_id long, feature string, value double")
    kept = RollingSignals(spark, str(tmp_path), history_days=4, half_life=3, buckets=4)
    kept.load(events, date(2024, 1, 3))
    with pytest.raises(ValueError):
        kept.advance(events, date(2024, 1, 5))
    for day in range(3, 12):
        if day > 3:
            assert kept.advance(events, date(2024, 1, day)) and not kept.advance(events, date(2024, 1, day))
        now = datetime(2024, 1, day) + timedelta(days=1)
        inside = [(u, p, w * 0.5 ** ((now - t).total_seconds() / 86_400 / 3)) for u, p, t, w in rows if w and now - timedelta(days=4) <= t < now]
        want = {}
        for u, p, w in inside:
            for k in range(2):
                want[u, f"f{k}"] = want.get((u, f"f{k}"), 0) + w * (1.0 + p * k)
        found = {(x.user_id, x.feature): x.signal for x in kept.signals(features).collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert kept.table.rows().count() == len({(u, p) for u, p, t, w in rows if w and t >= T0 + timedelta(days=7)})


def test_choices_answer_all_pairs_once(spark):
    from tidewalk.operators.onboarding import choice_problems

    pairs = spark.createDataFrame([(0, "a", "b"), (1, "c", "d")], "position int, left string, right string")
    answers = [(1, 0, "a"), (1, 1, "d"), (2, 0, "c"), (2, 1, None), (3, 0, "a"), (3, 0, "b"), (4, 1, "c"), (5, 0, "a"), (5, 1, "c"), (5, 7, "a")]
    out = choice_problems(spark.createDataFrame(answers, "user_id long, position int, slug string"), pairs)
    assert _rows(out) == sorted([(2, 0, "not an item of the pair"), (2, 1, "not an item of the pair"), (3, 0, "pair answered again"), (4, None, "not all pairs once"), (5, None, "not all pairs once"), (5, 7, "unknown pair")], key=repr)


def test_split_fingerprint(spark):
    from datetime import datetime

    from tidewalk.operators.evaluation import split_fingerprint

    rows = [(u, datetime(2024, 1, 1 + u % 20), [u, u + 1]) for u in range(500)]
    make = lambda rows, n: spark.createDataFrame(rows, "user_id long, cutoff timestamp_ntz, held_out array<long>").repartition(n)
    (one,), (two,) = (split_fingerprint(make(rows, n)).collect() for n in (1, 7))
    assert one == two and one.n_cases == 500
    rows[250] = (250, rows[250][1], [250, 252])
    assert split_fingerprint(make(rows, 3)).collect()[0].fingerprint != one.fingerprint
    assert split_fingerprint(make(rows[1:], 3)).collect()[0].fingerprint not in (one.fingerprint, two.fingerprint)


def test_selected_runs(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path), buckets=4)
    for user, k in [(1, 1), (1, 2), (2, 1)]:
        store.record(*_run(spark, user, k), f"{user}-{k}")
    asked = lambda *rows: spark.createDataFrame(rows, "user_id long, run_id string")
    detail = runs.RunStore.detail
    runs.RunStore.detail = lambda self, named, catalog: named
    try:
        assert _rows(store.selected(asked((1, None), (2, "2@1"), (3, None)), None)) == [(1, "1@2"), (2, "2@1")]
        for wrong in ((1, "2@1"), (3, "x")):
            with pytest.raises(runs.RunNotFound):
                store.selected(asked(wrong), None)
    finally:
        runs.RunStore.detail = detail
