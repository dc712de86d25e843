"""The session service on a stream: order of arrival, late rows, manual starts, expiry."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewalk.streaming import session_service as service

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def brute(rows, timeout=30):
    """user -> sessions (started, active, ended, n, manual) of rows (user, minutes, id, manual)."""
    out = defaultdict(list)
    for user, t, _, manual in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        own = out[user]
        fresh = bool(own) and t - own[-1][1] <= timeout
        if fresh and not manual:
            own[-1][1], own[-1][3] = t, own[-1][3] + 1
            continue
        if own:
            own[-1][2] = t if fresh else own[-1][1]
        own.append([t, t, None, 1, manual])
    return {u: [tuple(s) for s in x] for u, x in out.items()}


class Source:
    """Files of rows that a stream reads one by one."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)
        self.schema = "user_id long, created_at timestamp, id long, manual boolean"
        spark.createDataFrame([], self.schema).write.parquet(self.folder)

    def add(self, rows):
        self.spark.createDataFrame([(u, at(t) if t is not None else None, i, m) for u, t, i, m in rows], self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


def found(log):
    minutes = lambda x: None if x is None else round((x - T0).total_seconds() / 60, 6)
    sessions, late = service.latest(log)
    out = defaultdict(list)
    for r in sessions.orderBy("user_id", "session_no").collect():
        assert r.session_no == len(out[r.user_id]) + 1
        out[r.user_id].append((minutes(r.started_at), minutes(r.last_active_at), minutes(r.ended_at), r.n_events, r.manual))
    return dict(out), [(r.user_id, minutes(r.created_at), r.id, r.manual) for r in late.collect()]


@pytest.mark.parametrize("late", [10**6, 90])
def test_rows_in_any_order(spark, tmp_path, late):
    """With a horizon beyond all rows the result is that of the batch; else late rows come out and sessions are those of the others."""
    r = random.Random(4)
    rows = [(u, r.choice([0, 0.5, 7, 30, 31]) + 30 * r.randrange(40), i, r.random() < 0.1) for i, u in enumerate(r.choices(range(6), k=300))]
    rows += [(7, 5.0, 1000, False), (7, 35.0, 1001, False), (7, 35.0, 1002, True), (7, 65.1, 1003, False)]
    r.shuffle(rows)
    source = Source(spark, tmp_path / "rows")
    for k in range(0, len(rows), 60):
        source.add(rows[k : k + 60] + [(8, None, k, False)])
    sessions, lost = found(service.drain(service.session_log(source.stream(), 30, late), f"any-{late}"))
    assert sessions == brute([x for x in rows if x not in lost])
    assert sum(s[3] for own in sessions.values() for s in own) + len(lost) == len(rows)
    assert (late > 1000) == (not lost)


def test_a_later_run_goes_on(spark, tmp_path):
    source = Source(spark, tmp_path / "rows")
    source.add([(1, 0, 1, False), (1, 10, 2, False), (2, 0, 3, False)])
    path = str(tmp_path / "log")
    log = service.drain(service.session_log(source.stream()), "", path)
    assert found(log)[0] == {1: [(0, 10, None, 2, False)], 2: [(0, 0, None, 1, False)]}
    source.add([(1, 5, 4, False), (1, 13, 5, True), (1, 90, 6, True)])  # activity in between, a manual start, one after expiry
    log = service.drain(service.session_log(source.stream()), "", path)
    assert found(log)[0] == {1: [(0, 10, 13, 3, False), (13, 13, 13, 1, True), (90, 90, None, 1, True)], 2: [(0, 0, None, 1, False)]}
    source.add([(1, 1, 7, False), (1, 89, 8, False)])  # the first is late; the second one begins a session before the manual one
    sessions, late = found(service.drain(service.session_log(source.stream()), "", path))
    assert late == [(1, 1, 7, False)]
    assert sessions[1] == [(0, 10, 13, 3, False), (13, 13, 13, 1, True), (89, 89, 90, 1, False), (90, 90, None, 1, True)]


def test_expiry_without_later_rows(spark, tmp_path):
    """By the clock of the machine all these sessions are stale: the next batch, of another user, ends them at their last activity."""
    source, path = Source(spark, tmp_path / "rows"), str(tmp_path / "log")
    source.add([(1, 0, 1, False), (1, 10, 2, False)])
    service.drain(service.session_log(source.stream(), expire=True), "", path, once=True)
    source.add([(2, 0, 3, False)])
    service.drain(service.session_log(source.stream(), expire=True), "", path, once=True)
    source.add([(1, 20, 4, False), (1, 5, 5, False)])
    sessions, late = found(service.drain(service.session_log(source.stream(), expire=True), "", path, once=True))
    assert sessions[1][0] == (0, 10, 10, 2, False) and sessions[1][1][:2] == (20, 20) and late == [(1, 5, 5, False)]


def test_active_at_the_timeout():
    now = service.Open()
    ended, now = service.advance(now, [(0, 1, False), (30, 2, False), (61, 3, False)], 30)
    assert [(x.started, x.active, end) for x, end in ended] == [(0, 30, 30)] and (now.started, now.session_no) == (61, 2)
    ended, now = service.advance(now, [(91, 4, False)], 30)
    assert not ended and now.n_events == 2


class Users:
    """A map state in a dict, which counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def exists(self):
        return bool(self.held)

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_many_users_are_one_call():
    """A group has many users: they come out in one frame, and a batch reads and writes the state of its own users alone."""
    r = random.Random(6)
    rows = [(u, r.randrange(3000), i, r.random() < 0.1) for i, u in enumerate(r.choices(range(100), k=3000))]
    work = service.SessionService(30, 10**6, False)
    work.users = Users()
    frame = lambda x: pd.DataFrame([(u, t * service.MINUTE, i, m) for u, t, i, m in x], columns=["user_id", "at", "id", "manual"])
    first = list(work.handleInputRows((0,), iter([frame(rows[:1000]), frame(rows[1000:])]), None))
    assert len(first) == 1 and work.users.calls == len(work.users.held) == 100
    own = defaultdict(list)
    for x in first[0].sort_values(["user_id", "session_no"]).itertuples():
        own[x.user_id].append((x.started // service.MINUTE, x.active // service.MINUTE, None if x.ended is pd.NA else x.ended // service.MINUTE, x.n_events, x.manual))
    assert own == brute(rows)
    work.users.calls = 0
    again = list(work.handleInputRows((0,), iter([frame([(5, 4000, 5000, False)])]), None))
    assert work.users.calls == 2 and set(again[0]["user_id"]) == {5} and set(again[0]["version"]) == {2}


def test_users_that_share_a_group(spark, tmp_path):
    """Sessions don't depend on the number of groups, over several batches, with a state to go on from and late rows."""
    r = random.Random(9)
    rows = sorted(((u, r.randrange(1200), i, r.random() < 0.1) for i, u in enumerate(r.choices(range(60), k=900))), key=lambda x: x[1] + r.randrange(150))
    source = Source(spark, tmp_path / "rows")
    for k in range(0, len(rows), 300):
        source.add(rows[k : k + 300])
    for buckets in (1, 3):
        sessions, lost = found(service.drain(service.session_log(source.stream(), 30, 100, buckets=buckets), f"shared-{buckets}"))
        assert lost and sessions == brute([x for x in rows if x not in lost])
        assert sum(s[3] for own in sessions.values() for s in own) + len(lost) == len(rows)
