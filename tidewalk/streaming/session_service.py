"""A session service on a stream: each user's sessions as keyed state, for rows that come in any order.

An event within the timeout of its user's open session belongs to it; a later one closes it at its last activity and begins
the next; a manual start ends it at that moment (or at its last activity, if it was stale) and begins the next. Activity only
moves forward. Rows count by (time, id), not by arrival: a user's rows of the last ``late_minutes`` before its newest one stay in
state and are judged anew with each batch, older sessions are final. Rows that come later still are lost to sessions, but not lost: they
come out with ``kind`` late. Rows without a time or an id have no place in the order and are left out.

A call of Python costs more than a user's rows, so the groups of the stream are buckets of users. A user is still an entry of its own in
the state, and a batch reads and writes those of its users alone. A log that expires sessions has a timer for each user, so there each
user is a group.

Output is append-only: final sessions once, and with each batch of a user the sessions that may still change, with a
growing version. ``latest`` makes the table of sessions of it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewalk.config import CONFIG
from tidewalk.sources.shared import new_path

MINUTE = 60_000_000
OUTPUT = "user_id long, kind string, final boolean, version long, session_no long, started long, active long, ended long, n_events long, manual boolean, id long"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of users; many more than partitions, so that these are even. It can't change while a stream's state is kept.
BUCKETS = 4096
#: Rows of the log that a task holds before it hands them on.
HELD = 10_000


class Open(NamedTuple):
    """A user's open session (number 0: none yet or none since the last one expired) and what is known of the user."""

    version: int = 0
    before: int = 0  # rows of an earlier time are late
    newest: int = 0
    session_no: int = 0
    started: int = 0
    active: int = 0
    n_events: int = 0
    manual: bool = False
    is_open: bool = False


#: What is known of a user without a state.
NOBODY = Open(before=-(1 << 62), newest=-(1 << 62))


def advance(now: Open, events: list[tuple[int, int, bool]], timeout: int) -> tuple[list[tuple[Open, int]], Open]:
    """The sessions that end, with their ends, and the open one after events (time, id, manual start) in order."""
    ended = []
    no, started, active, n, by_hand, is_open = now.session_no, now.started, now.active, now.n_events, now.manual, now.is_open
    session = lambda: now._replace(session_no=no, started=started, active=active, n_events=n, manual=by_hand, is_open=is_open)
    for at, _, manual in events:
        fresh = is_open and at - active <= timeout
        if fresh and not manual:
            active, n = max(active, at), n + 1
            continue
        if is_open:
            ended.append((session(), at if fresh else active))
        no, started, active, n, by_hand, is_open = no + 1, at, at, 1, manual, True
    return ended, session()


class SessionService(StatefulProcessor):
    """State of each user of a group: the open session at the edge of what is final, and the rows after it."""

    def __init__(self, timeout_minutes: float, late_minutes: float, expire: bool):
        self.timeout, self.late, self.expire = round(timeout_minutes * MINUTE), round(late_minutes * MINUTE), expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = "version long, before long, newest long, session_no long, started long, active long, n_events long, manual boolean, is_open boolean"
        self.users = handle.getMapState("users", "user_id long", f"{own}, rows array<struct<at: long, id: long, manual: boolean>>")

    def _read(self, user: int) -> tuple[Open, list[tuple[int, int, bool]]]:
        found = self.users.getValue((user,))
        if found is None:
            return NOBODY, []
        *own, rows = found
        return Open(*own), [tuple(x) for x in rows]

    def _write(self, user: int, now: Open, rows: list) -> None:
        self.users.updateValue((user,), (*now, rows))

    @staticmethod
    def _out(user: int, final: bool, version: int, x: Open, ended: int | None) -> tuple:
        return user, "session", final, version, x.session_no, x.started, x.active, ended, x.n_events, x.manual, None

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        kinds = {"session_no": "Int64", "started": "Int64", "active": "Int64", "ended": "Int64", "n_events": "Int64", "id": "Int64", "manual": "boolean"}
        return pd.DataFrame(rows, columns=names).astype(kinds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, out, known = defaultdict(list), [], self.users.exists()
        for batch in rows:
            for user, at, i, manual in zip(batch["user_id"].tolist(), batch["at"].tolist(), batch["id"].tolist(), batch["manual"].tolist()):
                new[user].append((at, i, manual))
        while new:
            user, own = new.popitem()
            out += self._judge(user, own, known)
            if len(out) >= HELD:
                yield self._frame(out)
                out = []
        yield self._frame(out)

    def _judge(self, user: int, new: list[tuple[int, int, bool]], known: bool) -> list[tuple]:
        """The log's rows for new rows of a user; known: the group has a state."""
        now, kept = self._read(user) if known else (NOBODY, [])
        out = [(user, "late", True, now.version, None, None, at, None, 1, manual, i) for at, i, manual in new if at < now.before]
        kept = sorted(kept + [x for x in new if x[0] >= now.before])
        newest = max(now.newest, kept[-1][0]) if kept else now.newest
        before = max(now.before, newest - self.late)
        sure = sum(x[0] < before for x in kept)
        ended, now = advance(now._replace(version=now.version + 1, newest=newest, before=before), kept[:sure], self.timeout)
        out += [self._out(user, True, now.version, x, end) for x, end in ended]
        ended, last = advance(now, kept[sure:], self.timeout)
        out += [self._out(user, False, now.version, x, end) for x, end in ended]
        if last.is_open:
            out.append(self._out(user, False, now.version, last, None))
        self._write(user, now, kept[sure:])
        if self.expire and last.is_open:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last.active + self.timeout + self.late) // 1000 + 1)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The user's last session has become stale: it ends at its last activity, and nothing of the user may change any more."""
        user, (now, kept) = key[0], self._read(key[0])
        ended, last = advance(now._replace(version=now.version + 1), kept, self.timeout)
        out = [self._out(user, True, last.version, x, end) for x, end in ended]
        if last.is_open:
            out.append(self._out(user, True, last.version, last, last.active))
        self._write(user, last._replace(before=max(last.before, last.active + 1), is_open=False), [])
        yield self._frame(out)

    def close(self) -> None:
        pass


def session_log(rows: DataFrame, timeout_minutes: float = CONFIG.session_timeout_minutes, late_minutes: float = 60, expire: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """The log of sessions of a stream of rows: user_id, created_at (timestamp), id, manual (a manual start).

    expire: sessions also end when the clock of the machine, and no later event, says that they are stale; for live streams.
    buckets: groups of users, unless sessions expire.
    """
    rows = rows.select("user_id", F.unix_micros("created_at").alias("at"), "id", F.coalesce("manual", F.lit(False)).alias("manual")).dropna()
    group = F.col("user_id").cast("long") if expire else F.pmod(F.xxhash64("user_id"), F.lit(buckets))
    return rows.withColumn("group", group).groupBy("group").transformWithStateInPandas(SessionService(timeout_minutes, late_minutes, expire), OUTPUT, "Append", "ProcessingTime" if expire else "None")


def latest(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions, user_id, session_no, started_at, last_active_at, ended_at (null while open), n_events and manual; and late rows: user_id, id, created_at, manual."""
    time = lambda c: F.timestamp_micros(c)
    newest = F.max("version").over(Window.partitionBy("user_id"))
    own = log.filter("kind = 'session'").withColumn("newest", newest).filter(F.col("final") | (F.col("version") == F.col("newest")))
    sessions = own.select("user_id", "session_no", time("started").alias("started_at"), time("active").alias("last_active_at"), time("ended").alias("ended_at"), "n_events", "manual")
    late = log.filter("kind = 'late'").select("user_id", "id", time("active").alias("created_at"), "manual")
    return sessions, late


def drain(log: DataFrame, name: str, path: str | None = None, once: bool = False) -> DataFrame:
    """Run the log over all that is there now and read it; with the ``path`` of an earlier run it goes on from there.

    once: in a single batch, for a log that expires sessions; by the machine's clock there is always a next batch, so its run has no end of its own.
    """
    spark, path = log.sparkSession, path or new_path(log.sparkSession, name)
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        run = log.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append")
        run.trigger(**({"once": True} if once else {"availableNow": True})).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(log.schema).parquet(path)
