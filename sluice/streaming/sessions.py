"""Sessions that end after a time without activity: over tables of events, and in a process."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_seen(events: DataFrame, key: str = "user_id", at: str = "ts") -> DataFrame:
    """(key, last_seen, n_events): works on a stream as on a table."""
    return events.groupBy(key).agg(F.max(at).alias("last_seen"), F.count("*").alias("n_events"))


def expiry(events: DataFrame, ttl_seconds: int, now: str, key: str = "user_id", at: str = "ts") -> DataFrame:
    """last_seen() with expired: whether the time to live was over at ``now``; one of 0 never ends."""
    end = F.col("last_seen") + F.make_interval(secs=F.lit(ttl_seconds))
    return last_seen(events, key, at).withColumn("expired", (F.lit(ttl_seconds) > 0) & (end <= F.lit(now).cast("timestamp_ntz" if dict(events.dtypes)[at] == "timestamp_ntz" else "timestamp")))


def windows(events: DataFrame, ttl_seconds: int, late: str = "1 hour", key: str = "user_id", at: str = "ts") -> DataFrame:
    """(key, started, ended, n_events) of each session; on a stream the watermark ``late`` bounds the state."""
    seen = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events
    grouped = seen.groupBy(F.session_window(at, f"{ttl_seconds} seconds").alias("w"), key).agg(F.count("*").alias("n_events"))
    return grouped.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


#: What is said of a session, with times in microseconds.
SAYS = "session string, value string, last_seen long, n_touches long, ends_at long, alive boolean"


def followed(key: tuple[Any, ...], rows: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One session's state on a stream: a value, when it was last set or touched, how often, and when it ends.

    Commands come and what is said goes as one column of JSON: each column of a session's own frame costs far more than
    its rows. State comes and goes with the rows of many sessions at once."""
    said = lambda held, alive: pd.DataFrame({"said": [json.dumps({"session": key[0], "value": held[0], "last_seen": held[1], "n_touches": held[2], "ends_at": held[3], "alive": alive})]})
    now = was = state.getOption
    if state.hasTimedOut:
        state.remove()
        yield said(was, False)
        return
    asked = sorted((json.loads(c) for part in rows for c in part["command"]), key=lambda c: c["at"])
    for c in asked:
        op, at, value, ttl = c["op"], c["at"], c.get("value"), c["ttl"]
        if now and now[3] is not None and now[3] <= at:
            now = None  # it ended before
        end = None if ttl == 0 else at + 1000 * ttl
        if op == "set":
            now = (value, at, (now[2] if now else 0) + 1, end)
        elif op == "touch" and now:
            now = (now[0], max(now[1], at), now[2] + 1, end)
        elif op == "delete":
            now = None
    if now is None:
        if was:
            state.remove()
            yield said(was, False)
        return
    yield said(now, True)
    if now[3] is not None and now[3] // 1000 <= state.getCurrentWatermarkMs():
        if was:
            state.remove()
        yield said(now, False)
        return
    state.update(now)
    if now[3] is not None:
        state.setTimeoutTimestamp(max(1, now[3] // 1000 - 1))  # the watermark has to be past it


def ttl_stream(commands: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(session, value, last_seen, n_touches, ends_at, alive): a stream of what becomes of sessions, from a stream of commands
    (session string, at timestamp, op string, value string, ttl_ms long).

    op: ``set`` gives a session a value and a time to live (0: for good), ``touch`` a new time to live if it is alive,
    ``delete`` ends it. A row comes for each session of a batch, and one with alive false when the watermark (the latest
    ``at`` less ``late``) passes its end. Each session's state is a few bytes in the state store, of which a batch looks
    through the ends (with RocksDB's provider it isn't in memory as a whole); a restart from the checkpoint goes on with
    it, but not from one of the transformWithState that did this before. Commands with a null session, time or op are
    left out, others than these three do nothing; a null ttl counts as 0.
    """
    asked = commands.where("session is not null and at is not null and op is not null").withWatermark("at", late)
    command = F.struct(F.unix_micros("at").alias("at"), "op", "value", F.coalesce("ttl_ms", F.lit(0)).cast("long").alias("ttl"))
    told = asked.select("session", "at", F.to_json(command).alias("command")).groupBy("session")
    told = told.applyInPandasWithState(followed, "said string", "value string, last_seen long, n_touches long, ends_at long", "append", GroupStateTimeout.EventTimeTimeout)
    told = told.select(F.from_json("said", SAYS).alias("said")).select("said.*")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("last_seen", "ends_at")})


class SessionStore:
    """Values by session id, each with a time to live in milliseconds (0: for good)."""

    def __init__(self, ttl_ms: int = 0, now: Callable[[], float] = lambda: time.time() * 1000):
        self.ttl_ms, self.now, self._held = max(0, ttl_ms), now, {}

    def set(self, session: str, value: Any, ttl_ms: int | None = None) -> None:
        ttl = self.ttl_ms if ttl_ms is None else max(0, ttl_ms)
        self._held[session] = (value, self.now() + ttl if ttl else None)

    def _live(self, session: str) -> bool:
        if session in self._held and (end := self._held[session][1]) is not None and end <= self.now():
            del self._held[session]
        return session in self._held

    def get(self, session: str) -> Any:
        return self._held[session][0] if self._live(session) else None

    def touch(self, session: str, ttl_ms: int | None = None) -> bool:
        if alive := self._live(session):
            self.set(session, self._held[session][0], ttl_ms)
        return alive

    def delete(self, session: str) -> bool:
        return self._held.pop(session, None) is not None

    def prune(self) -> list[str]:
        """Ends what is over, and tells which."""
        return [s for s in list(self._held) if not self._live(s)]

    def drain(self) -> dict[str, Any]:
        held, self._held = {s: v for s, (v, _) in self._held.items()}, {}
        return held

    def __len__(self) -> int:
        return len(self._held)
