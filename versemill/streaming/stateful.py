"""Stateful stream operators with several state variables and event-time timers.

Rules that depend on order (limits, quotas) get a key's rows in time order: rows wait in a
map by slice of time, a timer at a slice's end takes it out, so a task holds one slice of
one key and what the rule itself keeps. Sessions and tails do not depend on the order of
arrival and merge what comes. Times are milliseconds; on the stream they start a day into
the epoch, since a watermark starts at the epoch and drops what is not later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from versemill.streaming.requests import DAY_MS

# (accepted times, accepted owners, time, owner, exempt) -> verdict; accepted lists are already pruned.
Rule = Callable[[list[int], list[int], int, int, bool], str]


def at_most(limit: int) -> Rule:
    """Accept below ``limit`` accepted hits in the window."""

    def rule(times: list[int], owners: list[int], now: int, owner: int, exempt: bool) -> str:
        return "accepted" if len(times) < limit else "rejected"

    return rule


def quotas(owner_quota: int, client_quota: int) -> Rule:
    """A quota for every owner within a client and one for the client; exempt rows pass and do not count."""

    def rule(times: list[int], owners: list[int], now: int, owner: int, exempt: bool) -> str:
        if exempt:
            return "exempt"
        if owners.count(owner) >= owner_quota:
            return "owner quota"
        return "accepted" if len(times) < client_quota else "client quota"

    return rule


# Keys share so many groups: each slice of a group is one piece of state with one timer, whatever its number of keys.
GROUPS = 512
# What a stored row holds: key, time, id, owner, and the flags exempt, key is null, id is null, owner is null.
_FIELDS = ["key", "at", "id", "owner", "flags"]
_EXEMPT, _NO_KEY, _NO_ID, _NO_OWNER = 1, 2, 4, 8


class InOrder(StatefulProcessor):
    """Applies a rule to each key's rows in order of (time, id), slice by slice as the watermark passes them.

    Rows come by groups of keys and wait packed, so calls to the state and timers are as
    many as slices of groups, not of keys; the rule sees the rows of one key only.
    """

    def __init__(self, rule: Rule, window: int, width: int) -> None:
        self.rule, self.window, self.width = rule, window, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slice bigint", "n bigint")
        self.waiting = handle.getMapState("waiting", "slice bigint, part bigint", "rows binary")
        self.accepted = handle.getValueState("accepted", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            packed = chunk[_FIELDS].to_numpy(dtype=np.int64)
            numbers = packed[:, 1] // self.width
            order = np.argsort(numbers, kind="stable")
            slices, starts = np.unique(numbers[order], return_index=True)
            for number, part in zip(slices.tolist(), np.split(packed[order], starts[1:]), strict=True):
                n = int(self.parts.getValue((number,))[0]) if self.parts.containsKey((number,)) else 0
                self.waiting.updateValue((number, n), (part.tobytes(),))
                self.parts.updateValue((number,), (n + 1,))
                if not n:
                    self.handle.registerTimer((number + 1) * self.width + DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() - DAY_MS
        held: dict = {}
        if self.accepted.exists():
            for k, none, at, owner in np.frombuffer(self.accepted.get()[0], dtype=np.int64).reshape(-1, 4).tolist():
                times, owners = held.setdefault((k, none), ([], []))
                times.append(at)
                owners.append(owner)
        out = []
        for k, at, row, owner, flags in self._due(end):
            own = (k, flags & _NO_KEY)
            times, owners = held.setdefault(own, ([], []))
            self._forget(times, owners, at)
            # An owner that is null counts like one that no row has.
            verdict = self.rule(times, owners, at, owner if not flags & _NO_OWNER else -(2**63), bool(flags & _EXEMPT))
            if verdict == "accepted":
                times.append(at)
                owners.append(owner if not flags & _NO_OWNER else -(2**63))
            out.append((None if flags & _NO_ID else row, verdict))
        kept = []
        for (k, none), (times, owners) in held.items():
            self._forget(times, owners, end)
            kept += [(k, none, at, owner) for at, owner in zip(times, owners, strict=True)]
        if kept:
            # Idle keys are forgotten at the first slice end after their last accepted row has left the window.
            self.accepted.update((np.array(kept, dtype=np.int64).tobytes(),))
            last = max(at for _, _, at, _ in kept)
            self.handle.registerTimer(-(-(last + self.window) // self.width) * self.width + DAY_MS)
        elif self.accepted.exists():
            self.accepted.clear()
        if out:
            ids, verdicts = zip(*out, strict=True)
            when = pd.to_datetime(np.full(len(out), timerValues.getCurrentWatermarkInMs()), unit="ms")
            yield pd.DataFrame({"id": pd.array(ids, dtype="Int64"), "decided_at": when, "verdict": verdicts})

    def _due(self, end: int) -> list[list[int]]:
        """The rows of the slice that ends here, in order, taken out of the state."""
        number = end // self.width - 1
        if end % self.width or not self.parts.containsKey((number,)):
            return []
        parts = range(int(self.parts.getValue((number,))[0]))
        rows = np.concatenate([np.frombuffer(self.waiting.getValue((number, n))[0], dtype=np.int64) for n in parts]).reshape(-1, len(_FIELDS))
        for n in parts:
            self.waiting.removeKey((number, n))
        self.parts.removeKey((number,))
        return rows[np.lexsort((rows[:, 4] & _EXEMPT, rows[:, 3], rows[:, 2], rows[:, 1]))].tolist()

    def _forget(self, times: list[int], owners: list[int], now: int) -> None:
        gone = next((k for k, t in enumerate(times) if t > now - self.window), len(times))
        if gone:
            del times[:gone], owners[:gone]

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, rule: Rule, window: int, width: int, delay: str = "0 seconds") -> DataFrame:
    """(id, decided_at, verdict) of a stream with ``key``, id, at, owner (bigint) and exempt (boolean).

    A row is decided once the watermark, ``delay`` behind the newest row, has passed the
    end of its slice of ``width`` milliseconds; ``decided_at`` is the watermark then.
    """
    whole = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c if c != key else "key")
    flag = lambda c, bit: F.when(c, F.lit(bit).cast("bigint")).otherwise(0)
    flags = flag(F.col("exempt"), _EXEMPT) + flag(F.col(key).isNull(), _NO_KEY) + flag(F.col("id").isNull(), _NO_ID) + flag(F.col("owner").isNull(), _NO_OWNER)
    timed = rows.where(F.col("at").isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("keys"), whole(key), whole("at"), whole("id"), whole("owner"), flags.alias("flags"),
        F.timestamp_millis(F.col("at") + DAY_MS).alias("row_time"),
    )
    return timed.withWatermark("row_time", delay).groupBy("keys").transformWithStateInPandas(
        statefulProcessor=InOrder(rule, window, width),
        outputStructType="id bigint, decided_at timestamp, verdict string",
        outputMode="append",
        timeMode="eventTime",
        eventTimeColumnName="decided_at",
    )


def dual_admission_stream(rows: DataFrame, keys: tuple[str, str], limits: tuple[int, int], window: int, width: int, delay: str = "0 seconds") -> DataFrame:
    """(id, first_ok, second_ok, allowed): two limiters over one stream, each by its own key, met on the id.

    Both record their own hits, whatever the other says. Both decide a row at the same
    watermark, so the join forgets it with the next one.
    """
    first, second = (in_order(rows, k, at_most(n), window, width, delay) for k, n in zip(keys, limits, strict=True))
    ok = F.col("verdict") == "accepted"
    a = first.select("id", "decided_at", ok.alias("first_ok"))
    b = second.select(F.col("id").alias("other"), F.col("decided_at").alias("other_at"), ok.alias("second_ok"))
    met = a.join(b, (F.col("id") == F.col("other")) & (F.col("decided_at") == F.col("other_at")))
    return met.select("id", "first_ok", "second_ok", (F.col("first_ok") & F.col("second_ok")).alias("allowed"))


def expired_sessions(events: DataFrame, key: str, ts: str, gap_us: int, delay: str = "0 seconds") -> DataFrame:
    """(key, opened_us, expires_us, n_events): a session is emitted when the watermark passes its last event by the gap.

    A session that events extend moves its end; what arrives out of order joins the
    intervals it lies between. The state holds one interval for each session still open.
    """
    timed = events.select(F.col(key).cast("bigint").alias("key"), F.col(ts).alias("at")).withWatermark("at", delay)
    sessions = timed.groupBy("key", F.session_window("at", f"{gap_us} microseconds").alias("w")).agg(F.count("*").alias("n_events"))
    return sessions.select(
        "key", F.unix_micros("w.start").alias("opened_us"), F.unix_micros("w.end").alias("expires_us"), "n_events"
    )


class Tail(StatefulProcessor):
    """The newest rows of a key in a ring of slots; only slots that change are written and emitted."""

    def __init__(self, lines: int) -> None:
        self.lines = lines

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot bigint", "at_us bigint, id bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = {(int(at), int(i)): int(slot[0]) for slot, (at, i) in self.slots.iterator()}
        stored = dict(held)
        for chunk in rows:
            new = sorted(zip(chunk["at_us"].tolist(), chunk["id"].tolist(), strict=True))[-self.lines :]
            for row in new:
                if row in held:
                    continue
                if len(held) < self.lines:
                    held[row] = len(held)
                elif (oldest := min(held)) < row:
                    held[row] = held.pop(oldest)
        changed = [(slot, at, i) for (at, i), slot in held.items() if stored.get((at, i)) != slot]
        for slot, at, i in changed:
            self.slots.updateValue((slot,), (at, i))
        if changed:
            slot, at, i = zip(*changed, strict=True)
            yield pd.DataFrame({"key": [int(key[0])] * len(slot), "slot": slot, "at_us": at, "id": i})

    def close(self) -> None:
        pass


def log_tail_stream(log: DataFrame, key: str, ts: str, row: str, lines: int = 200) -> DataFrame:
    """(key, slot, at_us, id), update mode: the slots of each key's last ``lines`` rows by (time, id).

    The latest row of every slot is the tail; a key's state never exceeds its slots.
    """
    rows = log.select(F.col(key).cast("bigint").alias("key"), F.unix_micros(ts).alias("at_us"), F.col(row).cast("bigint").alias("id"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Tail(lines),
        outputStructType="key bigint, slot bigint, at_us bigint, id bigint",
        outputMode="update",
        timeMode="None",
    )
