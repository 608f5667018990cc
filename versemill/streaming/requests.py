"""Rate limits, quotas and admission over request rows, in batch and as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from versemill.plans.fold import fold_sorted
from versemill.plans.ordered import islands, lag, scan


# Event times start a day into the epoch: a watermark starts at the epoch and drops what is not later.
DAY_MS = 86_400_000


def admit(accepted: deque, now: int, limit: int, window: int) -> bool:
    """One hit: forget what left the window, accept and record below the limit; rejects are not recorded."""
    while accepted and accepted[0] <= now - window:
        accepted.popleft()
    if len(accepted) >= limit:
        return False
    accepted.append(now)
    return True


def limit_rate(
    hits: DataFrame, by: Sequence[str], order: Sequence[str], at: str, slice_by: Column, limit: int, window: int,
    name: str = "allowed",
) -> DataFrame:
    """Accept-only sliding window per key, in batch.

    A pause of at least ``window`` empties the limiter, so a key is cut there
    and its pieces run in different tasks.
    """
    by = list(by)
    s = scan(hits, by, order, slice_by, __prev=lag(at))
    fresh = F.coalesce(F.col(at) - F.col("__prev") >= window, F.lit(True))
    pieces = islands(s, by, order, slice_by, fresh, "__piece")

    def step(state, row):
        state = deque() if state is None else state
        return state, (admit(state, row[at], limit, window),)

    need = list(dict.fromkeys([*by, "__piece", *order, at]))
    rest = [c for c in hits.columns if c not in need]
    out = fold_sorted(pieces.select(*need, *rest), [*by, "__piece"], order, step, f"{name} boolean")
    return out.select(*hits.columns, name)


def dual_admission(hits: DataFrame, request: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """Requests that both limiters let pass; both record their own hits."""
    a = first.select(request, F.col("allowed").alias("session_ok"))
    b = second.select(request, F.col("allowed").alias("client_ok"))
    return hits.join(a, request).join(b, request).withColumn("allowed", F.col("session_ok") & F.col("client_ok"))


def quota_admission(
    jobs: DataFrame, client: str, owner: str, order: Sequence[str], at: str, slice_by: Column, exempt: str,
    owner_quota: int, client_quota: int, window: int,
) -> DataFrame:
    """Rolling quota per owner and per client; a job counts for both only when accepted.

    Exempt jobs pass and do not count. An owner belongs to one client. Pauses
    of the client of at least ``window`` cut it into independent pieces.
    """
    s = scan(jobs, [client], order, slice_by, __prev=lag(at))
    fresh = F.coalesce(F.col(at) - F.col("__prev") >= window, F.lit(True))
    pieces = islands(s, [client], order, slice_by, fresh, "__piece")

    def step(state, row):
        accepted = deque() if state is None else state
        now = row[at]
        while accepted and accepted[0][0] <= now - window:
            accepted.popleft()
        if row[exempt]:
            return accepted, ("exempt",)
        if sum(1 for _, o in accepted if o == row[owner]) >= owner_quota:
            return accepted, ("owner quota",)
        if len(accepted) >= client_quota:
            return accepted, ("client quota",)
        accepted.append((now, row[owner]))
        return accepted, ("accepted",)

    need = list(dict.fromkeys([client, "__piece", owner, *order, at, exempt]))
    rest = [c for c in jobs.columns if c not in need]
    out = fold_sorted(pieces.select(*need, *rest), [client, "__piece"], order, step, "verdict string")
    return out.select(*jobs.columns, "verdict")


def limit_rate_stream(
    hits: DataFrame, key: str, request: str, at: str, limit: int, window: int
) -> DataFrame:
    """The limiter as a stateful stream: state is the accepted times of a key, at most ``limit`` of them.

    Idle keys are dropped once the watermark (one window behind the newest
    hit) has passed their last hit by a window. ``key``, ``request`` and ``at``
    (milliseconds) are bigint.
    """

    def update(
        k: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(batches)).sort_values([at, request])
        verdict = [admit(accepted, now, limit, window) for now in pdf[at].tolist()]
        state.update((list(accepted),))
        state.setTimeoutTimestamp(max(max(pdf[at]) + DAY_MS + window, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], request: pdf[request].to_numpy(), "allowed": verdict})

    timed = hits.select(key, request, at, F.timestamp_millis(F.col(at) + DAY_MS).alias("hit_time"))
    timed = timed.withWatermark("hit_time", f"{window} milliseconds")
    return timed.groupBy(key).applyInPandasWithState(
        update,
        f"{key} bigint, {request} bigint, allowed boolean",
        "accepted array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
