"""Request and job streams: drained over the stored events, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from versemill import bindings as B
from versemill.operators import metrics as A
from versemill.queries.registry import ORACLE, query
from versemill.streaming import jobs as J
from versemill.streaming import requests as R
from versemill.streaming import stateful as S

ORDER = ["start_ms", "note_id"]
LIMIT, WINDOW = 4, 1_500
# Hours of jobs may lie before their origin; whole slices more keep them positive.
SHIFT_H = 240 * 1_000

_T1 = B.with_(B.NOTES).replace("WITH", "WITH RECURSIVE", 1) + """, h AS (SELECT {key} AS k, note_id, start_ms, row_number() OVER (PARTITION BY {key} ORDER BY start_ms, note_id) AS rn FROM notes),
 f{n} AS (SELECT k, rn, note_id, [start_ms] AS st, true AS allowed FROM h WHERE rn = 1 UNION ALL
  SELECT h.k, h.rn, h.note_id, CASE WHEN len(list_filter(f{n}.st, lambda t: t > h.start_ms - {window})) < {limit} THEN list_append(list_filter(f{n}.st, lambda t: t > h.start_ms - {window}), h.start_ms)
    ELSE list_filter(f{n}.st, lambda t: t > h.start_ms - {window}) END, len(list_filter(f{n}.st, lambda t: t > h.start_ms - {window})) < {limit} FROM f{n} JOIN h ON h.k = f{n}.k AND h.rn = f{n}.rn + 1)
"""


def _t1(key: str, n: str = "", limit: int = LIMIT, window: int = WINDOW) -> str:
    return _T1.replace("{key}", key).replace("{n}", n).replace("{limit}", str(limit)).replace("{window}", str(window))


@query("t1_rate_limiter", _t1("song_id") + "SELECT note_id, allowed FROM f")
def t1(spark, d):
    n = B.notes(spark, d).select("song_id", "note_id", "start_ms")
    return R.limit_rate(n, ["song_id"], ORDER, "start_ms", B.song_slice(), LIMIT, WINDOW).select("note_id", "allowed")


@query("t1_rate_limiter_stream", _t1("song_id") + "SELECT note_id, allowed FROM f")
def t1_stream(spark, d):
    events = J.read_event_stream(spark, d, "events")
    start = F.expr(f"(unix_micros(cast(ts as timestamp)) - {B.EPOCH_US}) div {B.US_PER_MS}")
    hits = events.select(F.col("user_id").alias("song_id"), F.col("event_id").alias("note_id"), start.alias("start_ms"))
    return J.drain(R.limit_rate_stream(hits, "song_id", "note_id", "start_ms", LIMIT, WINDOW), "append").select("note_id", "allowed")


_CLIENT = _t1("song_id % 20", "2", 30).split(", h AS", 1)[1].replace(" h ", " h2 ").replace("h.", "h2.")


@query(
    "t2_dual_key_admission",
    _t1("song_id") + ", h2 AS" + _CLIENT + "SELECT f.note_id, f.allowed AS session_ok, f2.allowed AS client_ok, f.allowed AND f2.allowed AS allowed FROM f JOIN f2 ON f.note_id = f2.note_id",
)
def t2(spark, d):
    n = B.notes(spark, d).select("song_id", (F.col("song_id") % 20).alias("client"), "note_id", "start_ms")
    a = R.limit_rate(n, ["song_id"], ORDER, "start_ms", B.song_slice(), LIMIT, WINDOW)
    b = R.limit_rate(n, ["client"], ORDER, "start_ms", B.song_slice(), 30, WINDOW)
    return R.dual_admission(n, "note_id", a, b).select("note_id", "session_ok", "client_ok", "allowed")


# The slice of time a stream waits for; hits of slices that the newest hit has not closed are undecided.
_CLOSED = f"start_ms // {WINDOW} < (SELECT max(start_ms) FROM notes) // {WINDOW}"


def _hits(spark, d):
    events = J.read_event_stream(spark, d, "events")
    start = F.expr(f"(unix_micros(cast(ts as timestamp)) - {B.EPOCH_US}) div {B.US_PER_MS}")
    return events.select(
        F.col("user_id").alias("song_id"), (F.col("user_id") % 20).alias("client"), F.col("event_id").alias("id"), start.alias("at"),
        F.col("user_id").alias("owner"), F.lit(False).alias("exempt"),
    )


@query("t1_rate_limiter_ordered", _t1("song_id") + f"SELECT note_id, allowed FROM f JOIN notes USING (note_id) WHERE {_CLOSED}")
def t1_ordered(spark, d):
    """The limiter with its rows put in order by state and timers."""
    out = J.drain(S.in_order(_hits(spark, d), "song_id", S.at_most(LIMIT), WINDOW, WINDOW), "append")
    return out.select(F.col("id").alias("note_id"), (F.col("verdict") == "accepted").alias("allowed"))


@query(
    "t2_dual_key_admission_stream",
    _t1("song_id") + ", h2 AS" + _CLIENT + f"""SELECT f.note_id, f.allowed AS session_ok, f2.allowed AS client_ok, f.allowed AND f2.allowed AS allowed
FROM f JOIN f2 ON f.note_id = f2.note_id JOIN notes ON notes.note_id = f.note_id WHERE {_CLOSED}""",
)
def t2_stream(spark, d):
    """Both limiters in one stream; a stream-stream join brings their verdicts together."""
    out = S.dual_admission_stream(_hits(spark, d), ("song_id", "client"), (LIMIT, 30), WINDOW, WINDOW)
    return J.drain(out, "append").select(F.col("id").alias("note_id"), F.col("first_ok").alias("session_ok"), F.col("second_ok").alias("client_ok"), "allowed")


_KEEP = "list_filter(q.st, lambda x: x.t > h.created_h - 240)"
_VERDICT = f"""CASE WHEN h.ex THEN 'exempt' WHEN len(list_filter({_KEEP}, lambda x: x.o = h.owner)) >= 2 THEN 'owner quota' WHEN len({_KEEP}) >= 40 THEN 'client quota' ELSE 'accepted' END"""


@query(
    "t3_quota_admission",
    B.with_(B.JOBS).replace("WITH", "WITH RECURSIVE", 1) + f""", h AS (SELECT owner % 20 AS client, owner, job_id, created_h, priority = '1-URGENT' AS ex, row_number() OVER (PARTITION BY owner % 20 ORDER BY created_h, job_id) AS rn FROM jobs),
 q AS (SELECT client, rn, job_id, CASE WHEN ex THEN [] ELSE [{{'t': created_h, 'o': owner}}] END AS st, CASE WHEN ex THEN 'exempt' ELSE 'accepted' END AS verdict FROM h WHERE rn = 1 UNION ALL
  SELECT h.client, h.rn, h.job_id, CASE WHEN {_VERDICT} = 'accepted' THEN list_append({_KEEP}, {{'t': h.created_h, 'o': h.owner}}) ELSE {_KEEP} END, {_VERDICT} FROM q JOIN h ON h.client = q.client AND h.rn = q.rn + 1)
SELECT job_id, verdict FROM q""",
)
def t3(spark, d):
    j = B.jobs(spark, d).select("job_id", "owner", (F.col("owner") % 20).alias("client"), "created_h", (F.col("priority") == "1-URGENT").alias("ex"))
    out = R.quota_admission(j, "client", "owner", ["created_h", "job_id"], "created_h", F.floor(F.col("created_h") / 24), "ex", 2, 40, 240)
    return out.select("job_id", "verdict")


@query("t3_quota_admission_stream", ORACLE["t3_quota_admission"].replace(
    "SELECT job_id, verdict FROM q", "SELECT job_id, verdict FROM q JOIN jobs USING (job_id) WHERE created_h // 240 < (SELECT max(created_h) FROM jobs) // 240"))
def t3_stream(spark, d):
    """Quotas of owners within clients, decided slice by slice as the watermark passes."""
    o = J.read_event_stream(spark, d, "orders")
    at = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint")
    rows = o.select(
        (F.col("o_custkey") % 20).alias("client"), F.col("o_orderkey").alias("id"), (at + SHIFT_H).alias("at"),
        F.col("o_custkey").alias("owner"), (F.col("o_orderpriority") == "1-URGENT").alias("exempt"),
    )
    out = J.drain(S.in_order(rows, "client", S.quotas(2, 40), 240, 240), "append")
    return out.select(F.col("id").alias("job_id"), "verdict")


_STATE = """s AS (SELECT job, CASE WHEN st IN ('view', 'click') THEN 'error' ELSE st END AS status FROM (SELECT user_id AS job, arg_max(event_type, event_id) AS st FROM events GROUP BY 1))"""


@query("t4_job_state", "WITH " + _STATE + " SELECT job, status FROM s")
def t4(spark, d):
    """Update-mode stream of the latest status per job, drained over the stored events."""
    e = J.read_event_stream(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("status"), "event_id")
    states = J.drain(J.latest_status(e, "job", "status", ["event_id"]), "update", ["job"])
    return J.after_restart(states, "status", ["view", "click"])


@query("t4_status_counts", "WITH " + _STATE + " SELECT status, count(*) AS n FROM s GROUP BY 1")
def t4_counts(spark, d):
    e = B.table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("status"), "event_id")
    states = J.after_restart(J.latest_status(e, "job", "status", ["event_id"]), "status", ["view", "click"])
    return J.status_counts(states, "status")


@query(
    "t5_idle_sessions",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 7200000000 THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
 s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t) AS sid FROM g)
SELECT user_id, min(t) AS opened_us, max(t) + 7200000000 AS expires_us, count(*) AS n_events FROM s GROUP BY user_id, sid""",
)
def t5(spark, d):
    e = B.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = J.idle_sessions(e, "user_id", "ts", "2 hours")
    return s.select("user_id", F.unix_micros("opened").alias("opened_us"), F.unix_micros("expires").alias("expires_us"), "n_events")


@query(
    "t5_expired_sessions_stream",
    ORACLE["t5_idle_sessions"].replace("SELECT user_id, min(t)", "SELECT * FROM (SELECT user_id, min(t)")
    + """) WHERE (expires_us + 999) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events)""",
)
def t5_stream(spark, d):
    """Sessions whose timer the watermark has passed."""
    e = J.read_event_stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return J.drain(S.expired_sessions(e, "user_id", "ts", 7_200_000_000), "append").withColumnRenamed("key", "user_id")


@query(
    "t6_stage_progress",
    """WITH f AS (SELECT user_id, round(avg(value), 4) AS factor FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT event_id, round(CASE WHEN event_type = 'error' THEN least(100.0, value) WHEN coalesce(factor, 1.0) * (event_id % 10) > 0 THEN least(99.0, 100.0 * value / (event_id % 10 * coalesce(factor, 1.0))) ELSE 0.0 END, 6) AS percent
FROM events LEFT JOIN f USING (user_id)""",
)
def t6(spark, d):
    """Stream-static join of running stages to the smoothed factors."""
    e = B.table(spark, d, "events")
    factors = e.where(F.col("event_type") == "signup").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("factor"))
    running = J.read_event_stream(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    real = F.when(F.col("event_type") == "error", F.least(F.lit(100.0), F.col("value")))
    out = J.stage_progress(running, factors, ["user_id"], real, F.col("value"), (F.col("event_id") % 10).cast("double"))
    return J.drain(out.select("event_id", F.round("percent", 6).alias("percent")), "append")


@query("t7_log_tail", "SELECT user_id, event_id, k AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20")
def t7(spark, d):
    e = B.table(spark, d, "events").select("user_id", "event_id", "ts")
    out = J.log_tail(e, "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 20)
    return out.select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("t7_log_tail_stream", ORACLE["t7_log_tail"])
def t7_stream(spark, d):
    """The same from the slots a stream keeps; ranks within a key's slots."""
    e = J.read_event_stream(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    slots = J.drain(S.log_tail_stream(e, "user_id", "ts", "event_id", 20), "update", ["key", "slot"])
    out = J.log_tail(slots, "key", [F.col("at_us").desc(), F.col("id").desc()], 20)
    return out.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), F.col("rank").cast("bigint").alias("rank"))


_T8 = "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS window_us, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query("t8_request_volume", _T8)
def t8(spark, d):
    """Update-mode windows over the stream; the latest count per window is the final one."""
    e = J.read_event_stream(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    v = J.drain(J.request_volume(e, "ts", "1 hour", ["event_type"], late="1 day"), "update", ["window_start", "event_type"])
    return v.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n")


@query("t8_request_volume_batch", _T8)
def t8_batch(spark, d):
    e = B.table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    v = J.request_volume(e, "ts", "1 hour", ["event_type"])
    return v.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n")


@query("t9_duplicate_requests", "SELECT DISTINCT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def t9(spark, d):
    e = J.read_event_stream(spark, d, "events").select(
        "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.col("ts").cast("timestamp").alias("ts")
    )
    return J.drain(J.suppress_duplicates(e, "ts", ["user_id", "event_type", "k"], "40 days"), "append").select("user_id", "event_type", "k")
