"""Stateful streams fed in several batches, against the batch forms."""

from __future__ import annotations


import pytest
from pyspark.sql import functions as F

from versemill.streaming import jobs as J
from versemill.streaming import requests as R
from versemill.streaming import stateful as S


@pytest.fixture(scope="module")
def hits(spark):
    """One key with half of all hits, times with ties, in eight files that overlap in time."""
    rows = spark.range(900).selectExpr(
        "id", "IF(id % 2 = 0, 0L, id % 7) AS key", "id % 3 AS client", "(id * 37 + id * id % 23) div 10 AS at",
        "id % 5 AS owner", "id % 11 = 0 AS exempt",
    )
    return rows.cache()


@pytest.fixture(scope="module")
def stream(spark, hits, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hits"))
    for k in range(8):
        part = hits.where((F.floor(F.col("at") / 500) + F.col("id") % 2) == k).orderBy(F.rand(k)).coalesce(1)
        part.write.parquet(f"{folder}/{k:02d}")
    assert hits.agg(F.max("at")).first()[0] < 3_400
    return lambda: spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def closed(hits, width):
    return hits.where(F.floor(F.col("at") / width) < F.floor(F.lit(hits.agg(F.max("at")).first()[0] - 1_000) / width))


def test_limiter_in_several_batches(hits, stream):
    out = J.drain(S.in_order(stream(), "key", S.at_most(3), 100, 40, delay="1000 milliseconds"), "append")
    got = {r.id: r.verdict == "accepted" for r in out.collect()}
    want = {r.id: r.allowed for r in R.limit_rate(hits, ["key"], ["at", "id"], "at", F.floor(F.col("at") / 100), 3, 100).collect()}
    must = {r.id for r in closed(hits, 40).collect()}
    assert must <= got.keys() and len(got) < len(want)
    assert all(want[i] == ok for i, ok in got.items())


def test_quotas_in_several_batches(hits, stream):
    rows = stream().withColumn("owner", F.col("owner") * 3 + F.col("client"))
    out = J.drain(S.in_order(rows, "client", S.quotas(2, 6), 120, 60, delay="1000 milliseconds"), "append")
    frame = hits.withColumn("owner", F.col("owner") * 3 + F.col("client"))
    batch = R.quota_admission(frame, "client", "owner", ["at", "id"], "at", F.floor(F.col("at") / 100), "exempt", 2, 6, 120)
    got, want = {r.id: r.verdict for r in out.collect()}, {r.id: r.verdict for r in batch.collect()}
    assert {r.id for r in closed(hits, 60).collect()} <= got.keys()
    assert all(want[i] == v for i, v in got.items()) and set(got.values()) == {"exempt", "owner quota", "client quota", "accepted"}


def test_both_limiters_in_several_batches(hits, stream):
    timed = [R.limit_rate(hits, [k], ["at", "id"], "at", F.floor(F.col("at") / 100), n, 100) for k, n in (("key", 3), ("client", 5))]
    first, second = ({r.id: r.allowed for r in f.collect()} for f in timed)
    late = S.dual_admission_stream(stream(), ("key", "client"), (3, 5), 100, 40, delay="1000 milliseconds")
    got = {r.id: r for r in J.drain(late, "append").collect()}
    assert {r.id for r in closed(hits, 40).collect()} <= got.keys()
    assert all((r.first_ok, r.second_ok, r.allowed) == (first[i], second[i], first[i] and second[i]) for i, r in got.items())


def test_sessions_in_several_batches(hits, stream):
    time = F.timestamp_millis(F.col("at") + R.DAY_MS).alias("ts")
    out = J.drain(S.expired_sessions(stream().select("key", time), "key", "ts", 30_000, "1000 milliseconds"), "append")
    batch = J.idle_sessions(hits.select("key", time), "key", "ts", "30 milliseconds")
    want = {(r.key, r.o, r.e, r.n_events) for r in batch.selectExpr("key", "unix_micros(opened) o", "unix_micros(expires) e", "n_events").collect()}
    got = {tuple(r) for r in out.collect()}
    newest = (hits.agg(F.max("at")).first()[0] + R.DAY_MS - 1_000) * 1_000
    assert got <= want and {w for w in want if w[2] <= newest} <= got and got


def test_tail_keeps_its_slots(hits, stream):
    time = F.timestamp_millis(F.col("at") + R.DAY_MS).alias("ts")
    slots = J.drain(S.log_tail_stream(stream().select("key", time, "id"), "key", "ts", "id", 5), "update", ["key", "slot"])
    batch = J.log_tail(hits, "key", [F.col("at").desc(), F.col("id").desc()], 5)
    assert sorted((r.key, r.id) for r in slots.collect()) == sorted((r.key, r.id) for r in batch.collect())
    assert slots.agg(F.max("slot")).first()[0] == 4


def test_sessions_of_a_stream_run_without_python(stream):
    rows = stream().select("key", F.timestamp_millis(F.col("at") + 86_400_000).alias("ts"))
    plan = S.expired_sessions(rows, "key", "ts", 50_000)._jdf.queryExecution().toString()
    assert "session_window" in plan and "Python" not in plan and "Pandas" not in plan
