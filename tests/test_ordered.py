"""Sliced scans, interval joins and folds against plain window functions or brute force, with one hot key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from versemill.plans import fold as FO
from versemill.plans import intervals as I
from versemill.plans import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(900):
        key = 0 if i % 3 else rng.randrange(1, 20)
        data.append((key, rng.randrange(0, 4000), i, rng.randrange(50) if rng.random() < 0.6 else None))
    return spark.createDataFrame(data, "k int, t bigint, id bigint, v bigint").cache()


def _same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_scan_equals_window(rows):
    got = O.scan(
        rows, ["k"], ["t", "id"], O.by_width("t", 100),
        lag_v=O.lag("v"), lead_v=O.lead("v"), s=O.running_sum("v"), s0=O.running_sum("v", inclusive=False),
        mx=O.running_max("v"), mn=O.running_min("v", inclusive=False), lk=O.last_known("v", inclusive=False),
        nk=O.next_known("v"), rn=O.row_number(),
    )
    w = Window.partitionBy("k").orderBy("t", "id")
    up, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select(
        "*", F.lag("v").over(w).alias("lag_v"), F.lead("v").over(w).alias("lead_v"), F.sum("v").over(up).alias("s"),
        F.sum("v").over(before).alias("s0"), F.max("v").over(up).alias("mx"), F.min("v").over(before).alias("mn"),
        F.last("v", True).over(before).alias("lk"),
        F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("nk"),
        F.row_number().over(w).cast("bigint").alias("rn"),
    )
    _same(got.select(want.columns), want)


def test_median_equals_percentile(rows):
    got = O.median(rows, ["k"], "v", O.by_width("v", 7)).select("k", "median")
    want = rows.where("v IS NOT NULL").groupBy("k").agg(F.median("v").alias("median"))
    _same(got, want)


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_equals_brute_force(rows, direction, strict):
    left = rows.where("id % 2 = 0").select("k", "t", "id")
    right = rows.where("id % 2 = 1").select("k", F.col("t").alias("rt"), F.col("id").alias("rid"))
    got = I.asof_join(left, right, ["k"], "t", "rt", ["rid"], 150, direction, tie=["rid"], strict=strict)
    lrows, rrows = left.collect(), right.collect()
    for r in got.collect():
        back = direction == "backward"
        ok = [
            (x.rt, x.rid) for x in rrows
            if x.k == r.k and ((x.rt < r.t or (x.rt == r.t and not strict)) if back else (x.rt > r.t or (x.rt == r.t and not strict)))
        ]
        want = (max(ok) if back else min(ok))[1] if ok else None
        assert r.rid == want
    assert got.count() == len(lrows)


def test_interval_joins_equal_theta_joins(rows):
    spans = rows.where("id % 5 = 0").select("k", F.col("id").alias("sid"), F.col("t").alias("s"), (F.col("t") + F.coalesce("v", F.lit(0)) * 9).alias("e"))
    pts = rows.select("k", "t", "id")
    got = I.points_in_spans(pts, spans, ["k"], "t", "s", "e", 64).select("id", "sid")
    a, b = pts.alias("a"), spans.alias("b")
    want = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("t") >= F.col("s")) & (F.col("t") < F.col("e"))).select("id", "sid")
    _same(got, want)
    other = rows.where("id % 7 = 0").select("k", F.col("id").alias("oid"), F.col("t").alias("x"), (F.col("t") + 130).alias("y"))
    got2 = I.overlapping_pairs(spans, other, ["k"], ("s", "e"), ("x", "y"), 64).select("sid", "oid")
    o = other.alias("o")
    want2 = spans.where("s < e").alias("b").join(o, (F.col("b.k") == F.col("o.k")) & (F.col("s") < F.col("y")) & (F.col("x") < F.col("e"))).select("sid", "oid")
    _same(got2, want2)


def test_fold_keeps_state_per_key(rows):
    def step(state, row):
        state = (state or 0) + 1
        return state, (state,)

    got = FO.fold_sorted(rows.select("k", "t", "id"), ["k"], ["t", "id"], step, "n bigint")
    w = Window.partitionBy("k").orderBy("t", "id")
    _same(got, rows.select("k", "t", "id", F.row_number().over(w).cast("bigint").alias("n")))


def test_top_rows_and_first_row(rows):
    first = O.first_row(rows, ["k"], ["t", "id"])
    top = O.top_rows(rows, ["k"], [F.col("t"), F.col("id")], 1).drop("rank")
    _same(first.select("k", "t", "id", "v"), top.select("k", "t", "id", "v"))
