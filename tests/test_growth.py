"""Steps whose rows, state or memory grew faster than the input, and their results by brute force."""

from __future__ import annotations

import glob
import random
import re
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from versemill.operators import matching as M
from versemill.operators import metrics as A
from versemill.operators import projection as P
from versemill.operators import timejoin as TJ
from versemill.session import configure, ensure_checkpoint_dir
from versemill.streaming import stateful as S


def nodes(df, name):
    return len(re.findall(rf"\b{name}\b", df._jdf.queryExecution().executedPlan().toString()))


def test_shift_plan_makes_no_row_for_each_shift(spark):
    rng = random.Random(5)
    rows = [(s, rng.choice([*range(40, 100), None]), s == 2) for s in (1, 2, 3, None) for _ in range(30)]
    df = spark.createDataFrame(rows, "song int, pitch bigint, movable boolean")
    out = A.shift_plan(df, ["song"], "pitch", F.lit(54), F.lit(78), F.col("movable"))
    assert nodes(out, "HashAggregate") + nodes(out, "ObjectHashAggregate") <= 4
    for r in out.collect():
        mine = [(p, m) for s, p, m in rows if s == r.song]
        bad = lambda v: sum(p is not None and not 54 <= p + v <= 78 for p, _ in mine)
        each = [(bad(k + o), k, k + o) for k in range(-A.MAX_KEY_SHIFT, A.MAX_KEY_SHIFT + 1) for o in A.OCTAVE_SHIFTS]
        best = min((n, abs(v), -v) for n, k, v in each if k == 0)
        want = (-best[2], 0, best[0])
        if any(m for _, m in mine) and best[0] > 0:
            n, _, _, v, k = min((n, abs(k), abs(v), v, k) for n, k, v in each)
            want = (v, k, n)
        assert (r.vocal_shift, r.key_shift, r.out_of_range) == want


def test_round_trip_looks_fragments_up(spark):
    frags = {"a": [(1, "1", "x~=a"), (1, "2", "x~=ab"), (1, "3", "p or q"), (2, "1", "y=(1"), (2, "2", None)], "b": []}
    wheres = ["(x~=a)", "(x~=ab or x~=a) and (p or q)", "x~=a\n", " or  or x~=a", "y=(1 and x~=abc", "", None, "p or q or x~=a", "x~=a and and p or q"]
    facets = spark.createDataFrame([(k, *f) for k, fs in frags.items() for f in fs], "list string, facet_no int, value_no string, fragment string")
    filters = spark.createDataFrame([(k, w) for k in ("a", "b", None) for w in [*wheres, "(x~=a)"]], "list string, w string")
    out = P.survives_round_trip(filters, facets, "list", "w")
    assert "regexp_like" not in out._jdf.queryExecution().toString().lower() and "RLIKE" not in out._jdf.queryExecution().toString()
    got = sorted(out.collect(), key=str)
    assert len(got) == filters.count()
    for r in got:
        if not frags.get(r.list):
            assert (r.restored, r.survives) == (r.w, False)
            continue
        hit = lambda f: r.w is not None and f and re.search(r"(?:^|\(| or | and )" + re.escape(f) + r"(?:$|\)| or | and )", r.w)
        clauses = [[f for n, _, f in sorted(frags[r.list], key=lambda x: x[:2]) if n == no and hit(f)] for no in (1, 2)]
        want = " and ".join("(" + " or ".join(c) + ")" for c in clauses if c)
        assert r.restored == want and r.survives == (None if r.w is None else want == r.w)


def test_costs_are_summed_up_as_arrays(spark):
    points = spark.createDataFrame([(s, k, float(s * 9_000 + i * 700)) for s in range(4) for k in (0, 1) for i in range(40)], "song int, scale_no int, y double")
    onsets = spark.createDataFrame([(s, s * 9_000 + i * 650) for s in range(3) for i in range(40)], "song int, onset bigint")
    offsets = M.np.arange(-3, 4) * 100.0
    out = M._grid_costs(points, onsets, "song", offsets)
    final = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
    assert not any("cell" in x for x in final)
    at = [(r.song, r.onset) for r in onsets.collect()]
    for r in out.collect():
        mine = [y for s, k, y in points.collect() if (s, k) == (r.song, r.scale_no)] if r.cell in (0, 6) else None
        if mine is not None:
            near = [o for s, o in at if s == r.song]
            want = sum(min([500.0, *(abs(y + offsets[r.cell] - o) for o in near)]) for y in mine)
            assert r.cost == pytest.approx(want)


def test_states_before_the_next_candidate_are_dropped(spark, monkeypatch):
    """Every mora has one note at its onset: of all the states behind it one is kept."""
    sizes = []
    fold = M.fold_sorted

    def spy(rows, by, order, step, schema):
        state = None
        for row in rows.orderBy(*by, *order).collect():
            state, _ = step(state, row.asDict())
            sizes.append(len(state[0]))
        return fold(rows, by, order, step, schema)

    monkeypatch.setattr(M, "fold_sorted", spy)
    n = 60
    moras = spark.createDataFrame([(1, i, i * 5_000, 60) for i in range(n)], "song int, mora bigint, onset bigint, mp bigint")
    notes = spark.createDataFrame([(1, i, i * 5_000, i * 5_000 + 90, 60) for i in range(n)], "song int, note bigint, s bigint, e bigint, np bigint")
    out = M.match_moras(moras, notes, "song", "mora", "onset", "mp", "note", "s", "e", "np").collect()
    assert {(r.mora, r.note) for r in out} == {(i, i) for i in range(n)} and max(r.total for r in out if r.total is not None) == 0
    assert max(sizes) <= 3


class Held:
    """State of one group in memory, counting the calls that change it."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, [], 0

    def getMapState(self, name, *schema):  # noqa: N802
        part = Held()
        part.updateValue = lambda k, v: (self.count(), part.values.__setitem__(k, v))  # noqa: N815
        part.containsKey, part.getValue, part.removeKey = part.values.__contains__, part.values.__getitem__, part.values.pop  # noqa: N815
        return part

    def getValueState(self, name, schema):  # noqa: N802
        part = Held()
        part.update = lambda v: (self.count(), part.values.__setitem__(0, v))
        part.exists, part.get, part.clear = lambda: 0 in part.values, lambda: part.values[0], part.values.clear
        return part

    def count(self):
        self.calls += 1

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.due

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.due


def test_keys_of_a_stream_share_state_and_timers():
    handle, rule = Held(), S.InOrder(S.at_most(2), 100, 40)
    rule.init(handle)
    rows = [(k, at, 1000 * k + at, k, 8 if k == 7 else 0) for k in range(50) for at in (70, 3, 1, 2, 50)]
    list(rule.handleInputRows((1,), iter([pd.DataFrame(rows[:90], columns=S._FIELDS), pd.DataFrame(rows[90:], columns=S._FIELDS)]), None))
    assert handle.calls == 8 and len(handle.timers) == 2
    got = {}
    for end in sorted(handle.timers):
        handle.due = end
        for out in rule.handleExpiredTimer((1,), handle, handle):
            got.update(zip(out["id"].tolist(), out["verdict"].tolist(), strict=True))
    assert got == {1000 * k + at: "accepted" if at < 3 else "rejected" for k in range(50) for at in (70, 3, 1, 2, 50)}


def test_words_are_counted_where_their_document_lies(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(i, "known words here " * 3, "en", "s", 9) for i in range(40)], "doc_id bigint, text string, lang string, source string, n_chars int").repartition(40).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, "known")], "item_id int, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, "words")], "p_partkey int, p_name string").write.parquet(f"{d}/part.parquet")
    df = entry.queries()["j13_sound_alike_per_document"](spark, d)
    assert {(r.n_words, r.n_matched, r.total_cost) for r in df.collect()} == {(9, 6, 0)}
    assert not re.search(r"hashpartitioning\(doc_id#\d+L, word", df._jdf.queryExecution().executedPlan().toString())


def test_songs_share_subtitle_files(spark, tmp_path):
    rng = random.Random(16)
    kinds = ["view", "a\tb", "\t", None, "x\ry", "x\r\ny", "$1 \\1"]
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(2_592_000)), rng.randrange(-5, 40), rng.choice(kinds), float(rng.randrange(90))) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").withColumn("props", F.lit("{}"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    base = ensure_checkpoint_dir(spark)
    old = set(glob.glob(f"{base}/subtitles-*"))
    got = sorted(entry.queries()["s11_srt_blocks"](spark, str(tmp_path)).collect())
    (folder,) = set(glob.glob(f"{base}/subtitles-*")) - old
    assert 1 <= len(glob.glob(f"{folder}/**/part-*", recursive=True)) <= 8  # 45 songs, one file for each before
    clock = lambda t: f"{t // 3600000:02d}:{t // 60000 % 60:02d}:{t // 1000 % 60:02d},{t % 1000:03d}"
    want = []
    for song in {r[2] for r in rows}:
        mine = sorted((int((ts - datetime(2024, 1, 1)).total_seconds()) // 100, i, kind, value) for i, ts, s, kind, value in rows if s == song)
        for k, (start, _, kind, value) in enumerate(mine, 1):
            if kind is not None:
                end = start + 1 + int(value * 100) // 10
                want.append((song, k, f"{k}\n{clock(start)} --> {clock(end)}\n" + kind.replace("\r\n", "\n").replace("\r", "\n")))
    assert got == sorted(want)


def test_measure_starts_are_neither_sorted_nor_kept_apart_before_they_are_summed_up(spark):
    rng = random.Random(20)
    starts = [(rng.randrange(4), rng.randrange(-300, 900)) for _ in range(60)] * 2
    points = [(i, rng.choice([0, 1, 2, 3, 4]), rng.choice([None, *range(-400, 1000, 7)])) for i in range(300)] * 2
    m = spark.createDataFrame(starts, "song bigint, m_start bigint")
    e = spark.createDataFrame(points, "id bigint, song bigint, at bigint")
    out = TJ.snap_to_measure_start(e, m, ["song"], "at", 256)
    assert out.columns == ["id", "song", "at", "m_start"] and nodes(out, "SortAggregate") == 0 and nodes(out, "HashAggregate") == 2
    last = lambda s, t: max((x for k, x in starts if k == s and t is not None and x <= t), default=None)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((i, s, t, last(s, t)) for i, s, t in points), key=str)


def test_state_stores_make_no_lookup_to_count_their_rows(spark):
    store = "spark.sql.streaming.stateStore.rocksdb"
    configure(spark)
    assert spark.conf.get(f"{store}.trackTotalNumberOfRows") == "false"
    assert spark.conf.get(f"{store}.changelogCheckpointing.enabled") == "true"
