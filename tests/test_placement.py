"""Placement and expansion at sizes where all masks cannot be tried, and against all of them where they can."""

from __future__ import annotations

import itertools
import random

import __spark_entry__ as entry
from versemill.operators import placement as PL


def test_subsets_in_order_against_all_masks():
    rng = random.Random(3)
    for n in range(9):
        for _ in range(30):
            sizes, budget = [rng.randrange(0, 4) for _ in range(n)], rng.randrange(0, 12)
            every = [c for k in range(n, 0, -1) for c in itertools.combinations(range(n), k)]
            want = [(c, sum(sizes[i] for i in c)) for c in every if sum(sizes[i] for i in c) <= budget]
            assert list(PL.fitting_subsets(sizes, budget)) == want


def test_many_slots_and_no_limit(spark):
    rows = [("a", [1 + i % 3 for i in range(30)], 31), ("b", [1] * 12, 12), ("c", [], 4), ("d", None, None), (None, [2, 2], 3)]
    frame = spark.createDataFrame(rows, "line string, sizes array<int>, budget int")
    got = PL.expansion_candidates(frame, "line", "sizes", "budget").collect()
    some = [r for r in got if r.line == "a"]
    assert [r.rank for r in some] == list(range(1, 65)) and all(r.added <= 31 for r in some)
    # Ten ones, then five twos use 20 up; the rest cannot add a sixteenth slot within 31.
    assert all(len(r.slots.split(",")) == len(some[0].slots.split(",")) for r in some)
    assert sum(r.line is None for r in got) == 2
    whole = PL.expansion_candidates(frame.where("line = 'b'"), "line", "sizes", "budget", limit=None)
    assert whole.count() == 2**12 - 1


def test_query_returns_all_subsets(spark, tmp_path):
    """More subsets than 64, and subsets with slots behind the sixteenth."""
    rng = random.Random(6)
    lines = {1: [rng.choice([1, 2, 5]) for _ in range(9)], 2: [3, 6] * 8 + [5], 3: [6], 4: [2]}
    rows = [(k, i, i, i, 1.0, float(q)) for k, qs in lines.items() for i, q in enumerate(qs)]
    names = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double"
    spark.createDataFrame(rows, names).repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    want = []
    for k, qs in lines.items():
        budget, n = sum(q % 3 for q in qs), len(qs)
        fit = (c for r in range(n, 0, -1) for c in itertools.combinations(range(n), r) if sum(1 + qs[i] % 2 for i in c) <= budget)
        want += [(k, rank, ",".join(map(str, c)), sum(1 + qs[i] % 2 for i in c)) for rank, c in enumerate(fit, 1)]
    got = entry.queries()["f11_expansion_candidates"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("line_id", "rank", "slots", "added").collect()) == sorted(want)
    assert sum(w[0] == 1 for w in want) > 64 and any(w[0] == 2 and "16" in w[2].split(",") for w in want)


def test_forty_notes(spark):
    moras = ["ア", "カ", "ッ", "タ", "イ"] * 4
    notes = [x for mora in moras for x in (mora, "ン")]
    frame = spark.createDataFrame([(1, moras, notes), (2, ["ア", "ッ"], ["ア"]), (3, ["ッ", "ア"], ["ッ", "ア"])], "id long, moras array<string>, notes array<string>")
    got = {r.id: r for r in PL.place_moras(frame, "moras", "notes").collect()}
    at = got[1].positions
    assert len(notes) == 40 and at == sorted(set(at)) and at[0] == 0
    assert all(at[i] == at[i - 1] + 1 for i, mora in enumerate(moras) if mora == "ッ")
    assert got[2].positions is None and got[2].score is None
    assert got[3].positions == [0, 1]
