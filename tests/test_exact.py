"""Values that must come through unchanged, and trees without a depth limit."""

from __future__ import annotations

from versemill.plans.fold import fold_sorted
from versemill.sources.documents import flatten_groups


def test_fold_keeps_large_numbers_and_nulls(spark):
    rows = spark.createDataFrame([(1, 1, 9007199254740993), (1, 2, None)], "k long, at long, v long")

    def step(state, row):
        return None, (row["v"],)

    got = fold_sorted(rows, ["k"], ["at"], step, "seen long").orderBy("at").collect()
    assert [(r.v, r.seen) for r in got] == [(9007199254740993, 9007199254740993), (None, None)]


def test_settings_tree_of_twelve_levels(spark):
    rows = [(i, i - 1 if i else None, f"L{i}") for i in range(12)]
    got = flatten_groups(spark.createDataFrame(rows, "id long, parent long, label string")).collect()
    assert [r.path for r in got] == ["/".join(f"L{i}" for i in range(12))]


def test_list_fingerprint_is_the_hash_of_the_list(spark):
    """Lists across batches, single rows, null lines and null keys."""
    import hashlib

    from pyspark.sql import functions as F

    from versemill.operators import validation as V

    rows = [(f"l{i % 3}" if i % 50 else None, i, f"word é {i}" if i % 7 else None) for i in range(3_000)] + [("one", 1, "x")]
    frame = spark.createDataFrame(rows, "list string, id long, line string").repartition(4)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.list: (r.fingerprint, r.n_rows) for r in V.list_fingerprint(frame, ["list"], ["id"], F.col("line")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    lists = {}
    for name, i, line in sorted(rows, key=lambda r: r[1]):
        lists.setdefault(name, []).append(line or "")
    assert got == {k: (hashlib.sha256("\n".join(v).encode()).hexdigest()[:16], len(v)) for k, v in lists.items()}
