"""Placement of moras on notes and expansion of compressed moras."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versemill.functions import kana as K

# Rows of candidates that a task hands on at a time.
BATCH = 8_192
# Below the score of any placement.
NONE = -(1 << 40)


def fitting_subsets(sizes: Sequence[int], budget: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Non-empty subsets of slots whose total size fits the budget, with their totals: more slots first, then earlier ones.

    The least total of any ``r`` slots from a place on tells whether a beginning can be
    completed, so every step leads to a subset and the next one costs a few steps.
    """
    n = len(sizes)
    least = [[0, *accumulate(sorted(sizes[i:]))] for i in range(n + 1)]

    def extend(start: int, missing: int, left: int) -> Iterator[tuple[tuple[int, ...], int]]:
        if not missing:
            yield (), 0
            return
        for i in range(start, n - missing + 1):
            rest = left - sizes[i]
            if least[i + 1][missing - 1] <= rest:
                for others, total in extend(i + 1, missing - 1, rest):
                    yield (i, *others), sizes[i] + total

    for count in range(n, 0, -1):
        if least[0][count] <= budget:
            yield from extend(0, count, budget)


def expansion_candidates(lines: DataFrame, key: str, sizes: str, budget: str, limit: int | None = 64) -> DataFrame:
    """(key, rank, slots, added): the first ``limit`` subsets of a line's slots that fit its budget, or all of them.

    ``sizes`` holds the number of moras hidden in each slot of a line, of which there may
    be any number; sizes are not negative. Lines without slots have no candidates.
    """
    schema = T.StructType([lines.schema[key]]).add("rank", T.LongType()).add("slots", T.StringType()).add("added", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(batch.column("sizes").to_pylist(), batch.column("budget").to_pylist(), strict=True)
            rows = (
                (i, rank, ",".join(map(str, slots)), added)
                for i, (sizes_, budget_) in enumerate(given)
                for rank, (slots, added) in enumerate(islice(fitting_subsets(sizes_ or [], budget_ or 0), limit), 1)
            )
            while some := list(islice(rows, BATCH)):
                which, rank, slots, added = zip(*some, strict=True)
                keys = batch.column(key).take(pa.array(which))
                cells = [pa.array(rank, pa.int64()), pa.array(slots, pa.string()), pa.array(added, pa.int64())]
                yield pa.RecordBatch.from_arrays([keys, *cells], schema.names)

    need = lines.select(key, F.col(sizes).cast("array<bigint>").alias("sizes"), F.col(budget).cast("bigint").alias("budget"))
    return need.mapInArrow(run, schema)


def place_moras(df: DataFrame, moras: str, notes: str, force_first: bool = True) -> DataFrame:
    """Order-preserving placement of a word's moras on its notes with the best total score.

    A pair scores 1000 for an equal vowel, 10 for an equal consonant and up to
    2 for elements that do not tend to vanish. A sokuon stays next to the mora
    before it. Of equal scores the placement whose last mora is earliest wins,
    then the one before it. Best scores are carried mora by mora over the notes, so the
    cost is moras times notes; everything happens inside the row, without a shuffle.
    ``positions`` is null when there is no placement.
    """
    m, n = F.col(moras), F.col(notes)
    eu, k = F.size(m), F.size(n)
    drop_m, drop_n = K.dropout_flags(m), K.dropout_flags(n)
    places = lambda: F.sequence(F.lit(0), k - 1)
    none = F.lit(NONE).cast("bigint")

    def pair(i, j):
        a, b = F.element_at(m, i + 1), F.element_at(n, j + 1)
        same_vowel = K.vowel_of(a).eqNullSafe(K.vowel_of(b))
        same_cons = K.consonant_of(a) == K.consonant_of(b)
        tie = (~F.element_at(drop_m, i + 1)).cast("int") + (~F.element_at(drop_n, j + 1)).cast("int")
        score = F.when((a == "") | (b == ""), 0).otherwise(1000 * same_vowel.cast("int") + 10 * same_cons.cast("int") + tie)
        return score.cast("bigint")

    table = F.transform(F.sequence(F.lit(0), eu - 1), lambda i: F.transform(places(), lambda j: pair(i, j)))
    # Exploding a one-element array keeps the score table from being computed again.
    scored = df.where((eu > 0) & (k > 0)).withColumn("__t", F.explode(F.array(table)))
    start = F.transform(F.get("__t", F.lit(0)), lambda s, j: F.when((j == 0) | F.lit(not force_first), s).otherwise(none))
    nobody = F.struct(none.alias("score"), F.lit(-1).alias("at"))

    def before(row):
        """Per note the best score of the mora before on an earlier note, and the first such note."""
        first = F.struct(F.array(nobody).alias("list"), nobody.alias("top"))

        def reach(s, x):
            top = F.when(x["score"] > s["top"]["score"], x).otherwise(s["top"])
            return F.struct(F.array_append(s["list"], top).alias("list"), top.alias("top"))

        numbered = F.transform(row, lambda v, j: F.struct(v.alias("score"), j.alias("at")))
        return F.slice(F.aggregate(numbered, first, reach, lambda s: s["list"]), F.lit(1), k)

    def beside(row):
        return F.transform(row, lambda _, j: F.when(j > 0, F.struct(F.get(row, j - 1).alias("score"), (j - 1).alias("at"))).otherwise(nobody))

    def step(s, x):
        chosen = F.when(x["mora"] == "ッ", beside(s["row"])).otherwise(before(s["row"]))
        reached = F.zip_with(chosen, x["scores"], lambda c, v: F.when(c["score"] >= 0, c["score"] + v).otherwise(none))
        return F.struct(reached.alias("row"), F.array_append(s["backs"], F.transform(chosen, lambda c: c["at"])).alias("backs"))

    state = F.struct(start.alias("row"), F.array().cast("array<array<int>>").alias("backs"))
    others = F.slice(F.zip_with(m, F.col("__t"), lambda a, s: F.struct(a.alias("mora"), s.alias("scores"))), F.lit(2), F.greatest(eu - 1, F.lit(1)))
    solved = scored.withColumn("__s", F.explode(F.array(F.aggregate(others, state, step))))
    best = F.array_max("__s.row")
    last = (F.array_position(F.col("__s.row"), best) - 1).cast("int")
    path = F.struct(last.alias("at"), F.array(last).alias("taken"))

    def back(s, row):
        at = F.get(row, s["at"])
        return F.struct(at.alias("at"), F.concat(F.array(at), s["taken"]).alias("taken"))

    taken = F.aggregate(F.reverse("__s.backs"), path, back, lambda s: s["taken"])
    return solved.select(
        *df.columns,
        F.when(best >= 0, best).alias("score"),
        F.when(best >= 0, taken).alias("positions"),
    )
