"""As-of, range and interval joins built from equi joins and ordered scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.plans.ordered import by_width, last_known, next_known, scan


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    take: Sequence[str],
    width: int | float,
    direction: str = "backward",
    tie: Sequence[str] = (),
    strict: bool = False,
    cut: bool = False,
) -> DataFrame:
    """Add the ``take`` columns of the closest right row at or before (after) ``left_on``.

    One union and one sliced scan, so no row of the left side meets more than
    one row of the right. ``tie`` orders right rows with equal time; for
    ``backward`` the last of them wins, for ``forward`` the first. ``strict``
    leaves out right rows at exactly the left time. Direction ``both`` gives
    ``prev_*`` (at or before) and ``next_*`` (after) columns from one scan.
    ``cut`` as in ``scan``.
    """
    by = list(by)
    packed = F.struct(*[F.col(c).alias(c) for c in take], F.lit(True).alias("__hit"))
    tie_values = [F.col(c) for c in tie]
    ties = [f"__tie{i}" for i in range(len(tie))]
    right_first = direction == "both" or (direction == "backward") != strict
    r = right.select(
        *by,
        F.col(right_on).alias("__t"),
        F.lit(0 if right_first else 1).alias("__side"),
        *[c.alias(n) for c, n in zip(tie_values, ties)],
        packed.alias("__r"),
        F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l"),
    )
    l = left.select(
        *by,
        F.col(left_on).alias("__t"),
        F.lit(1 if right_first else 0).alias("__side"),
        *[F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in zip(tie, ties)],
        F.lit(None).cast(r.schema["__r"].dataType).alias("__r"),
        F.struct("*").alias("__l"),
    )
    both = l.unionByName(r)
    order = ["__t", "__side", *ties]
    if direction == "both":
        hit = scan(both, by, order, by_width("__t", width), cut, __m=last_known("__r"), __n=next_known("__r"))
        return hit.where(F.col("__l").isNotNull()).select(
            "__l.*",
            *[F.col("__m")[c].alias(f"prev_{c}") for c in take],
            *[F.col("__n")[c].alias(f"next_{c}") for c in take],
        )
    spec = last_known if direction == "backward" else next_known
    hit = scan(both, by, order, by_width("__t", width), cut, __m=spec("__r"))
    return hit.where(F.col("__l").isNotNull()).select(
        "__l.*", *[F.col("__m")[c].alias(c) for c in take]
    )


def points_in_spans(
    points: DataFrame,
    spans: DataFrame,
    by: Sequence[str],
    at: str,
    start: str,
    end: str,
    width: int | float,
    how: str = "inner",
) -> DataFrame:
    """Rows of ``points`` with ``start <= at < end``, matched through time buckets."""
    by = list(by)
    p = points.withColumn("__b", by_width(at, width))
    s = spans.where(F.col(start) < F.col(end)).withColumn(
        "__b", F.explode(_buckets(F.col(start), F.col(end), width))
    )
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    keys = [*by, "__b"]
    s = s.select(*[F.col(c).alias(f"__s_{c}") if c in keys else F.col(c) for c in s.columns])
    on = inside
    for k in keys:
        on = on & (p[k] == F.col(f"__s_{k}"))
    joined = p.join(s, on, how)
    return joined.drop("__b", *[f"__s_{k}" for k in keys])


def overlapping_pairs(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    width: int | float,
) -> DataFrame:
    """Pairs with ``a.start < b.end and b.start < a.end``; each pair appears once.

    Both sides are cut at bucket borders; a pair is kept in the bucket where
    the later of the two starts.
    """
    by = list(by)
    (a0, a1), (b0, b1) = a_span, b_span
    left = a.where(F.col(a0) < F.col(a1)).withColumn(
        "__b", F.explode(_buckets(F.col(a0), F.col(a1), width))
    )
    right = b.where(F.col(b0) < F.col(b1)).withColumn(
        "__b", F.explode(_buckets(F.col(b0), F.col(b1), width))
    )
    meet = (
        (F.col(a0) < F.col(b1))
        & (F.col(b0) < F.col(a1))
        & (F.col("__b") == by_width(F.greatest(F.col(a0), F.col(b0)), width))
    )
    return left.join(right, [*by, "__b"]).where(meet).drop("__b")


def _buckets(start: Column, end: Column, width: int | float) -> Column:
    first = F.floor(start / F.lit(width)).cast("bigint")
    last = F.ceil(end / F.lit(width)).cast("bigint") - 1
    return F.sequence(first, F.greatest(first, last))
