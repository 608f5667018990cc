"""Ordered scans that stay parallel when one key holds most of the rows.

A plain window over ``PARTITION BY song`` puts a whole song in one task. Here
the rows of a key are cut into slices of the ordering column (a minute of a
song, a block of line numbers). Window functions run inside ``(key, slice)``;
one summary row per slice is scanned per key and its result is carried into
the slice. The biggest unit of work is a slice, plus one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.session import ensure_checkpoint_dir

_SLICE = "__slice"


@dataclass(frozen=True)
class Spec:
    kind: str
    expr: Column
    inclusive: bool = True


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lag(expr: Column | str) -> Spec:
    """Value of the previous row of the key."""
    return Spec("lag", _col(expr))


def lead(expr: Column | str) -> Spec:
    """Value of the next row of the key."""
    return Spec("lead", _col(expr))


def running_sum(expr: Column | str, inclusive: bool = True) -> Spec:
    return Spec("sum", _col(expr), inclusive)


def running_max(expr: Column | str, inclusive: bool = True) -> Spec:
    return Spec("max", _col(expr), inclusive)


def running_min(expr: Column | str, inclusive: bool = True) -> Spec:
    return Spec("min", _col(expr), inclusive)


def last_known(expr: Column | str, inclusive: bool = True) -> Spec:
    """Latest non-null value up to this row (or before it)."""
    return Spec("last", _col(expr), inclusive)


def next_known(expr: Column | str, inclusive: bool = True) -> Spec:
    """Earliest non-null value from this row on (or after it)."""
    return Spec("next", _col(expr), inclusive)


def least_ahead(expr: Column | str) -> Spec:
    """Least value from this row on."""
    return Spec("least_ahead", _col(expr))


def row_number() -> Spec:
    return Spec("sum", F.lit(1).cast("bigint"), True)


def by_width(column: Column | str, width: int | float) -> Column:
    """Slice number of a numeric ordering column."""
    return F.floor(_col(column) / F.lit(width)).cast("bigint")


def materialize(df: DataFrame) -> DataFrame:
    """Write rows that several branches of a plan read to the shared checkpoint folder.

    A scan reads its input twice (rows and slice summaries), so scans on top of
    scans would compute the lowest input once per path. Cut there, a chain
    costs one write per link, plans stay small, and a lost executor redoes one
    link only.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    cut: bool = False,
    **out: Spec,
) -> DataFrame:
    """Add one column per spec, computed over rows of ``by`` in ``order``.

    ``slice_by`` must not decrease along ``order`` and ``order`` must be total
    within a key. Key columns must not be null. ``cut`` materializes the input
    first: set it where the input is itself the result of a scan or a join.
    """
    by, order = list(by), list(order)
    if cut:
        df = materialize(df)
    base = df.withColumns({_SLICE: slice_by, **{f"__v_{n}": s.expr for n, s in out.items()}})

    cell = Window.partitionBy(*by, _SLICE)
    fwd = cell.orderBy(*[F.col(c).asc() for c in order])
    rev = cell.orderBy(*[F.col(c).desc() for c in order])
    unbounded = Window.unboundedPreceding
    position = F.struct(*[F.col(c) for c in order])

    local: dict[str, Column] = {}
    totals: list[Column] = []
    for name, spec in out.items():
        v = F.col(f"__v_{name}")
        end = 0 if spec.inclusive else -1
        frame = fwd.rowsBetween(unbounded, end)
        if spec.kind == "lag":
            local[name] = F.lag(F.struct(v.alias("v"))).over(fwd)
            totals.append(F.max_by(F.struct(v.alias("v")), position).alias(name))
        elif spec.kind == "lead":
            local[name] = F.lead(F.struct(v.alias("v"))).over(fwd)
            totals.append(F.min_by(F.struct(v.alias("v")), position).alias(name))
        elif spec.kind == "sum":
            local[name] = F.sum(v).over(frame)
            totals.append(F.sum(v).alias(name))
        elif spec.kind == "max":
            local[name] = F.max(v).over(frame)
            totals.append(F.max(v).alias(name))
        elif spec.kind == "min":
            local[name] = F.min(v).over(frame)
            totals.append(F.min(v).alias(name))
        elif spec.kind == "least_ahead":
            local[name] = F.min(v).over(rev.rowsBetween(unbounded, end))
            totals.append(F.min(v).alias(name))
        elif spec.kind == "last":
            local[name] = F.last(v, ignorenulls=True).over(frame)
            totals.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(name))
        elif spec.kind == "next":
            local[name] = F.last(v, ignorenulls=True).over(rev.rowsBetween(unbounded, end))
            totals.append(F.min_by(v, F.when(v.isNotNull(), position)).alias(name))

    along = Window.partitionBy(*by).orderBy(F.col(_SLICE).asc())
    back = Window.partitionBy(*by).orderBy(F.col(_SLICE).desc())
    before = along.rowsBetween(unbounded, -1)
    carried: list[Column] = []
    for name, spec in out.items():
        c = F.col(name)
        carry = {
            "lag": lambda: F.lag(c).over(along),
            "lead": lambda: F.lead(c).over(along),
            "sum": lambda: F.sum(c).over(before),
            "max": lambda: F.max(c).over(before),
            "min": lambda: F.min(c).over(before),
            "least_ahead": lambda: F.min(c).over(back.rowsBetween(unbounded, -1)),
            "last": lambda: F.last(c, ignorenulls=True).over(before),
            "next": lambda: F.last(c, ignorenulls=True).over(back.rowsBetween(unbounded, -1)),
        }[spec.kind]()
        carried.append(carry.alias(f"__c_{name}"))

    summary = (
        base.groupBy(*by, _SLICE)
        .agg(*totals)
        .select(*by, _SLICE, *carried)
    )
    cells = base.withColumns({f"__l_{n}": c for n, c in local.items()})
    joined = cells.join(summary, [*by, _SLICE], "left")

    final: dict[str, Column] = {}
    for name, spec in out.items():
        here, carry = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if spec.kind in ("lag", "lead"):
            final[name] = F.coalesce(here, carry)["v"]
        elif spec.kind in ("last", "next"):
            final[name] = F.coalesce(here, carry)
        elif spec.kind == "sum":
            total = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
            final[name] = F.when(here.isNotNull() | carry.isNotNull(), total)
        elif spec.kind == "max":
            final[name] = F.greatest(here, carry)
        else:
            final[name] = F.least(here, carry)
    kept = [c for c in df.columns if c not in final]
    return joined.select(*kept, *[c.alias(n) for n, c in final.items()])


def islands(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    starts_new: Column,
    name: str = "island",
) -> DataFrame:
    """Number runs of rows; ``starts_new`` is true on the first row of a run."""
    return scan(df, by, order, slice_by, cut=True, **{name: running_sum(starts_new.cast("bigint"))})


def top_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key. Spark trims every task to k rows per key before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_row(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the least in ``order``: an aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in by]
    keys = F.struct(*[_col(c) for c in order])
    row = F.min_by(F.struct(*rest), keys)
    return df.groupBy(*by).agg(row.alias("__row")).select(*by, "__row.*")


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    slice_by: Column,
    **ranks: Column,
) -> DataFrame:
    """Order statistics per key from a value histogram, without gathering a key's values.

    Each rank is a 0-based position written with the column ``n`` (rows of the
    key). Output: ``by``, ``n`` and one column per rank.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    hist = materialize(hist)
    sizes = hist.groupBy(*by).agg(F.sum("__c").alias("n"))
    hist = scan(hist, by, [value], slice_by, __upto=running_sum("__c")).join(sizes, list(by))
    picks = [
        F.min(F.when(F.col("__upto") > r, F.col(value))).alias(n) for n, r in ranks.items()
    ]
    return hist.groupBy(*by, "n").agg(*picks)


def median(df: DataFrame, by: Sequence[str], value: str, slice_by: Column) -> DataFrame:
    """Exact median per key as ``median`` (mean of the two middle values)."""
    q = exact_quantiles(
        df, by, value, slice_by,
        __lo=F.floor((F.col("n") - 1) / 2), __hi=F.floor(F.col("n") / 2),
    )
    return q.select(*by, "n", ((F.col("__lo") + F.col("__hi")) / 2).alias("median"))


def any_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def all_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
