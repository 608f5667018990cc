"""Proportional stratified interleaving: shards of near-equal row counts that all match the corpus mixture.

Rows are shuffled within their source by a seeded hash and ranked; rank over source
size is a row's place between 0 and 1, so every stretch of places holds each source in
its share. Rows in order of place are cut into shards of equal counts. Only DataFrame
functions are used, and no source or shard is ever ranked in one task: ranks count
within slices of the hash, or of the place, on top of the slices before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.llm.common import stored

SHARDS = 8
SEED = "interleave-1"
# Rows that one slice holds on average at most.
SLICE_ROWS = 2_000


def _ranks(rows: DataFrame, group: list[str], slice_: str, order: list[str], name: str) -> DataFrame:
    """Rows with their rank from 0 within ``group``, slices ascending, and the group's size as ``group_rows``."""
    keys = ", ".join([*group, slice_])
    counts = rows.groupBy(*group, slice_).agg(F.count("*").alias("in_slice"))
    whole = f"partition by {', '.join(group)}" if group else ""
    before = counts.selectExpr(
        *group,
        slice_,
        f"sum(in_slice) over ({whole} order by {slice_} rows between unbounded preceding and current row) - in_slice as before",
        f"sum(in_slice) over ({whole}) as group_rows",
    )
    placed = rows.selectExpr("*", f"row_number() over (partition by {keys} order by {', '.join(order)}) - 1 as within")
    return placed.join(before, [*group, slice_]).withColumn(name, F.col("before") + F.col("within")).drop(
        "before", "within"
    )


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source: Column | None = None,
) -> DataFrame:
    """(doc_id, size, text_crc32, stratum, shard, slot): counts of shards are at most one apart.

    The shuffle key is the MD5 of seed, id and text, so a null text counts as empty with
    size 1, rows equal in both are interchangeable, and a null source is a source of its
    own. Fewer rows than shards leave shards empty; no rows give no rows.
    """
    source = F.col("source") if source is None else source
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("?")), text))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string"))).alias("stratum"),
        key.alias("key"),
    )
    rows = stored(rows, "shuffled")
    total = rows.count()
    slices = max(1, math.ceil(total / SLICE_ROWS))
    digits = max(0, math.ceil(math.log(slices, 16)))
    rows = rows.withColumn("key_slice", F.substring("key", 1, digits) if digits else F.lit(""))
    ranked = _ranks(rows, ["stratum"], "key_slice", ["key", "doc_id"], "source_rank")
    # Half-way between two ranks: exact in both engines, as the numbers are far below 2 ** 53.
    place = (2 * F.col("source_rank") + 1).cast("double") / (2 * F.col("group_rows")).cast("double")
    placed = ranked.withColumn("place", place).drop("group_rows", "key_slice")
    placed = placed.withColumn("place_slice", F.floor(F.col("place") * slices))
    ordered = _ranks(placed, [], "place_slice", ["place", "stratum", "key", "doc_id"], "position")
    n = max(total, 1)
    return ordered.selectExpr(
        "doc_id",
        "size",
        "text_crc32",
        "stratum",
        f"cast(position * {shards} div {n} as int) as shard",
        f"cast(position - ((position * {shards} div {n}) * {n} + {shards - 1}) div {shards} as bigint) as slot",
    )
