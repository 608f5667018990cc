"""Helpers shared by the corpus operators: reading, written intermediate tables, array sums, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.session import ensure_checkpoint_dir

# Fixed value: a word is a run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: its lineage ends here.

    Lost executors do not lose the table, and a table that is read twice is computed once.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """All words of a text in order; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def exploded(rows: DataFrame, array: str, name: str, *others: str) -> DataFrame:
    """One row per array element. The outer form keeps the optimizer from testing the array's
    size in a filter below, where it would compute the array's expression a second time."""
    return rows.select(*others, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def passing(rows: DataFrame, verdict: str, row: str = "row") -> DataFrame:
    """The columns of struct ``row`` where ``verdict`` holds, without moving its expression below other projections."""
    some = rows.select(F.when(F.col(verdict), F.array(row)).alias("held"))
    return exploded(some, "held", "row").select("row.*")


def prefix_sums(values: Column, block: int = 128) -> Column:
    """Sum of all elements before each one. Blocks keep the appends of long arrays short."""
    empty = F.array().cast("array<bigint>")

    def run(numbers: Column, start: Column) -> Column:
        state = F.struct(empty.alias("sums"), start.cast("bigint").alias("at"))
        return F.aggregate(
            numbers,
            state,
            lambda s, x: F.struct(F.array_append(s["sums"], s["at"]).alias("sums"), (s["at"] + x).alias("at")),
        )["sums"]

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(block))
    blocks = F.transform(starts, lambda i: F.slice(values, i, block))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, run(totals, F.lit(0)), run))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that links reach from each node that has a link.

    Alternating stars: every node hands its larger neighbours to its smallest one,
    then its smaller ones, until nothing changes. Groups are only ever reduced to a
    minimum, and joins on a frequent node are split by adaptive execution. Each
    round is a written table, so rounds do not pile up lineage.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = stored(links, "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        links = stored(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
