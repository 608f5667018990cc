"""Filters, routing rules, templates and parameter parsing."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.functions import text as T
from versemill.plans.ordered import all_of, any_of, by_width, row_number, scan


def facet_filter(selected: Mapping[str, Sequence[Column]]) -> Column:
    """Alternatives of one facet are OR-ed, facets are AND-ed; an empty facet adds nothing."""
    clauses = [any_of(list(values)) for values in selected.values() if values]
    return all_of(clauses) if clauses else F.lit(True)


def equals_any(columns: Sequence[str], value) -> Column:
    return any_of([F.col(c) == F.lit(value) for c in columns])


def contains(column: str, value: str) -> Column:
    return F.col(column).contains(value)


def default_filter(rows: DataFrame, facets: DataFrame, list_: str, columns: Sequence[str]) -> DataFrame:
    """Keep rows that meet the default values of their list's facets.

    ``facets``: list, facet, column, value, is_default. The rules of a list are
    packed into one array, so a row meets its rules without being multiplied.
    """
    chosen = facets.where("is_default")
    rules = (
        chosen.groupBy(list_, "facet")
        .agg(F.collect_list(F.struct("column", "value")).alias("values"))
        .groupBy(list_)
        .agg(F.collect_list("values").alias("__rules"))
    )
    cell = F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns])
    )
    ok = F.forall(
        "__rules",
        lambda values: F.exists(values, lambda r: F.element_at(F.col("__cell"), r["column"]) == r["value"]),
    )
    joined = rows.withColumn("__cell", cell).join(rules, list_, "left")
    return joined.where(F.col("__rules").isNull() | ok).drop("__cell", "__rules")


def survives_round_trip(filters: DataFrame, facets: DataFrame, list_: str, where: str) -> DataFrame:
    """Does a filter rebuilt from the facet fragments found in it equal the filter.

    ``facets``: list, facet_no, value_no, fragment. A fragment counts only
    between delimiters, so ``x~=a`` is not found inside ``x~=ab``.

    Pieces of a filter between two delimiters look up the fragments of their list, so no
    filter is held against all fragments; equal filters of a list are rebuilt once.
    """
    starts, ends = r"(?s)(?<=^|\(| or | and )(?=(.*))", r"(?s)(?<=^|^\r|^\n|^\n\r|^\u0085|^\u2028|^\u2029|\)| ro | dna )(?=(.*))"
    pieces = lambda s: F.transform(F.regexp_extract_all(F.reverse(s), F.lit(ends), 1), F.reverse)
    lists = facets.groupBy(list_).agg(F.max(F.length("fragment")).alias("__longest"))
    known = filters.select(list_, F.col(where).alias("__w")).distinct().join(lists, list_)
    # What is cut off is longer than any fragment, with room for the delimiter behind it.
    tails = F.transform(F.regexp_extract_all("__w", F.lit(starts), 1), lambda s: F.substring(s, F.lit(1), F.col("__longest") + 8))
    found = known.select(list_, "__w", F.explode(F.array_distinct(F.flatten(F.transform(tails, pieces)))).alias("fragment"))
    found = found.join(facets.select(list_, "facet_no", "value_no", "fragment"), [list_, "fragment"])
    values = F.transform(F.array_sort(F.collect_list(F.struct("value_no", "fragment"))), lambda v: v["fragment"])
    clauses = found.groupBy(list_, "__w", "facet_no").agg(F.concat(F.lit("("), F.array_join(values, " or "), F.lit(")")).alias("clause"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("facet_no", "clause"))), lambda f: f["clause"])
    rebuilt = clauses.groupBy(list_, "__w").agg(F.array_join(ordered, " and ").alias("__rebuilt"))
    rebuilt = rebuilt.withColumnRenamed("__w", where)
    out = filters.join(rebuilt, [list_, where], "left").join(lists.select(list_, F.lit(True).alias("__known")), list_, "left")
    is_known = F.col("__known").isNotNull()
    return (
        out.withColumn("restored", F.when(is_known, F.coalesce("__rebuilt", F.lit(""))).otherwise(F.col(where)))
        .withColumn("survives", is_known & (F.col("restored") == F.col(where)))
        .select(*filters.columns, "restored", "survives")
    )


def element_visible(
    require: str | None = None,
    require_empty: str | None = None,
    require_prefix: Mapping[str, str] | None = None,
    require_not_prefix: Mapping[str, str] | None = None,
) -> Column:
    """Conditions of a layout element, all of which must hold."""
    tests = [F.lit(True)]
    if require:
        tests.append(~T.is_missing(F.col(require)))
    if require_empty:
        tests.append(T.is_missing(F.col(require_empty)))
    for c, prefix in (require_prefix or {}).items():
        tests.append(~T.is_missing(F.col(c)) & F.col(c).startswith(prefix))
    for c, prefix in (require_not_prefix or {}).items():
        tests.append(T.is_missing(F.col(c)) | ~F.col(c).startswith(prefix))
    return all_of([F.coalesce(t, F.lit(False)) for t in tests])


def route(df: DataFrame, row_missing: Column, image: str, image_needed: Column, texts: str, fallback_texts: str) -> DataFrame:
    """``use_fallback`` for rows without data or with an empty image frame; ``shown`` if anything is left."""
    has_image = ~T.is_missing(F.col(image))
    any_text = lambda c: F.exists(c, lambda t: F.length(F.trim(t)) > 0)
    use_fallback = row_missing | (~has_image & (image_needed | ~any_text(F.col(texts))))
    shown = has_image | F.when(use_fallback, any_text(F.col(fallback_texts))).otherwise(any_text(F.col(texts)))
    return df.withColumn("use_fallback", use_fallback).withColumn("shown", shown)


def template(text: str, columns: Sequence[str]) -> Column:
    """``{col}`` places filled from the row; unknown columns and missing values are empty."""
    parts = re.split(r"(\{\w+\})", text)
    out = []
    for part in parts:
        if re.fullmatch(r"\{\w+\}", part):
            name = part[1:-1]
            if name in columns:
                out.append(F.coalesce(T.blank_missing(F.col(name).cast("string")), F.lit("")))
        elif part:
            out.append(F.lit(part))
    return F.trim(F.concat(*out)) if out else F.lit("")


def lifespan(birth: Column, death: Column) -> Column:
    b, d = ~T.is_missing(birth), ~T.is_missing(death)
    return (
        F.when(b & d, F.concat(birth, F.lit("-"), death))
        .when(b, F.concat(birth, F.lit("年生まれ")))
        .when(d, F.concat(death, F.lit("年没")))
        .otherwise("")
    )


def parse_params(spec: Column) -> Column:
    """Map of ``K=V`` items separated by newline, semicolon or bar; the later one wins.

    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``.
    """
    items = F.filter(
        F.split(spec, "[\n;|]"), lambda p: p.contains("=") & (F.trim(F.substring_index(p, "=", 1)) != "")
    )
    pairs = F.transform(
        items,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("key"),
            F.trim(F.regexp_replace(p, "(?s)^[^=]*=", "")).alias("value"),
        ),
    )
    return F.map_from_entries(pairs)


def typed_value(value: Column) -> Column:
    """Struct with the kind of a parameter (bool, int, float, string) and its typed form."""
    is_bool = F.lower(value).isin("true", "false")
    as_int = F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), value.try_cast("bigint"))
    as_float = F.when(value.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), value.try_cast("double"))
    kind = (
        F.when(is_bool, "bool").when(as_int.isNotNull(), "int").when(as_float.isNotNull(), "float").otherwise("string")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(is_bool, F.lower(value) == "true").alias("flag"),
        as_int.alias("whole"),
        as_float.alias("real"),
    )


def time_slice(notes: DataFrame, lines: DataFrame, keys: Sequence[str], start: Column, lo: Column, hi: Column):
    """Notes starting in [lo, hi) and the lines that keep at least one of them."""
    kept = notes.where((start >= lo) & (start < hi))
    return kept, lines.join(kept.select(*keys).distinct(), list(keys), "left_semi")


def preview_windows(notes: DataFrame, song: str, line: str, start: str, pitch: str) -> DataFrame:
    """First start, and the lines holding the highest and the lowest pitch (first line on a tie)."""
    high = F.max_by(F.col(line), F.struct(F.col(pitch), -F.col(line)))
    low = F.min_by(F.col(line), F.struct(F.col(pitch), F.col(line)))
    return notes.groupBy(song).agg(
        F.min(start).alias("head_start"), high.alias("high_line"), low.alias("low_line")
    )


def owner_jobs(jobs: DataFrame, owner: str, created: str, job: str, width: int) -> DataFrame:
    """Jobs of every owner, numbered newest first."""
    back = jobs.withColumns({"__c": -F.col(created), "__j": -F.col(job)})
    return scan(back, [owner], ["__c", "__j"], by_width("__c", width), place=row_number()).drop("__c", "__j")


def accompaniment(events: DataFrame, melody: Column, is_drum: Column, pitch: str, shift: Column) -> DataFrame:
    """Melody rows removed; other pitches moved by the key shift within 0..127, drums untouched."""
    moved = F.greatest(F.lit(0), F.least(F.lit(127), F.col(pitch) + shift))
    return events.where(~melody).withColumn(pitch, F.when(is_drum, F.col(pitch)).otherwise(moved))


def word_record(words: DataFrame, rows: DataFrame, on: Column, word_fields: Mapping[str, Column]) -> DataFrame:
    """List row columns overlaid with the word's own non-empty fields."""
    joined = words.join(rows, on, "left")
    own = {
        name: F.coalesce(F.when(F.trim(c) != "", c), F.col(name) if name in rows.columns else F.lit(None))
        for name, c in word_fields.items()
    }
    return joined.withColumns(own)


def inject_default(df: DataFrame, songs: DataFrame, song: str, tick: str, defaults: Mapping[str, Column]) -> DataFrame:
    """A row at tick 0 for every song whose first row is missing or later."""
    first = df.groupBy(song).agg(F.min(tick).alias("__first"))
    need = songs.select(song).distinct().join(first, song, "left").where(
        F.col("__first").isNull() | (F.col("__first") > 0)
    )
    head = need.select(song, F.lit(0).cast(df.schema[tick].dataType).alias(tick), *[c.alias(n) for n, c in defaults.items()])
    return df.select(song, tick, *defaults).unionByName(head)
