"""Checks and normalisation of word lists, edits and manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from versemill.functions import text as T
from versemill.plans.ordered import first_row, row_number, scan, top_rows

# Upload limits per list, song length limit, columns never taken from a list.
MAX_BYTES = 10 * 1024 * 1024
MAX_ROWS = 10_000
MAX_IMAGES = 1_000
MAX_SONG_SECONDS = 420
FORBIDDEN_COLUMNS = ("image", "image_page")


def clean_strings(df: DataFrame) -> DataFrame:
    """Clean every string column."""
    return df.withColumns(
        {f.name: T.clean_cell(F.col(f.name)) for f in df.schema if f.dataType.simpleString() == "string"}
    )


def first_errors(
    df: DataFrame, by: Sequence[str], bad: Column, order: Sequence[str], k: int = 5
) -> DataFrame:
    """First ``k`` bad rows per key, each with the number of further bad rows."""
    wrong = df.where(bad)
    totals = wrong.groupBy(*by).agg(F.count("*").alias("n_bad"))
    first = top_rows(wrong, by, [F.col(c) for c in order], k)
    return first.join(totals, list(by)).withColumn(
        "and_more", F.greatest(F.lit(0).cast("bigint"), F.col("n_bad") - k)
    )


def resolve_header(
    cells: DataFrame, key: str, pos: str, name: str, forbidden: Sequence[str] = FORBIDDEN_COLUMNS
) -> DataFrame:
    """First column of each name wins; forbidden names are dropped and reported sorted.

    Where ``name`` holds the names of a whole header as an array, one row for each key,
    they are counted inside the row.
    """
    if isinstance(cells.schema[name].dataType, ArrayType):
        names = F.array_distinct(name)
        dropped = F.array_sort(F.filter(names, lambda n: n.isin(*forbidden)))
        rows = cells.where(F.size(name) > 0).select(key, F.size(name).alias("n"), F.explode(F.array(F.struct(names.alias("names"), dropped.alias("dropped")))).alias("h"))
        return rows.select(
            key,
            (F.size("h.names") - F.size("h.dropped")).cast("bigint").alias("n_kept"),
            (F.col("n") - F.size("h.names")).cast("bigint").alias("n_duplicates"),
            F.array_join("h.dropped", ",").alias("dropped"),
        )
    named = cells.groupBy(key, name).agg(F.min(pos).alias("pos"), F.count("*").alias("copies"))
    is_forbidden = F.col(name).isin(*forbidden)
    return named.groupBy(key).agg(
        F.count_if(~is_forbidden).alias("n_kept"),
        F.sum(F.col("copies") - 1).alias("n_duplicates"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_forbidden, F.col(name)))), ",").alias("dropped"),
    )


def fill_defaults(
    df: DataFrame, by: Sequence[str], order: Sequence[str], slice_by: Column,
    id_: str = "id", original: str = "original", surface: str = "surface", reading: str = "reading",
) -> DataFrame:
    """Rows without surface dropped; id from the output row number, original from surface."""
    rows = df.where(~T.is_missing(F.col(surface)))
    rows = scan(rows, by, order, slice_by, __n=row_number())
    reading_text = F.when(F.upper(F.trim(F.col(reading))) == "NA", "").otherwise(
        F.coalesce(F.col(reading), F.lit(""))
    )
    own_id = F.col(id_).cast("string")
    return rows.withColumns(
        {
            id_: F.when(F.trim(F.coalesce(own_id, F.lit(""))) != "", own_id).otherwise(
                F.col("__n").cast("string")
            ),
            original: F.coalesce(F.when(F.trim(F.col(original)) != "", F.col(original)), F.col(surface)),
            reading: reading_text,
        }
    ).drop("__n")


def volume_limits(
    df: DataFrame, by: Sequence[str], content: Column, is_image: Column,
    max_bytes: int = MAX_BYTES, max_rows: int = MAX_ROWS, max_images: int = MAX_IMAGES,
) -> DataFrame:
    out = df.groupBy(*by).agg(
        F.sum(F.octet_length(content)).cast("bigint").alias("n_bytes"),
        F.count("*").alias("n_rows"),
        F.count_if(is_image).alias("n_images"),
    )
    return out.withColumn(
        "violation",
        F.when(F.col("n_bytes") > max_bytes, "bytes")
        .when(F.col("n_rows") > max_rows, "rows")
        .when(F.col("n_images") > max_images, "images")
        .otherwise(""),
    )


def fingerprint(
    df: DataFrame, by: Sequence[str], order: Sequence[str], slice_by: Column, line: Column, hex_chars: int = 16
) -> DataFrame:
    """First hex digits of SHA-256 over a list: lines hashed per slice, slice hashes hashed in order."""
    position = F.struct(*[F.col(c) for c in order])
    rows = df.select(*by, slice_by.alias("__s"), position.alias("__o"), line.alias("__line"))
    ordered = lambda o, v: F.transform(
        F.array_sort(F.collect_list(F.struct(o.alias("o"), v.alias("v")))), lambda x: x["v"]
    )
    parts = rows.groupBy(*by, "__s").agg(
        F.sha2(F.array_join(ordered(F.col("__o"), F.col("__line")), "\n"), 256).alias("__h"),
        F.count("*").alias("__n"),
    )
    return parts.groupBy(*by).agg(
        F.left(
            F.sha2(F.array_join(ordered(F.col("__s"), F.col("__h")), "\n"), 256), F.lit(hex_chars)
        ).alias("fingerprint"),
        F.sum("__n").alias("n_rows"),
    )


def list_fingerprint(df: DataFrame, by: Sequence[str], order: Sequence[str], line: Column, hex_chars: int = 16) -> DataFrame:
    """First hex digits of SHA-256 over all lines of a list, joined by line feeds in order, and their number.

    The hash of a list is one chain, so a list's sorted lines stream through one task with
    constant state; lists run side by side.
    """
    by = list(by)
    schema = StructType(df.select(*by).schema.fields).add("fingerprint", StringType()).add("n_rows", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n, done = None, None, 0, []
        # Rows of a list come together and in order; a list may go on in the next batch.
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            lines = batch.column("__line").to_pylist()
            low = 0
            for k, group in groupby(keys):
                size = sum(1 for _ in group)
                if k != key:
                    if state:
                        done.append((*key, state.hexdigest()[:hex_chars], n))
                    key, state, n = k, hashlib.sha256(), 0
                text = "\n".join(lines[low : low + size])
                state.update(("\n" + text if n else text).encode())
                low, n = low + size, n + size
        if state:
            done.append((*key, state.hexdigest()[:hex_chars], n))
        if done:
            columns = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in columns], schema.names)

    rows = df.select(*by, *(F.col(c) for c in order if c not in by), F.coalesce(line, F.lit("")).alias("__line"))
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def bind_assets(rows: DataFrame, assets: DataFrame, image: str, original: str) -> DataFrame:
    """Bind rows to uploaded files by explicit name, or by ``original`` equal to the stem.

    ``assets`` has ``name`` and ``stem``. Adds ``asset`` and ``bind_status``:
    bound, none, missing (named but not uploaded) or path (a url or path given).
    """
    named = F.trim(F.coalesce(F.col(image), F.lit("")))
    is_path = named.rlike("[/\\\\]|:")
    by_name = assets.select(F.col("name").alias("__name"), F.col("name").alias("__a1"))
    by_stem = assets.groupBy("stem").agg(F.min("name").alias("__a2"))
    wanted = F.when(named != "", F.regexp_replace(named, r"\.[^.]*$", "")).otherwise(F.col(original))
    joined = (
        rows.withColumn("__want", wanted)
        .withColumn("__named", named)
        .join(by_name, F.col("__named") == F.col("__name"), "left")
        .join(by_stem, F.col("__want") == F.col("stem"), "left")
    )
    found = F.coalesce(F.col("__a1"), F.col("__a2"))
    return joined.select(
        *rows.columns,
        F.when(~is_path, found).alias("asset"),
        F.when(is_path, "path")
        .when(found.isNotNull(), "bound")
        .when(named != "", "missing")
        .otherwise("none")
        .alias("bind_status"),
    )


def dedupe_content(assets: DataFrame, key: str, digest: Column, used: DataFrame) -> DataFrame:
    """Referenced assets with the name their content is stored under (least of equal contents)."""
    hashed = assets.select(key, digest.alias("digest"))
    stored = hashed.groupBy("digest").agg(F.min(key).alias("stored_as"), F.count("*").alias("n_copies"))
    return hashed.join(used.select(key).distinct(), key, "left_semi").join(stored, "digest")


def ambiguous_stems(assets: DataFrame, stem: Column) -> DataFrame:
    return assets.groupBy(stem.alias("stem")).agg(F.count("*").alias("n_files")).where(F.col("n_files") > 1)


def require_editor_columns(df: DataFrame, id_: str, surface: str, defaults: Mapping[str, str]) -> DataFrame:
    """Id and surface are required and never renumbered; missing columns are appended."""
    problem = (
        F.when(T.is_missing(F.col(id_).cast("string")), "no id")
        .when(T.is_missing(F.col(surface)), "no surface")
        .otherwise("")
    )
    added = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns({**added, "problem": problem})


def accept_edits(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edited lines against stored ones.

    ``old``: by, n_words, n_notes, surface. ``new``: by, n_words, moras, surface.
    Rejected: unknown line, other word count, more moras than notes. Otherwise
    the moras padded with long marks to the notes.
    """
    o = old.select(
        *by, F.col("n_words").alias("old_words"), "n_notes", F.col("surface").alias("old_surface"),
        F.lit(True).alias("known"),
    )
    spare = F.col("n_notes") - F.size("moras")
    status = (
        F.when(F.col("known").isNull(), "unknown line")
        .when(F.col("old_words") != F.col("n_words"), "word count")
        .when(spare < 0, "too many moras")
        .otherwise("ok")
    )
    padded = F.concat(F.col("moras"), F.array_repeat(F.lit("ー"), F.greatest(spare, F.lit(0)).cast("int")))
    return (
        new.join(o, list(by), "left")
        .withColumn("status", status)
        .withColumn("note_kana", F.when(F.col("status") == "ok", F.array_join(padded, " ")))
        .withColumn(
            "clears_filler",
            (F.col("status") == "ok") & (F.col("surface") != F.col("old_surface")),
        )
        .select(*by, "status", "note_kana", "clears_filler")
    )


def manifest_failures(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Names of the rules a row breaks, in rule order, comma separated."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("failures", F.array_join(F.array_compact(F.array(*broken)), ","))


def publisher_rules(host: str, path_prefix: str) -> dict[str, Column]:
    tail = F.regexp_extract("url", rf"^https://{host}{path_prefix}([^/?#]+/[^/?#]+)$", 1)
    return {
        "revision": F.col("revision") >= 1,
        "digest": F.col("sha256").rlike("^[0-9a-f]{64}$"),
        "size": F.col("size") >= 0,
        "time": F.col("updated_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"),
        "url": tail != "",
    }


def rollback_guard(active: DataFrame, incoming: DataFrame) -> DataFrame:
    """Verdict per url of the incoming generation; revisions must not go back or change content."""
    a = active.select("url", F.col("revision").alias("active_rev"), F.col("sha256").alias("active_sha"))
    return incoming.join(a, "url", "left").select(
        "url",
        "revision",
        "active_rev",
        F.when(F.col("revision") < F.col("active_rev"), "rollback")
        .when((F.col("revision") == F.col("active_rev")) & (F.col("sha256") != F.col("active_sha")), "changed")
        .otherwise("ok")
        .alias("verdict"),
    )


def layout_mismatch(layouts: DataFrame, rows: DataFrame, list_: str, columns: str, keys: str) -> DataFrame:
    """Columns a layout names that no row of its list has, reported only if none of them matches.

    ``rows`` carries the key array of each row; key sets are combined per list
    by distinct (list, key) pairs.
    """
    known = (
        rows.select(list_, F.explode(keys).alias("k"))
        .distinct()
        .groupBy(list_)
        .agg(F.collect_set("k").alias("known"))
    )
    have = F.coalesce(F.col("known"), F.array().cast("array<string>"))
    none_match = F.size(F.array_intersect(F.col(columns), have)) == 0
    return layouts.join(known, list_, "left").withColumn(
        "missing",
        F.when(none_match, F.array_join(F.array_sort(F.array_except(F.col(columns), have)), ",")).otherwise(""),
    ).drop("known")


def duration_check(songs: DataFrame, notes: DataFrame, song: str, end_seconds: Column, limit: float) -> DataFrame:
    """Songs longer than the limit are rejected; unknown lengths pass."""
    length = notes.groupBy(song).agg(F.max(end_seconds).alias("seconds"))
    return songs.join(length, song, "left").withColumn(
        "accepted", F.coalesce(F.col("seconds") <= limit, F.lit(True))
    )


def singable_flags(df: DataFrame, note_ids: str, kana: str) -> DataFrame:
    """Words without notes are unplaced; words of long marks only are not heard."""
    return df.withColumns(
        {
            "unplaced": F.size(note_ids) == 0,
            "silent": (F.size(kana) > 0) & F.forall(kana, lambda k: k.rlike("^ー+$")),
        }
    )


def lyric_coverage(lines: DataFrame, song: str, matched: Column, has_lyrics: Column) -> DataFrame:
    """Lines, lyric lines and unmatched lines per song; unmatched is 0 when no lyrics are given."""
    out = lines.groupBy(song).agg(
        F.count("*").alias("n_lines"),
        F.count_if(has_lyrics).alias("n_lyric_lines"),
        F.count_if(~matched).alias("__open"),
    )
    return out.withColumn(
        "n_unmatched", F.when(F.col("n_lyric_lines") > 0, F.col("__open")).otherwise(F.lit(0).cast("bigint"))
    ).drop("__open")


def representative_rows(df: DataFrame, by: Sequence[str], has_image: Column, order: Sequence[str]) -> DataFrame:
    """The first row with an image, else the first row."""
    ranked = df.withColumn("__no_image", (~F.coalesce(has_image, F.lit(False))).cast("int"))
    return first_row(ranked, by, ["__no_image", *order]).drop("__no_image")
