"""Nested documents: project, editor, settings, manifest and catalogue; and their sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.functions import text as T
from versemill.plans.ordered import first_row, row_number, running_sum, scan

SCHEMA_VERSION = 1
PROJECT_SCHEMA = """version INT, song_id BIGINT, part BIGINT,
  lines ARRAY<STRUCT<line_id: BIGINT, role: STRING, text: STRING>>"""
EDITOR_SCHEMA = """song_id BIGINT, part BIGINT, n_lines BIGINT, wordlist STRING,
  results ARRAY<STRUCT<line_id: BIGINT, words: ARRAY<STRUCT<surface: STRING>>>>"""


def ordered_array(order: Sequence[str], *fields: Column) -> Column:
    """Array of structs in ``order`` (aggregate)."""
    row = F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v"))
    return F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"])


def nest_lines(lines: DataFrame, song: str, line: str, *fields: Column, part_lines: int | None = None) -> DataFrame:
    """One document per song, the lines in order; with ``part_lines`` one per song and block of so many line numbers."""
    part = F.floor(F.col(line) / part_lines) if part_lines else F.lit(0)
    return (
        lines.withColumn("part", part.cast("bigint"))
        .groupBy(song, "part")
        .agg(ordered_array([line], *fields).alias("lines"))
    )


def write_documents(docs: DataFrame, path: str, song: str = "song_id") -> None:
    """JSON documents, one file group per hash of the song."""
    docs.repartition(song).write.mode("overwrite").json(path)


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(doc): all JSON documents below a folder as variants, whatever their fields."""
    return spark.read.option("recursiveFileLookup", True).option("singleVariantColumn", "doc").json(path)


def field(name: str, kind: str) -> Column:
    """A field of a variant document, null where it is missing or of another kind."""
    return F.try_variant_get("doc", f"$.{name}", kind)


def read_projects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Supported documents and the quarantined ones of another version, which may have other fields."""
    lines = "array<struct<line_id: bigint, role: string, text: string>>"
    docs = read_variants(spark, path).select(
        field("version", "int").alias("version"), field("song_id", "bigint").alias("song_id"), field("part", "bigint").alias("part"),
        F.coalesce(field("lines", lines), F.array().cast(lines)).alias("lines"),
    )
    return split_versions(docs)


def read_editors(spark: SparkSession, path: str) -> DataFrame:
    """Editor documents; results lie in ``results`` or, in older ones, in ``lines``."""
    results = "array<struct<line_id: bigint, words: array<struct<surface: string>>>>"
    return read_variants(spark, path).select(
        field("song_id", "bigint").alias("song_id"), field("n_lines", "bigint").alias("n_lines"),
        F.coalesce(field("results", results), field("lines", results)).alias("results"),
    )


def read_manifests(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """Manifest documents: ``assets`` maps urls to entries of the given struct type."""
    return read_variants(spark, path).select(field("assets", f"map<string, {entry}>").alias("assets"))


def split_versions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col("version") == SCHEMA_VERSION, F.lit(False))
    return docs.where(ok), docs.where(~ok)


def project_lines(docs: DataFrame) -> DataFrame:
    return docs.select("song_id", F.posexplode("lines").alias("pos", "line")).select("song_id", "line.*")


def editor_words(docs: DataFrame) -> DataFrame:
    """Words of editor documents whose result count agrees with their line count."""
    ok = docs.where(F.size("results") == F.col("n_lines"))
    lines = ok.select("song_id", F.explode("results").alias("r"))
    return lines.select(
        "song_id", "r.line_id", F.posexplode("r.words").alias("word_no", "word")
    ).select("song_id", "line_id", F.col("word_no").cast("bigint").alias("word_no"), "word.surface")


def flatten_groups(nodes: DataFrame) -> DataFrame:
    """Leaves of a settings tree with their path of labels, however deep.

    ``nodes``: id, parent (null at the root), label. One join per level until no
    leaf has a parent left; the levels are the depth of the settings, not of the
    data. Nodes that are their own ancestors are an error.
    """
    parents = nodes.select(F.col("parent").alias("id")).where(F.col("id").isNotNull()).distinct()
    leaves = nodes.join(parents, "id", "left_anti").select(
        F.col("id").alias("leaf"), F.col("parent").alias("up"), F.col("label").alias("path")
    )
    above = nodes.select(F.col("id").alias("up"), F.col("parent").alias("__next"), F.col("label").alias("__label"))
    most = None
    while True:
        open_ = leaves.where("up is not null").count()
        if not open_:
            break
        most = nodes.count() if most is None else most - 1
        if most == 0:
            raise ValueError("a node is its own ancestor")
        leaves = leaves.join(above, "up", "left").select(
            "leaf",
            F.col("__next").alias("up"),
            F.concat_ws("/", F.col("__label"), F.col("path")).alias("path"),
        )
    return leaves.select("leaf", "path")


def manifest_entries(manifests: DataFrame, assets: str = "assets") -> DataFrame:
    """Active entries of manifest documents (url to entry); orphaned entries are left out."""
    entries = manifests.select(F.explode(assets).alias("url", "entry"))
    return entries.where(F.col("entry.orphaned_at").isNull()).select("url", "entry.*")


def tidy_lines(rows: DataFrame, base: Sequence[str]) -> DataFrame:
    """CSV lines with the base columns first; commas and line ends in values replaced."""
    columns = [*base, *[c for c in rows.columns if c not in base]]
    cells = [T.clean_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return rows.select("*", F.concat_ws(",", *cells).alias("line"))


def srt_blocks(df: DataFrame, by, order, slice_by, start: str, end: str, text: str) -> DataFrame:
    """Numbered subtitle blocks per song."""
    s = scan(df, by, order, slice_by, number=row_number())
    block = F.concat(
        F.col("number").cast("string"), F.lit("\n"), T.srt_time(F.col(start)), F.lit(" --> "),
        T.srt_time(F.col(end)), F.lit("\n"), F.col(text), F.lit("\n"),
    )
    return s.withColumn("block", block)


def credit_rows(uses: DataFrame, url: str, order: Sequence[str], word: str, credit: str, page: str) -> DataFrame:
    """First use of each image as a report line."""
    first = first_row(uses.select(url, *dict.fromkeys([*order, word, credit, page])), [url], order)
    return first.withColumn("line", F.concat_ws("\t", word, url, credit, page))


def status_gauge(jobs: DataFrame, statuses: DataFrame, metric: str) -> DataFrame:
    """One line per known status, zero counts included."""
    counts = jobs.groupBy("status").agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    return statuses.join(counts, "status", "left").select(
        "status", n.alias("n"), F.format_string(metric + '{status="%s"} %d', "status", n).alias("line")
    )


def reference_intervals(notes: DataFrame, song: str, channel: str, start: str, end: str, pitch: str) -> DataFrame:
    """Notes of the channel with most notes (least channel on a tie)."""
    counts = notes.groupBy(song, channel).agg(F.count("*").alias("n"))
    best = counts.groupBy(song).agg(F.min_by(F.col(channel), F.struct(-F.col("n"), F.col(channel))).alias(channel))
    return notes.join(best, [song, channel]).select(song, start, end, pitch)


def catalogue_entries(catalogue: DataFrame, performer: str, styles: str, kinds: Sequence[str]) -> DataFrame:
    """Styles of the wanted kinds, earlier kinds first, then in listed order."""
    flat = catalogue.select(performer, F.posexplode(styles).alias("pos", "style")).select(performer, "pos", "style.*")
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    return flat.where(F.col("kind").isin(*kinds)).withColumn("kind_rank", rank)


def write_lines(df: DataFrame, column: str, path: str, *partition: str, order: Sequence[str] = (), within: Sequence[str] = ()) -> None:
    """One text line per row, one folder per partition value, lines in ``order`` within it.

    Rows are sorted by folder first, so a task keeps one file open; the commit shows all
    files at once. Rows equal in ``within`` follow each other in one file, which others share.
    """
    keys = [*partition, *within]
    rows = df.select(*dict.fromkeys([*keys, *order]), F.col(column).alias("value"))
    if keys:
        rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    rows.select(*partition, "value").write.mode("overwrite").partitionBy(*partition).text(path)


def put_key(df: DataFrame, text: str, key: str) -> DataFrame:
    """Every line of ``text`` behind its key and a tab, so that the lines of many keys can share a file."""
    name = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\t"))
    # After each line break that a reader knows, and in front.
    return df.withColumn(text, F.concat(name, F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(r"(?<=\n)|(?<=\r)(?!\n)"), name)))


def take_key(lines: DataFrame) -> DataFrame:
    """Lines (file, block, row, text) that ``put_key`` wrote: the key takes the place of the file."""
    key = F.substring_index("text", "\t", 1)
    return lines.select(key.alias("file"), "block", "row", F.expr("substring(text, instr(text, '\t') + 1)").alias("text"))


def read_blocks(lines: DataFrame) -> DataFrame:
    """(file, number, block): runs of lines (file, block, row, text) between empty lines, in order."""
    order = ["block", "row"]
    ends = (F.col("text") == "").cast("bigint")
    counted = scan(lines.withColumn("ends", ends), ["file"], order, F.col("block"), before=running_sum("ends", inclusive=False))
    inside = counted.where("text <> ''").groupBy("file", F.coalesce("before", F.lit(0)).alias("number"))
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "text")))
    return inside.agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("block"))
