"""Word-list sources: tidy CSV folders, plain lists, headers and character sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.plans.ordered import materialize, row_number, running_sum, scan

BASE_COLUMNS = ("id", "original", "surface", "pronunciation")
# Other spellings of the base columns.
COLUMN_ALIASES = {
    "id": ("id", "no"),
    "original": ("original", "正式名称", "原語"),
    "surface": ("surface", "word", "text", "単語", "表記", "見出し"),
    "pronunciation": (
        "pronunciation", "kana", "yomi", "reading", "読み", "よみ", "読み方", "カナ", "かな", "ふりがな",
    ),
}
_BY_ALIAS = {alias: name for name, aliases in COLUMN_ALIASES.items() for alias in aliases}


def canonical_name(cell: Column) -> Column:
    """Header cell without byte-order mark and space, lower case, alias resolved."""
    key = F.lower(F.trim(F.replace(cell, F.lit("﻿"), F.lit(""))))
    pairs = [F.lit(x) for kv in _BY_ALIAS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], key)


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename the columns of a read list; the first column of a name wins."""
    seen, keep = set(), []
    for c in df.columns:
        name = c.replace("﻿", "").strip().lower()
        name = _BY_ALIAS.get(name, name)
        if name not in seen:
            seen.add(name)
            keep.append(F.col(f"`{c}`").alias(name))
    return df.select(*keep)


def is_header(cells: Column) -> Column:
    """A row is a header if any of its cells names a base column."""
    return F.exists(cells, lambda c: canonical_name(c).isin(*BASE_COLUMNS))


def fold_extras(df: DataFrame, base: Sequence[str], name: str = "extras") -> DataFrame:
    """Columns beyond ``base`` folded into one map of strings."""
    extra = [c for c in df.columns if c not in base]
    values = F.map_from_arrays(
        F.array(*[F.lit(c) for c in extra]), F.array(*[F.col(c).cast("string") for c in extra])
    ) if extra else F.create_map().cast("map<string,string>")
    return df.select(*[c for c in base if c in df.columns], values.alias(name))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block, row, text): the lines of all files below a folder, in order of (block, row) within a file.

    Large files are read in blocks by several tasks, by whatever store Spark reads.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return lines.select(*place, F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"))


def list_name(file: Column) -> Column:
    """The name of a list: that of its ``list=`` folder, else its file's name without extension."""
    folder = F.regexp_extract(file, "/list=([^/]*)/[^/]*$", 1)
    stem = F.regexp_extract(file, r"([^/]*?)(?:\.[^./]*)?$", 1)
    # A folder's name was escaped by its writer, and the path once more.
    return F.when(folder != "", F.try_url_decode(F.try_url_decode(folder))).otherwise(F.try_url_decode(stem))


def csv_records(lines: DataFrame) -> DataFrame:
    """(file, record, text): lines joined where a quoted cell spans several; a record starts outside quotes.

    Whether a line starts inside quotes follows from the number of quotes before it in its
    file, a running sum over blocks.
    """
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    order = ["block", "row"]
    counted = scan(lines.withColumn("quotes", quotes), ["file"], order, F.col("block"), before=running_sum("quotes", inclusive=False))
    starts = (F.coalesce("before", F.lit(0)) % 2 == 0).cast("bigint")
    # The two scans read lines whose row numbers come from the reader, so they are written between.
    numbered = scan(counted.withColumn("starts", starts), ["file"], order, F.col("block"), cut=True, record=running_sum("starts"))
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "text")))
    joined = numbered.groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    return joined.where(F.trim("text") != "")


def scan_wordlists(spark: SparkSession, folder: str) -> DataFrame:
    """Tidy CSV files below a folder, each with its own header: list, base columns, extras map.

    Files may differ in columns and their order. The first column of a name wins; cells
    beyond the header are left out and missing ones are null. Empty cells are null. A
    file without data rows gives none.
    """
    records = materialize(csv_records(materialize(read_lines(spark, folder))))
    heads = records.groupBy("file").agg(F.min("record").alias("first"))
    heads = records.join(heads, "file").where(F.col("record") == F.col("first")).select("file", "first", F.col("text").alias("head"))
    commas = F.length("head") - F.length(F.replace("head", F.lit(","), F.lit("")))
    width = heads.agg(F.max(commas)).first()[0]
    schema = ", ".join(f"c{i} STRING" for i in range((width or 0) + 1))

    def cells(text: str) -> Column:
        row = F.from_csv(F.col(text), schema, {"escape": '"'})
        return F.array(*(row[f"c{i}"] for i in range((width or 0) + 1)))

    names = F.filter(F.transform(cells("head"), canonical_name), lambda c: c.isNotNull())
    heads = heads.select("file", "first", names.alias("names"))
    rows = records.join(heads, "file").where(F.col("record") > F.col("first"))
    rows = rows.select("file", "names", F.slice(cells("text"), F.lit(1), F.size("names")).alias("cells"))
    # Of equal names the first is put last, where it wins.
    cell = F.map_from_arrays(F.reverse("names"), F.reverse("cells"))
    rows = rows.select(list_name(F.col("file")).alias("list"), cell.alias("cell"))
    extras = F.map_filter("cell", lambda k, _: ~k.isin(*BASE_COLUMNS))
    return rows.select("list", *(F.try_element_at("cell", F.lit(c)).alias(c) for c in BASE_COLUMNS), extras.alias("extras"))


def write_wordlists(rows: DataFrame, folder: str, list_: str = "list") -> None:
    """Tidy CSV files with a header below ``folder``, one ``list=`` folder for each list.

    Rows are sorted by list, so a task keeps one file open; the commit shows all files at once.
    """
    named = rows.withColumnRenamed(list_, "list").repartition("list").sortWithinPartitions("list")
    named.write.partitionBy("list").option("header", True).option("escape", '"').csv(folder)


def ids_with_surfaces(rows: DataFrame) -> DataFrame:
    """How many surfaces share an id of a list."""
    return rows.groupBy("list", "id").agg(
        F.countDistinct("surface").alias("n_surfaces"), F.count("*").alias("n_rows")
    )


def parse_plain(lines: DataFrame, list_: str, line_no: str, text: str, slice_rows: int = 4096) -> DataFrame:
    """``surface,reading1,reading2 # comment`` lines: one row per reading, sharing an id.

    The id counts the non-empty lines of the list; a line without a reading
    gives one row with an empty reading.
    """
    cells = F.transform(F.split(F.regexp_replace(text, "#.*$", ""), ","), lambda c: F.trim(c))
    kept = (
        lines.select(list_, line_no, cells.alias("__cells"))
        .withColumn("surface", F.element_at("__cells", 1))
        .where(F.col("surface") != "")
    )
    numbered = scan(kept, [list_], [line_no], F.floor(F.col(line_no) / slice_rows), id=row_number())
    readings = F.filter(F.slice("__cells", F.lit(2), F.size("__cells")), lambda r: r != "")
    return numbered.select(
        list_,
        "id",
        "surface",
        F.posexplode(F.when(F.size(readings) > 0, readings).otherwise(F.array(F.lit("")))).alias("variant", "reading"),
    )


def scan_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Plain list files below a folder, read line by line in any number of tasks."""
    lines = materialize(read_lines(spark, folder))
    numbered = scan(lines, ["file"], ["block", "row"], F.col("block"), line_no=row_number())
    return parse_plain(materialize(numbered.select(list_name(F.col("file")).alias("list"), "line_no", "text")), "list", "line_no", "text")


def write_plain(lines: DataFrame, folder: str, list_: str, order: Sequence[str], text: str) -> None:
    """One text file for each list, its lines in order; line ends within a line become blanks."""
    flat = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\r\n]+", " ").alias("value")
    rows = lines.select(F.col(list_).alias("list"), *order, flat).repartition("list").sortWithinPartitions("list", *order)
    rows.select("list", "value").write.partitionBy("list").text(folder)


def decode_content(spark: SparkSession, files: DataFrame, content: str = "content") -> DataFrame:
    """UTF-8 (byte-order mark dropped), else Shift_JIS; adds ``charset`` and ``text``.

    Content neither charset can read is marked ``unknown`` with a null text.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    as_text = F.col(content).cast("string")
    utf8 = F.is_valid_utf8(as_text)
    sjis = F.decode(F.col(content), "Shift_JIS")
    broken = sjis.contains("�")
    text = F.when(utf8, F.regexp_replace(as_text, "^﻿", "")).when(~broken, sjis)
    charset = F.when(utf8, "utf-8").when(~broken, "shift_jis").otherwise("unknown")
    return files.withColumns({"charset": charset, "text": text})


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Uploaded files with decoded text."""
    return decode_content(spark, spark.read.format("binaryFile").load(folder).select("path", "content"))
