"""Engine tables derived from the generic test tables, in Spark and in SQL.

Times are integers so that both engines agree to the last digit: one
millisecond of song time stands for 100 seconds of event time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.functions.text import LETTERS, MARKED, UNMARKED, letter_words

# 2024-01-01T00:00:00Z in microseconds, event microseconds per song millisecond.
EPOCH_US = 1_704_067_200_000_000
US_PER_MS = 100_000_000
# Slice width of a song timeline, in song milliseconds.
SLICE_MS = 1_000
# Rows per slice for tables ordered by a running number.
SLICE_ROWS = 65_536


# Tables of long texts, whose rows cost far more than their bytes suggest, and their keys.
TEXT_KEYS = {"documents": ("doc_id",), "conversations": ("conv_id", "turn")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table; long texts in fewer files than cores are spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_KEYS and len(df.inputFiles()) < cores:
        df = df.repartition(cores, *TEXT_KEYS[name])
    return df


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Timed notes: one song per user."""
    start = F.expr(f"(unix_micros(cast(ts as timestamp)) - {EPOCH_US}) div {US_PER_MS}")
    length = F.expr("1 + cast(round(value * 100) as bigint) div 10")
    return (
        table(spark, d, "events")
        .select("user_id", "event_id", "ts", "value", "event_type")
        .select(
            F.col("user_id").alias("song_id"),
            F.col("event_id").alias("note_id"),
            start.alias("start_ms"),
            (start + length).alias("end_ms"),
            (F.lit(36) + F.col("event_id") % 61).cast("bigint").alias("pitch"),
            F.col("event_type").alias("channel"),
        )
    )


NOTES = f"""notes AS (SELECT user_id AS song_id, event_id AS note_id,
  (epoch_us(ts) - {EPOCH_US}) // {US_PER_MS} AS start_ms,
  (epoch_us(ts) - {EPOCH_US}) // {US_PER_MS} + 1 + CAST(round(value * 100) AS BIGINT) // 10 AS end_ms,
  CAST(36 + event_id % 61 AS BIGINT) AS pitch, event_type AS channel FROM events)"""


def song_slice(column: str = "start_ms") -> Column:
    return F.floor(F.col(column) / SLICE_MS).cast("bigint")


def row_slice(column: str) -> Column:
    return F.floor(F.col(column) / SLICE_ROWS).cast("bigint")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Lyric lines: one song per conversation, one line per turn."""
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("song_id"),
        F.col("turn").cast("bigint").alias("line_id"),
        F.col("role"),
        F.col("text"),
    )


TURNS = """turns AS (SELECT conv_id AS song_id, CAST(turn AS BIGINT) AS line_id, role, text
  FROM conversations)"""


def wordlist(spark: SparkSession, d: str) -> DataFrame:
    """Word-list rows: ``list`` is the part type, extras the remaining columns."""
    return table(spark, d, "part").select(
        F.col("p_type").alias("list"),
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("original"),
        F.col("p_name").alias("surface"),
        F.col("p_size").cast("bigint").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


WORDLIST = """wordlist AS (SELECT p_type AS list, p_partkey AS id, p_brand AS original,
  p_name AS surface, CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part)"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs: an order is a job, the customer its owner, days are hours of service time."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("owner"),
        F.col("o_orderstatus").alias("status"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
        .cast("bigint")
        .alias("created_h"),
        F.col("o_orderpriority").alias("priority"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )


JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS owner, o_orderstatus AS status,
  CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS created_h,
  o_orderpriority AS priority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""


def words(spark: SparkSession, d: str) -> DataFrame:
    """Parody words on notes: an order is a line, its items are words in it."""
    item = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("line_id"),
        F.col("l_linenumber").cast("bigint").alias("pos"),
        F.col("l_partkey").alias("word_id"),
        F.col("l_suppkey").alias("singer_id"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.round(F.col("l_quantity")).cast("bigint").alias("qty"),
        F.col("l_returnflag").alias("flag"),
    )
    return item


WORDS = """words AS (SELECT l_orderkey AS line_id, CAST(l_linenumber AS BIGINT) AS pos,
  l_partkey AS word_id, l_suppkey AS singer_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  CAST(round(l_quantity) AS BIGINT) AS qty, l_returnflag AS flag FROM lineitem)"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, texts): the texts of each document id, nearly always one, in one row.

    What is made of a whole text is made inside such a row, so that texts are shuffled
    once and their words, many times larger as rows, never are.
    """
    return table(spark, d, "documents").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))


def assets(spark: SparkSession, d: str, generation: int) -> DataFrame:
    """Asset generations: pages not divisible by 5, then pages not divisible by 7."""
    gap = {1: 5, 2: 7}[generation]
    changed = F.when(F.lit(generation == 2) & (F.col("page_id") % 3 == 0), F.lit("v2")).otherwise("")
    return (
        table(spark, d, "pages")
        .where(F.col("page_id") % gap != 0)
        .select(
            "url",
            F.col("page_id"),
            F.sha2(F.concat(F.col("html"), changed), 256).alias("sha256"),
            (F.lit(1) + F.when(F.lit(generation == 2) & (F.col("page_id") % 3 == 0), 1).otherwise(0))
            .cast("bigint")
            .alias("revision"),
            F.length("html").cast("bigint").alias("size"),
        )
    )


ASSETS1 = """assets1 AS (SELECT url, page_id, sha256(html) AS sha256, CAST(1 AS BIGINT) AS revision,
  CAST(length(html) AS BIGINT) AS size FROM pages WHERE page_id % 5 <> 0)"""
ASSETS2 = """assets2 AS (SELECT url, page_id,
  sha256(html || CASE WHEN page_id % 3 = 0 THEN 'v2' ELSE '' END) AS sha256,
  CAST(1 + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS revision,
  CAST(length(html) AS BIGINT) AS size FROM pages WHERE page_id % 7 <> 0)"""


def words_sql(text: str) -> str:
    """SQL list of the words that ``letter_words`` finds."""
    return f"regexp_extract_all(translate(lower({text}), '{MARKED}', '{UNMARKED}'), '{LETTERS}')"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# Fixed spelling table of the test data: one kana per Latin letter, small kana and marks included.
LATIN = "abcdefghijklmnopqrstuvwxyz"
LATIN_KANA = "アバシダエァガーイジカラマンオパッリストウゥョィャェ"


def kana_words(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of all documents, without marks, with a kana spelling."""
    word = F.explode(letter_words(F.col("text")))
    return (
        table(spark, d, "documents")
        .select(word.alias("word"))
        .distinct()
        .withColumn("kana", F.translate("word", LATIN, LATIN_KANA))
    )


KANA_WORDS = f"""kw AS (SELECT word, translate(word, '{LATIN}', '{LATIN_KANA}') AS kana FROM (
  SELECT DISTINCT unnest({words_sql("text")}) AS word FROM documents))"""
