"""Fill-in-middle rows: texts cut in three, with the middle moved to the end.

Cuts are drawn in code points (or bytes), texts are stored as bytes. Per text only the
exceptions are recorded: where characters of several bytes stand and how many bytes more
than one they take. A binary search among them converts a cut either way; everywhere
else a byte is a character and conversion is addition. Python returns a few numbers a
row; the pieces are cut and joined as Spark columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Of 100 texts these stay plain; of 100 others these put the suffix first.
PLAIN = 10
SUFFIX_FIRST = 20
# Texts are indexed together up to so many bytes; a longer text alone.
GROUP_BYTES = 1 << 22

CUTS = "struct<n:bigint,first:bigint,second:bigint,first_byte:bigint,second_byte:bigint>"


class ExceptionIndex:
    """Where UTF-8 bytes depart from one byte a code point."""

    def __init__(self, data: np.ndarray) -> None:
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(more)])
        self.points = self.at - self.before[:-1]

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """Byte offsets of code point offsets."""
        return points + self.before[np.searchsorted(self.points, points)]

    def to_points(self, offsets: np.ndarray) -> np.ndarray:
        """Code point offsets of byte offsets; one within a character counts as that character's start."""
        seen = np.searchsorted(self.at, offsets)
        points = offsets - self.before[seen]
        if not len(self.at):
            return points
        return np.where(seen > 0, np.maximum(points, self.points[np.maximum(seen - 1, 0)]), points)


def _cuts(text: pa.Array, one: np.ndarray, two: np.ndarray, unit: str) -> pa.Array:
    """The two cuts of every text, as code points and as bytes, and its number of code points."""
    empty = np.zeros(0, dtype=np.uint8)
    wide = text.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(wide.buffers()[1], dtype=np.int64, count=len(wide) + wide.offset + 1)[wide.offset :]
    data = np.frombuffer(wide.buffers()[2], dtype=np.uint8) if wide.buffers()[2] is not None else empty
    out = np.zeros((5, len(wide)), dtype=np.int64)
    low = 0
    while low < len(wide):
        # Rows up to the group's bytes, but one at least.
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + GROUP_BYTES, "right")) - 1)
        index = ExceptionIndex(data[ends[low] : ends[high]])
        start, end = ends[low:high] - ends[low], ends[low + 1 : high + 1] - ends[low]
        zero, last = index.to_points(start), index.to_points(end)
        if unit == "bytes":
            drawn = [index.to_points(start + h[low:high] % (end - start + 1)) for h in (one, two)]
        else:
            drawn = [zero + h[low:high] % (last - zero + 1) for h in (one, two)]
        cuts = np.minimum(*drawn), np.maximum(*drawn)
        out[:, low:high] = last - zero, *(c - zero for c in cuts), *(index.to_bytes(c) - start for c in cuts)
        low = high
    names = ["n", "first", "second", "first_byte", "second_byte"]
    return pa.StructArray.from_arrays([pa.array(c) for c in out], names)


def cuts(text: Column, one: Column, two: Column, unit: str = "points") -> Column:
    """Struct of ``n``, the smaller and the larger cut in code points, and both in bytes, from two drawn numbers."""
    if unit not in ("points", "bytes"):
        raise ValueError("unit is points or bytes")

    @F.arrow_udf(CUTS)
    def run(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        return _cuts(text, one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False), unit)

    return run(text, one, two)


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of a key: the first groups of eight hex digits of its SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def arrange(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "points",
    seed: int = 1,
    plain: int = PLAIN,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """One row per input row: ``row`` (all its columns as one struct), n, form, prefix_chars, middle_chars, output.

    ``n`` counts code points. ``form`` is plain, psm or spm. Null texts are empty; empty
    texts and texts that hold a mark stay plain, with null counts. The cuts depend on the
    id and the text only, so equal rows get equal results; a null id counts as an empty
    one. ``unit`` bytes draws the cuts in bytes and moves each to the start of its
    character. Texts may be of any length: nothing is shuffled, and a task indexes about
    4 MB or one text at a time. Texts are valid UTF-8, as Spark's own functions take them.
    """
    one, two, three, four = draws(F.col(id_col), seed)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), text.alias("body"), one.alias("h1"), two.alias("h2"), three.alias("h3"), four.alias("h4"))
    rows = rows.withColumn("cut", cuts(F.col("body"), F.col("h1"), F.col("h2"), unit))
    body = F.col("body")
    marked = body.contains(PREFIX) | body.contains(SUFFIX) | body.contains(MIDDLE)
    form = (
        F.when((body == "") | marked | (F.col("h3") % 100 >= 100 - plain), "plain")
        .when(F.col("h4") % 100 < suffix_first, "spm")
        .otherwise("psm")
    )
    rows = rows.select("row", "body", "cut", form.alias("form"))
    raw, cut = body.cast("binary"), F.col("cut")
    first, second = cut["first_byte"].cast("int"), cut["second_byte"].cast("int")
    prefix = F.substring(raw, F.lit(1), first).cast("string")
    middle = F.substring(raw, first + 1, second - first).cast("string")
    suffix = F.substring(raw, second + 1, F.octet_length(raw)).cast("string")
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(body)
    )
    moved = F.col("form") != "plain"
    return rows.select(
        "row",
        cut["n"].alias("n"),
        "form",
        F.when(moved, cut["first"]).alias("prefix_chars"),
        F.when(moved, cut["second"] - cut["first"]).alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``arrange`` started from. A text that holds a mark is never moved, so each mark stands once."""
    prefix_first = F.substring_index(output, SUFFIX, 1), F.substring_index(output, SUFFIX, -1)
    psm = F.concat(
        F.substring_index(prefix_first[0], PREFIX, -1),
        F.substring_index(prefix_first[1], MIDDLE, -1),
        F.substring_index(prefix_first[1], MIDDLE, 1),
    )
    suffix_first = F.substring_index(output, PREFIX, 1), F.substring_index(output, PREFIX, -1)
    spm = F.concat(
        F.substring_index(suffix_first[1], MIDDLE, 1),
        F.substring_index(suffix_first[1], MIDDLE, -1),
        F.substring_index(suffix_first[0], SUFFIX, -1),
    )
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
