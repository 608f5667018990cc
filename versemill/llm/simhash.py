"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text becomes a 64-bit fingerprint of its three-word shingles. Each bit
position carries a nonzero code of ``radius + 1`` bits; the table of a nonzero
vector ``v`` keeps the bits whose code has odd inner product with ``v``. The codes
of at most ``radius`` differing bits never span the whole space, so some table
masks all of them out: every pair within the radius meets in a table for certain.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.llm.common import components, stored, words_of

BITS = 64
# Shingle hashes unpacked to bits at a time.
CHUNK = 1 << 18


def masks(radius: int) -> list[int]:
    """The covering bit masks, as signed 64-bit integers."""
    size = 2 ** (radius + 1) - 1
    codes = [1 + i % size for i in range(BITS)]
    unsigned = [sum(1 << i for i in range(BITS) if (codes[i] & v).bit_count() % 2) for v in range(1, size + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in unsigned]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; texts of one byte per character take the faster function."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def shingle_hashes(words: Column, n_words: Column, size: int) -> Column:
    """XXH64 of every shingle; the whole sequence if it is shorter, nothing without a word."""

    def shingle(i: Column) -> Column:
        return F.xxhash64(F.concat_ws(" ", *(F.get(words, i + k) for k in range(size))))

    full = F.transform(F.sequence(F.lit(0), n_words - size), shingle)
    short = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(n_words >= size, full).when(n_words > 0, short).otherwise(F.array().cast("array<bigint>"))


def majority(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each list of signed hashes, given end to end with offsets: bits that over half of it have."""
    ones = np.zeros((len(offsets) - 1, BITS), dtype=np.int64)
    for start in range(int(offsets[0]), int(offsets[-1]), CHUNK):
        part = values[start : min(start + CHUNK, int(offsets[-1]))]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS)
        first = np.searchsorted(offsets, start, side="right") - 1
        last = np.searchsorted(offsets, start + len(part), side="left")
        edges = np.clip(offsets[first:last] - start, 0, None)
        rows = np.flatnonzero(np.diff(np.append(edges, len(part))))
        ones[first + rows] += np.add.reduceat(bits, edges[rows], axis=0, dtype=np.int64)
    set_ = (2 * ones > np.diff(offsets)[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view("<i8").ravel()


def _majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("hashes")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).astype("<i8", copy=False)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(majority(values, offsets), pa.int64())],
            ["doc_id", "text_key", "print"],
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, print): the fingerprint of every row as a signed 64-bit integer, and its text's hash.

    A bit is set if more than half of the shingle hashes have it. Texts without a
    word, null and empty ones included, have fingerprint zero.
    """
    words = words_of(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))))
    split = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), words.alias("words")
    )
    counted = split.select("doc_id", "text_key", "words", F.size("words").alias("n"))
    hashes = shingle_hashes(F.col("words"), F.col("n"), shingle)
    hashed = counted.select("doc_id", "text_key", hashes.alias("hashes"))
    return hashed.mapInArrow(_majority, "doc_id bigint, text_key bigint, print bigint")


def _flips(value: Column, radius: int) -> Column:
    """Keys that two values share exactly if they differ in at most ``radius`` bits (1 or 2).

    Two values at most two bits apart meet in a value at most one bit from both; two
    values that share such a midpoint are at most two bits apart. For radius 1 the key
    is the value with one bit cleared, together with that bit's number.
    """
    ones = [1 << i if i < BITS - 1 else -(1 << i) for i in range(BITS)]
    if radius == 1:
        return F.array(
            *(F.struct(F.lit(i).alias("bit"), value.bitwiseAND(~m).alias("key")) for i, m in enumerate(ones))
        )
    keys = [value] + [value.bitwiseXOR(F.lit(m).cast("bigint")) for m in ones]
    return F.array(*(F.struct(F.lit(0).alias("bit"), k.alias("key")) for k in keys))


def links(prints: DataFrame, radius: int = 2, bucket: int = 32) -> DataFrame:
    """(a, b): links between the distinct values of ``prints``, enough to connect all within ``radius``.

    Buckets of the covering tables with up to ``bucket`` values compare their pairs.
    Values of larger buckets are linked through shared midpoints instead, one row per
    value and midpoint, so a bucket of any size costs in proportion to its values and
    no link is lost.
    """
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    tables = [
        F.struct(F.lit(t).alias("table"), F.col("print").bitwiseAND(F.lit(m).cast("bigint")).alias("key"))
        for t, m in enumerate(masks(radius))
    ]
    keyed = prints.select("print", F.explode(F.array(*tables)).alias("k")).select("print", "k.table", "k.key")
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keyed.join(sizes, ["table", "key"]), "buckets")
    small = met.where(F.col("n") <= bucket).groupBy("table", "key").agg(F.array_sort(F.collect_list("print")).alias("p"))
    near = F.flatten(
        F.transform(
            "p",
            lambda x, i: F.transform(
                F.filter(
                    F.slice("p", i + 2, F.size("p")),
                    lambda y: F.bit_count(x.bitwiseXOR(y)) <= radius,
                ),
                lambda y: F.struct(x.alias("a"), y.alias("b")),
            ),
        )
    )
    pairs = small.select(F.explode(near).alias("e")).select("e.a", "e.b")
    large = met.where(F.col("n") > bucket).select("print").distinct()
    spread = large.select("print", F.explode(_flips(F.col("print"), radius)).alias("k"))
    centre = spread.groupBy("k").agg(F.min("print").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = spread.join(centre, "k").where("print <> a").select("a", F.col("print").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """(doc_id, text_key, print, root, component_id): one row per input row.

    ``component_id`` is the smallest id that chains of links within the radius reach,
    ``root`` the fingerprint that stands for the component. Rows with equal fingerprints
    are one node, so copies cost nothing beyond their own row. Repeated ids keep their
    rows; a null id keeps its row and lends no id (a component of null ids only has a
    null one); no rows give no rows.
    """
    each = stored(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = stored(each.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("print"), radius), "a", "b").withColumnRenamed("node", "print")
    rooted = nodes.join(roots, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(firsts, "root").select("print", "root", "component_id")
    return each.join(named, "print").select("doc_id", "text_key", "print", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each near-duplicate component, all columns unchanged.

    The row with the smallest id stays (null ids come last), of rows with that id the
    one with the smallest text hash, of rows equal in both any one.
    """
    return one_of_each(docs, near_duplicates(docs, id_col, text_col, **options), id_col, text_col)


def one_of_each(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stand for the components (column ``root``) of ``labelled``."""
    labelled = stored(labelled, "labelled")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = labelled.groupBy("root").agg(F.min(order).alias("m")).select("m.doc_id", "m.text_key")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(text_col).alias("text_key"),
    )
    same = rows["doc_id"].eqNullSafe(first["doc_id"]) & (rows["text_key"] == first["text_key"])
    kept = rows.join(first, same, "left_semi")
    again = labelled.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text_key"])
    return kept.select("row.*")


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
