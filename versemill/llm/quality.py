"""Quality rules: repetition and length rules, then a hashed n-gram log-likelihood ratio.

Word-and-punctuation unigrams and bigrams are hashed to a fixed number of buckets.
Two smoothed multinomials are counted, one over the texts a trusted label names, one
over the whole corpus. A text's score is the sum of its grams' log ratios divided by
their number. Weights are whole thousandths of a nat, so sums do not depend on order
and equal texts get equal verdicts everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.llm.common import exploded, passing, stored, words_of

BUCKETS = 1 << 16
# A text is dropped if its mean log ratio is below this many thousandths of a nat.
THRESHOLD = -400

GRAM = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def gram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Bucket numbers of all unigrams and bigrams of a text, in order of position."""
    grams = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(GRAM), F.lit(0))
    return F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int"))


def pair_buckets(single: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of neighbouring pairs, from the buckets of the single grams."""

    def pair(i: Column) -> Column:
        return F.pmod(F.xxhash64(F.get(single, i), F.get(single, i + 1)), F.lit(buckets)).cast("int")

    return F.when(F.size(single) > 1, F.transform(F.sequence(F.lit(0), F.size(single) - 2), pair)).otherwise(
        F.array().cast("array<int>")
    )


# Bits a trusted id takes in the filter, bits it sets there, and the most 64-bit words a filter has (sent to every task).
FILTER_BITS, FILTER_HASHES, FILTER_WORDS = 16, 4, 1 << 20
# Ids that pass the filter wrongly are sent to every task up to this number, and joined beyond it.
STRAYS = 1 << 20


def _filter_place(id_: Column, words: int) -> tuple[Column, Column]:
    """The word of an id in the filter, and the bits it sets there."""
    spread = F.xxhash64(id_, F.lit(1))
    bits = (F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(FILTER_HASHES))
    mask = F.lit(0).cast("bigint")
    for bit in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return F.pmod(F.xxhash64(id_), F.lit(words)).cast("int"), mask


def _gram_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, target): grams of all rows (target, text), and of those whose target is 1."""
    singles = rows.select("target", gram_buckets(F.col("text"), buckets).alias("single"))
    both = singles.select("target", F.concat("single", pair_buckets(F.col("single"), buckets)).alias("all"))
    grams = exploded(both, "all", "bucket", "target")
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").cast("bigint").alias("target"))


def trusted_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(bucket, raw, target): grams of all documents and of those whose id is trusted. No text is shuffled.

    A filter of the trusted ids marks documents while all are counted; it lets some others
    through. Those are found on ids alone, counted apart and taken off again, so the result
    is exact. Only where they are too many to be sent to every task are the texts joined.
    """
    ids = trusted.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()
    words = 1
    while words < min(FILTER_WORDS, -(-ids.count() * FILTER_BITS // 64)):
        words *= 2
    word, mask = _filter_place(F.col("id"), words)
    table = ids.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    passes = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)) & F.col("id").isNotNull()
    marked = rows.withColumns({"word": word, "mask": mask}).join(F.broadcast(table), "word", "left")
    marked = marked.select("id", "text", passes.cast("int").alias("target"))
    counts = _gram_counts(marked, buckets)
    strays = stored(marked.where("target = 1").select("id").distinct().join(ids, "id", "left_anti"), "strays")
    n = strays.count()
    if n > STRAYS:
        ones = ids.withColumn("target", F.lit(1))
        return _gram_counts(rows.join(ones, "id", "left").na.fill(0, ["target"]), buckets)
    if n:
        wrong = rows.join(F.broadcast(strays), "id", "left_semi").select(F.lit(1).alias("target"), "text")
        wrong = _gram_counts(wrong, buckets).select("bucket", F.lit(0).alias("raw"), (-F.col("target")).alias("target"))
        counts = counts.unionByName(wrong).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    return counts


def fit_ratio(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    alpha: int = 1,
) -> str:
    """Comma-joined weights of all buckets: log P(bucket | trusted) - log P(bucket | corpus), in thousandths.

    ``trusted`` names documents by id; all of them count. The corpus side counts every
    gram of every document. The result has one number per bucket.
    """
    counts = trusted_counts(docs, trusted, id_col, text_col, buckets)
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    packed = full.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "target", "raw"))).alias("c"),
        (F.sum("target") + alpha * buckets).alias("target_total"),
        (F.sum("raw") + alpha * buckets).alias("raw_total"),
    )
    weight = F.transform(
        "c",
        lambda x: F.round(
            1000
            * (
                F.log((x["target"] + alpha) / F.col("target_total"))
                - F.log((x["raw"] + alpha) / F.col("raw_total"))
            )
        ).cast("int"),
    )
    return packed.select(F.array_join(weight, ",")).first()[0]


def base_counts(text: Column, words: Column) -> dict[str, Column]:
    """Columns of the fixed rules, but for the repeated words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": (
            F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[#*$%&|<>]", ""))
        ).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
    }


def window_hashes(words: Column, width: int = 5) -> Column:
    def window(i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + k) for k in range(width)))

    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), window)).otherwise(
        F.array().cast("array<bigint>")
    )


def with_repeated_words(rows: DataFrame, windows: str, name: str, width: int = 5) -> DataFrame:
    """Replace the window hashes by how many words lie in windows that occur twice or more in the text.

    Texts without a repeat, nearly all, are told by a hash set; the others sort
    (hash, place), so a long text of repeats costs n log n. Each step is a projection of
    its own, so that none is computed twice.
    """
    others = [c for c in rows.columns if c != windows]
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    placed = rows.select(*others, F.when(repeats, pairs).alias("placed"))
    twice = F.filter(
        "placed",
        lambda x, k: (F.get("placed", k - 1)["h"].eqNullSafe(x["h"])) | (F.get("placed", k + 1)["h"].eqNullSafe(x["h"])),
    )
    found = placed.select(*others, twice.alias("twice"))
    places = found.select(*others, F.sort_array(F.transform("twice", lambda x: x["i"])).alias("places"))
    reach = F.transform(
        "places", lambda at, k: F.least(F.coalesce(F.get("places", k + 1) - at, F.lit(width)), F.lit(width))
    )
    covered = F.aggregate(reach, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return places.select(*others, F.coalesce(covered, F.lit(0)).cast("bigint").alias(name))


def assess(
    docs: DataFrame, weights: str, text_col: str = "text", threshold: int = THRESHOLD, buckets: int = BUCKETS
) -> DataFrame:
    """One row per document: ``row`` (all its columns as one struct), the rules' counts and the verdict.

    A text fails the fixed rules with fewer than ten words (null and empty texts have
    none) or if over a fifth of its words lie in repeated five-word windows; otherwise
    it is kept unless its score is below the threshold. ``score`` is in thousandths of
    a nat per gram, zero for a text without grams. Nothing is shuffled. The result may be
    filtered: no filter on the counts or the verdict moves into their expressions.
    """
    first = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    first = first.withColumn("words", words_of(F.col("text")))
    counts = base_counts(F.col("text"), F.col("words"))
    second = first.select(
        "row",
        *(c.alias(n) for n, c in counts.items()),
        window_hashes(F.col("words")).alias("windows"),
        gram_buckets(F.col("text"), buckets).alias("single"),
    )
    third = with_repeated_words(second, "windows", "n_repeat_words").select(
        "row",
        *counts,
        "n_repeat_words",
        F.concat("single", pair_buckets(F.col("single"), buckets)).alias("all"),
    )
    table = F.split(F.lit(weights), ",").cast("array<int>")
    total = F.aggregate("all", F.lit(0).cast("bigint"), lambda s, b: s + F.get(table, b))
    scored = third.select(
        "row", *counts, "n_repeat_words", F.size("all").cast("bigint").alias("n_grams"), total.alias("total")
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = F.struct(
        *counts,
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("total") >= threshold * F.col("n_grams"))).alias("kept"),
        F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams")).otherwise(0.0).alias("score"),
    )
    # A generated row is where pushing of filters ends.
    return scored.select("row", F.explode_outer(F.array(judged)).alias("judged")).select("row", "judged.*")


def keep_good(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    return passing(assess(docs, fit_ratio(docs, trusted), **options), "kept")
