"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where a minimiser is: a place whose hash of eight words is the
least of its neighbourhood. A choice by content marks the same places in every copy of a
passage, so any passage of the least length holds a kept suffix near its start. Kept
suffixes that begin alike are put in order of what stands before them, neighbours are
compared, and matches are extended word by word to the left and right on the texts. Where
more than two suffixes begin alike, comparing neighbours may leave some pairs out: every
stretch of the least length around such a suffix that no match covers is looked up by its
hash among all stretches, so no repeated stretch is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versemill.llm.common import stored

# Fixed value: a word is a run of characters other than ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))

LEAST_WORDS = 50
# Words of a hashed gram, and neighbouring grams of which the least is kept.
GRAM = 8
REACH = 20
# Words before a suffix that order suffixes which begin alike.
LEFT = (4, 8, 12, 16)
# Suffixes with one beginning that are ordered together on average; more are split.
TOGETHER = 1_000
CHUNK = 1 << 22
FACTOR = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int, factor: int) -> np.ndarray:
    """factor ** 0 .. factor ** (n - 1) modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        out = np.ones(n, dtype=np.uint64)
        out[1:] = np.uint64(factor & MASK)
        return np.multiply.accumulate(out)


class Sums:
    """Hashes of any stretch of a sequence, from prefix sums of its items times powers of an odd factor."""

    def __init__(self, items: np.ndarray, factor: int = FACTOR) -> None:
        n = len(items)
        with np.errstate(over="ignore"):
            self.sums = np.append(np.uint64(0), np.cumsum(items * _powers(n, factor), dtype=np.uint64))
            self.back = _powers(n + 1, pow(factor, -1, 1 << 64))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[high] - self.sums[low]) * self.back[low])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over ``width`` items from each place on (fewer at the end)."""
    done, out = 1, x.copy()
    while done < width:
        step = min(done, width - done)
        out[:-step] = pick(out[:-step], out[step:])
        done += step
    return out


def suffixes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, word, begin, left hashes) of the kept suffixes of texts given as bytes with their ends.

    ``begin`` hashes the words that a passage of ``LEAST_WORDS`` shares for certain from
    its first kept suffix on; suffixes closer to their text's end are left out.
    """
    shown = ~SPACES[data]
    edge = np.diff(np.concatenate(([0], shown.view(np.int8), [0])))
    # Texts are parted by a blank, so no word crosses an end.
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(low):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), np.zeros((0, len(LEFT)), dtype=np.int64)
    text = np.searchsorted(ends, low, side="right")
    words = Sums(data.astype(np.uint64) + np.uint64(1)).of(low, high)
    total = Sums(words)
    n = len(words)
    first = np.searchsorted(text, np.arange(len(ends)))
    after = np.append(first[1:], n)[text]
    at = np.arange(n)
    right = LEAST_WORDS - REACH + 1
    gram = np.full(n, MASK, dtype=np.uint64)
    whole = at + GRAM <= after
    gram[whole] = total.of(at[whole], at[whole] + GRAM) >> np.uint64(1)
    # Kept: least of some neighbourhood that holds it.
    least = _sliding(gram, REACH, np.minimum)
    kept = gram == _sliding(least[::-1], REACH, np.maximum)[::-1]
    # Of a run of one repeated word the first two: one place on, they match each other through the run.
    # The others reach past the run's end from any stretch that does.
    same = np.append(False, (gram[1:] == gram[:-1]) & (text[1:] == text[:-1]))
    last = at[~np.append(same[1:], False)]
    to_end = last[np.searchsorted(last, at)] - at
    kept[1:] &= ~(same[1:] & same[:-1]) | np.isin(to_end[1:], np.arange(0, LEAST_WORDS - GRAM, REACH))
    at = at[kept & whole & (at + right <= after)]
    begin = total.of(at, at + right)
    start = first[text[at]]
    lefts = [np.where(at - k >= start, total.of(np.maximum(at - k, 0), at), np.uint64(0)) for k in LEFT]
    return text[at], at - start, begin, (np.stack(lefts, axis=1) >> np.uint64(33)).astype(np.int64)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["text_key", "word", "begin", *(f"left{k}" for k in LEFT)]
    for batch in batches:
        keys = batch.column("text_key").to_numpy(zero_copy_only=False)
        texts = batch.column("text")
        low = 0
        while low < batch.num_rows:
            parts, ends, size, high = [], [], 0, low
            while high < batch.num_rows and (high == low or size < CHUNK):
                raw = (texts[high].as_py() or "").encode("utf-8", "surrogatepass")
                parts += [raw, b" "]
                size += len(raw) + 1
                ends.append(size)
                high += 1
            data = np.frombuffer(b"".join(parts), dtype=np.uint8)
            text, word, begin, lefts = suffixes(data, np.array(ends))
            columns = [keys[low:high][text], word.astype(np.int32), begin.view(np.int64)]
            columns += [lefts[:, i].astype(np.int32) for i in range(len(LEFT))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
            low = high


def _extended(least: int):
    """Maximal equal word runs of text pairs, through the places where they are known to meet."""

    def spans(text: str) -> tuple[list[str], list[int], list[int]]:
        found = list(WORD.finditer(text))
        return [m[0] for m in found], [m.start() for m in found], [m.end() for m in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            sides = zip(*(batch.column(c) for c in ("a", "b", "meets", "text_a", "text_b")), strict=True)
            for a, b, meets, text_a, text_b in sides:
                words_a, from_a, to_a = spans(text_a.as_py())
                words_b, from_b, to_b = (words_a, from_a, to_a) if a == b else spans(text_b.as_py())
                reached: dict[int, int] = {}
                for meet in sorted(meets.as_py(), key=lambda m: m["a"]):
                    i, j = meet["a"], meet["b"]
                    if i < reached.get(j - i, 0):
                        continue
                    x, y = i, j
                    while x and y and words_a[x - 1] == words_b[y - 1]:
                        x, y = x - 1, y - 1
                    while i < len(words_a) and j < len(words_b) and words_a[i] == words_b[j]:
                        i, j = i + 1, j + 1
                    reached[j - i] = i
                    if i - x >= least:
                        rows.append((a.as_py(), b.as_py(), x, i, from_a[x], to_a[i - 1]))
                        rows.append((b.as_py(), a.as_py(), y, j, from_b[y], to_b[j - 1]))
            names = ["text_key", "other", "from_word", "to_word", "start", "end"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    return run


def matches(
    docs: DataFrame, text_col: str = "text", least: int = LEAST_WORDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, found, places): one row per distinct text, and its maximal matches of ``least`` words or more.

    Texts are told apart by their 64-bit hash. ``texts``: text_key, text. ``found``:
    text_key, other (the other text's key), from_word, to_word, start, end (code points).
    Neighbours in order give one link per kept suffix, however often a passage occurs.
    ``places``: text_key, places (words); the kept suffixes that were not compared with
    every suffix that begins alike, for ``shared_stretches`` to look at.
    """
    if least < LEAST_WORDS:
        raise ValueError(f"least is {LEAST_WORDS} or more")
    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).where("text is not null")
    schema = "text_key bigint, word int, begin bigint, " + ", ".join(f"left{k} int" for k in LEFT)
    order = [f"left{k}" for k in LEFT]
    kept = texts.mapInArrow(_kept, schema)
    # Copies of a text fall together here, in part before anything is sent.
    kept = stored(kept.groupBy("begin", "text_key", "word", *order).agg(F.count("*").alias("n")).drop("n"), "suffixes")
    # A beginning with very many suffixes is split by what stands before them; the parts are chained.
    sizes = kept.groupBy("begin").agg(F.count("*").alias("n")).where("n > 1")
    # Each join is written before what follows groups its rows: alone, a frequent key's rows are split.
    common = kept.join(sizes, "begin").withColumn(
        "part", F.pmod(F.xxhash64("left4"), F.ceil(F.col("n") / TOGETHER))
    )
    common = stored(common, "common")
    # Suffixes with the same words before them may still be very many: then their texts split them.
    within = common.groupBy("begin", "part").agg(F.count("*").alias("m"))
    common = common.join(within, ["begin", "part"]).withColumn(
        "share", F.pmod(F.xxhash64("text_key", F.lit(1)), F.ceil(F.col("m") / (2 * TOGETHER)))
    )
    common = stored(common, "shares")
    near = Window.partitionBy("begin", "part", "share").orderBy(*order, "text_key", "word")
    ordered = common.select(
        "begin",
        "text_key",
        "word",
        F.lag("text_key").over(near).alias("other"),
        F.lag("word").over(near).alias("other_word"),
    )
    heads = stored(ordered, "neighbours")
    pairs = heads.where("other is not null").select("text_key", "word", "other", "other_word")
    # The first of each part is linked to the first of all parts of its beginning.
    firsts = heads.where("other is null").select("begin", F.struct("text_key", "word").alias("s"))
    least_of = firsts.groupBy("begin").agg(F.min("s").alias("m"), F.count("*").alias("n")).where("n > 1")
    linked = firsts.join(least_of, "begin").where("s <> m").select("s.*", F.col("m.text_key").alias("other"), F.col("m.word").alias("other_word"))
    pairs = pairs.unionByName(linked)
    ascending = (F.col("text_key") < F.col("other")) | ((F.col("text_key") == F.col("other")) & (F.col("word") <= F.col("other_word")))
    pairs = pairs.select(
        F.least("text_key", "other").alias("a"),
        F.greatest("text_key", "other").alias("b"),
        F.when(ascending, F.struct(F.col("word").alias("a"), F.col("other_word").alias("b")))
        .otherwise(F.struct(F.col("other_word").alias("a"), F.col("word").alias("b")))
        .alias("meet"),
    )
    # Of meets in one alignment the first is enough, as it is extended both ways; a later
    # one is only needed behind words that differ, so all distinct alignments' meets stay.
    meets = pairs.groupBy("a", "b").agg(F.collect_set("meet").alias("meets"))
    meets = stored(meets, "meets")
    one = texts.dropDuplicates(["text_key"])
    needed = meets.select(F.explode(F.array("a", "b")).alias("text_key")).distinct()
    one = stored(texts.join(needed, "text_key", "left_semi").dropDuplicates(["text_key"]), "texts")
    sided = meets.join(one.select(F.col("text_key").alias("a"), F.col("text").alias("text_a")), "a")
    sided = sided.join(one.select(F.col("text_key").alias("b"), F.col("text").alias("text_b")), "b")
    found = sided.select("a", "b", "meets", "text_a", "text_b").mapInArrow(
        _extended(least), "text_key bigint, other bigint, from_word bigint, to_word bigint, start bigint, end bigint"
    )
    # Two suffixes that begin alike are neighbours; of more, some pairs are not.
    places = common.where("n > 2").groupBy("text_key").agg(F.collect_set("word").alias("places"))
    return one, found, stored(places, "places")


def _windows(least: int):
    """Hashes of stretches of ``least`` words of a text, as (text_key, passage, window, own, start, end).

    All stretches of its passages, each once a passage. Outside of them those that hold
    the beginning at one of ``places`` or that occur again in the text (``own``), numbered
    ``-1 - word`` instead of a passage and with their code points.
    """
    right = LEAST_WORDS - REACH + 1
    names = ["text_key", "passage", "window", "own", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(batch.column(c) for c in ("text_key", "text", "passages", "places")), strict=True)
            for key, text, passages, places in sides:
                data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), dtype=np.uint8)
                edge = np.diff(np.concatenate(([0], (~SPACES[data]).view(np.int8), [0])))
                low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                if len(low) < least:
                    continue
                total = Sums(Sums(data.astype(np.uint64) + np.uint64(1)).of(low, high))
                at = np.arange(len(low) - least + 1)
                hashes = total.of(at, at + least)
                outside = np.ones(len(at), dtype=bool)
                numbers, windows = [], []
                for p in passages.as_py() or []:
                    windows.append(np.unique(hashes[p["from_word"] : p["to_word"] - least + 1]))
                    numbers.append(np.full(len(windows[-1]), p["passage"], dtype=np.int64))
                    outside[p["from_word"] : p["to_word"] - least + 1] = False
                held = np.array(places.as_py() or [], dtype=np.int64)
                edges = np.zeros(len(at) + 1, dtype=np.int64)
                np.add.at(edges, np.clip(held + right - least, 0, len(at)), 1)
                np.add.at(edges, np.clip(held + 1, 0, len(at)), -1)
                _, kind, counts = np.unique(hashes, return_inverse=True, return_counts=True)
                again = counts[kind] > 1
                more = np.flatnonzero(outside & ((np.cumsum(edges[:-1]) > 0) | again))
                before = sum(map(len, windows))
                n = before + len(more)
                if not n:
                    continue
                points = np.cumsum((data & 0xC0) != 0x80)
                numbers, windows = np.concatenate([*numbers, -1 - more]), np.concatenate([*windows, hashes[more]])
                own = np.append(np.zeros(before, dtype=bool), again[more])
                ends = [points[low[more]] - 1, points[high[more + least - 1] - 1]]
                ends = [np.append(np.zeros(before, dtype=np.int64), e) for e in ends]
                columns = [np.full(n, key.as_py(), dtype=np.int64), numbers, windows.view(np.int64), own, *ends]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def shared_stretches(
    texts: DataFrame, merged: DataFrame, places: DataFrame, copies: DataFrame, least: int = LEAST_WORDS
) -> tuple[DataFrame, DataFrame]:
    """(stretches, holders) from all stretches of ``least`` words, each counted once however often it occurs.

    ``stretches``: further matches (text_key, passage, from_word, to_word, start, end, own)
    outside the passages ``merged``: stretches that neighbours in order did not show to
    recur, ``own`` if in their own text. ``holders``: (text_key, passage, holder), the
    smallest id of any other text that shares ``least`` words of the passage or stretch.
    """
    grouped = merged.groupBy("text_key").agg(F.collect_list(F.struct("passage", "from_word", "to_word")).alias("passages"))
    windows = texts.join(grouped, "text_key", "left").join(places, "text_key", "left")
    windows = windows.select("text_key", "text", "passages", "places").mapInArrow(
        _windows(least), "text_key bigint, passage bigint, window bigint, own boolean, start bigint, end bigint"
    )
    ids = copies.where("least_id is not null").select("text_key", F.col("least_id").alias("id"))
    windows = stored(windows.join(ids, "text_key", "left"), "windows")
    first = windows.groupBy("window").agg(
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "text_key"))).alias("m"),
        F.min("text_key").alias("x"),
        F.max("text_key").alias("y"),
    )
    first = first.where("x <> y").select("window", F.col("m.id").alias("first_id"), F.col("m.text_key").alias("first_key"))
    first = stored(first, "holders")
    met = windows.join(first, "window")
    others = met.where("text_key <> first_key").groupBy("text_key", "passage").agg(F.min("first_id").alias("holder"))
    # The first holder of a stretch is told the second.
    second = met.where("text_key <> first_key and id is not null").groupBy("window", "first_key").agg(F.min("id").alias("id"))
    own = windows.select("window", "passage", F.col("text_key").alias("first_key"))
    seconds = own.join(second, ["window", "first_key"]).groupBy(F.col("first_key").alias("text_key"), "passage")
    holders = others.unionByName(seconds.agg(F.min("id").alias("holder"))).groupBy("text_key", "passage").agg(
        F.min("holder").alias("holder")
    )
    alone = windows.where("passage < 0")
    found = alone.where("own").unionByName(alone.join(first.select("window"), "window", "left_semi").where("not own"))
    word = -1 - F.col("passage")
    stretches = found.select(
        "text_key", "passage", word.alias("from_word"), (word + least).alias("to_word"), "start", "end", "own"
    )
    return stretches, holders


def _united(spans: DataFrame) -> DataFrame:
    """(text_key, passage, start, end, from_word, to_word, other_id): spans of a text that overlap or touch as one passage."""
    order = Window.partitionBy("text_key").orderBy("from_word", "to_word")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opened = spans.withColumn(
        "opens", (F.col("from_word") > F.coalesce(F.max("to_word").over(before), F.lit(-1))).cast("int")
    )
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        opened.withColumn("passage", F.sum("opens").over(upto))
        .groupBy("text_key", "passage")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.min("from_word").alias("from_word"),
            F.max("to_word").alias("to_word"),
            F.min("other_id").alias("other_id"),
        )
    )


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS
) -> DataFrame:
    """One row per passage of a document that occurs again: doc_id, start, end, n_words, other_doc_id, first_doc_id.

    Matches that overlap or touch in a text are one passage; ``start`` and ``end`` are
    its code points. ``other_doc_id`` is the smallest id among other rows that share
    part of it (the document's own if the passage recurs in itself only),
    ``first_doc_id`` the smaller of both, so passages to cut are those whose
    ``first_doc_id`` is not their own. Texts that occur in several rows are one passage
    from the first word to the last, if long enough. Null and empty texts and texts
    below ``least`` words have none; null ids keep their rows and are never named.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")
    ).where("text is not null")
    texts, found, places = matches(docs, text_col, least)
    found = stored(found, "found")
    narrow = rows.select(
        "doc_id",
        "text_key",
        F.size(F.regexp_extract_all("text", F.lit(WORD.pattern), F.lit(0))).cast("bigint").alias("words"),
        F.char_length(F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)).cast("bigint").alias("lead"),
        F.char_length(F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")).cast("bigint").alias("tail"),
    )
    narrow = stored(narrow, "rows")
    copies = narrow.groupBy("text_key").agg(
        F.min("doc_id").alias("least_id"),
        F.count("*").alias("n"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("x"),
        F.first("words").alias("words"),
        F.first("lead").alias("lead"),
        F.first("tail").alias("tail"),
    )
    copies = stored(copies.drop("x"), "copies")
    whole = copies.where((F.col("n") > 1) & (F.col("words") >= least)).select(
        "text_key",
        F.lit(0).cast("bigint").alias("from_word"),
        F.col("words").alias("to_word"),
        F.col("lead").alias("start"),
        F.col("tail").alias("end"),
        F.col("least_id").alias("other_id"),
    )
    named = found.join(copies.select(F.col("text_key").alias("other"), F.col("least_id").alias("other_id")), "other")
    every = named.select("text_key", "from_word", "to_word", "start", "end", "other_id").unionByName(whole)
    merged = stored(_united(every), "passages")
    stretches, held = shared_stretches(texts, merged, places, copies, least)
    held = stored(held, "held")
    further = stretches.join(copies.select("text_key", "least_id"), "text_key").withColumn(
        "other_id", F.when(F.col("own"), F.col("least_id"))
    )
    spans = merged.unionByName(further.select(*merged.columns)).join(held, ["text_key", "passage"], "left")
    merged = _united(spans.withColumn("other_id", F.least("other_id", "holder"))).select(
        "text_key",
        "start",
        "end",
        (F.col("to_word") - F.col("from_word")).alias("n_words"),
        F.col("other_id").alias("other_doc_id"),
    )
    return narrow.join(merged, "text_key").select(
        "doc_id",
        "start",
        "end",
        "n_words",
        "other_doc_id",
        F.least("doc_id", "other_doc_id").alias("first_doc_id"),
    )
