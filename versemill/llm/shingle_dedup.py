"""Near-duplicates by SimHash fingerprints and exact Jaccard similarity of five-word shingles.

Every shingle set has a SimHash fingerprint; covering tables link those at most ``RADIUS``
bits apart. A 64-bit fingerprint cannot hold a similarity of 0.8 alone: such pairs differ
in ten bits on average and in seventeen at times, and no covering tables of that radius
are of use. So pairs further apart are met by bands of minima: every text has ``BANDS``
keys of ``ROWS`` minimum hashes, a pair of similarity ``s`` shares one with probability
``1 - (1 - s ** ROWS) ** BANDS`` (all but one pair in 20 million at 0.8). Pairs of both ways
are verified by the exact similarity of their shingle sets. Sets of large buckets meet by
their rarest shingles; where many sets share these too, they are compared in blocks, each
with every one that verified pairs have not joined it with, so that no link is lost there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versemill.llm.common import components, stored, words_of
from versemill.llm.simhash import links as print_links
from versemill.llm.simhash import lower_ascii, majority, one_of_each, shingle_hashes

WORDS = 5
SIMILAR = 0.8
# Bits that fingerprints linked by covering tables differ in at most.
RADIUS = 2
BANDS, ROWS = 32, 4
# Equal minima of a pair that is verified: six standard deviations below those of a pair of similarity 0.8.
AGREE = 75
# Texts of a bucket that are all compared, and the mean size of the random groups of larger ones, whose pairs come first.
BUCKET, GROUP = 32, 4
# Shingles of the sets of a block. Two blocks are compared at a time.
BLOCK = 1 << 19
# Pairs of each text that are verified before those that other pairs may have linked.
FIRST = 4
# Shingle hashes taken to minima at a time.
CHUNK = 1 << 18
SEED = 20_240_301


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _sketched(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set keys, band keys, one byte per minimum) of non-empty sets given end to end."""
    seeds = np.random.default_rng(SEED).integers(0, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64)
    least = np.empty((len(starts), BANDS * ROWS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        keys = np.add.reduceat(_mixed(values), starts)
        for k, (flip, factor) in enumerate(seeds.T):
            least[:, k] = np.minimum.reduceat((values ^ flip) * (factor | np.uint64(1)), starts)
        least = _mixed(least)
        bands = np.zeros((len(starts), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            bands = _mixed(bands * np.uint64(0x9E3779B97F4A7C15) + least[:, r::ROWS])
    return keys, bands, (least & np.uint64(255)).astype(np.uint8)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("hashes")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).astype("<i8", copy=False).view("<u8")
        keys = np.zeros(batch.num_rows, dtype=np.uint64)
        bands = np.zeros((batch.num_rows, BANDS), dtype=np.uint64)
        minima = np.zeros((batch.num_rows, BANDS * ROWS), dtype=np.uint8)
        full = np.flatnonzero(np.diff(offsets))
        low = 0
        while low < len(full):
            high = max(low + 1, int(np.searchsorted(offsets[full + 1], offsets[full[low]] + CHUNK, side="right")))
            some = full[low:high]
            first = offsets[some[0]]
            part = values[first : offsets[some[-1] + 1]]
            keys[some], bands[some], minima[some] = _sketched(part, offsets[some] - first)
            low = high
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(keys.view(np.int64)),
                pa.ListArray.from_arrays(
                    np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.view(np.int64).ravel())
                ),
                pa.array([m.tobytes() for m in minima], pa.binary()),
                pa.array(majority(values.view("<i8"), offsets), pa.int64()),
            ],
            ["doc_id", "text_key", "set_key", "bands", "minima", "print"],
        )


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, hashes): the distinct shingles of every row's text.

    The whole text is the one shingle of a shorter text; texts without a word have none.
    """
    words = words_of(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))))
    split = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), words.alias("words")
    )
    hashes = shingle_hashes(F.col("words"), F.size("words"), WORDS).alias("hashes")
    return split.select("doc_id", "text_key", hashes).select("doc_id", "text_key", F.array_distinct("hashes").alias("hashes"))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)
            for c in ("minima_a", "minima_b")
        )
        n = (a == b).sum(axis=1).astype(np.int32)
        out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n)], ["a", "b", "n"])
        yield out.filter(pa.array(n >= AGREE))


def _rarest(sets: DataFrame) -> DataFrame:
    """(set_key, size, key, n): the rarest shingles of every set, of which two similar sets share one, and how many sets hold each.

    In one order of all shingles, by how many of these sets hold them, sets of a
    similarity of ``SIMILAR`` meet among their first ``n - ceil(SIMILAR * n) + 1``.
    """
    each = sets.select("set_key", F.explode("hashes").alias("key"))
    held = each.groupBy("key").agg(F.count("*").alias("n"))
    placed = each.join(held, "key").groupBy("set_key").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("s"))
    tenths = round(10 * SIMILAR)
    first = F.size("s") - F.ceil(F.size("s") * tenths / 10).cast("int") + 1
    shared = F.filter(F.slice("s", F.lit(1), first), lambda e: e["n"] > 1)
    return placed.select("set_key", F.size("s").alias("size"), F.explode(shared).alias("e")).select(
        "set_key", "size", F.col("e.key").alias("key"), F.col("e.n").alias("n")
    )


def buckets(nodes: DataFrame) -> DataFrame:
    """(band, key, set_key, n): the bands that ``n`` sets share, more than one."""
    keyed = nodes.select("set_key", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(sizes, ["band", "key"]).select("band", "key", "set_key", "n")


def candidates(nodes: DataFrame, met: DataFrame) -> DataFrame:
    """(a, b, n): pairs of sets that share a bucket and ``n`` of their minima, ``AGREE`` or more.

    Of buckets of more than ``BUCKET`` sets, such as pages of one template, only pairs
    within random groups are given, anew for each band, so that cost is in proportion to
    the sets. They join most of what is similar; ``crowded_links`` finds the rest.
    """
    group = F.when(F.col("n") > BUCKET, F.pmod(F.xxhash64("set_key", "band", "key"), F.ceil(F.col("n") / GROUP)))
    groups = met.withColumn("part", F.coalesce(group, F.lit(0))).groupBy("band", "key", "part")
    listed = groups.agg(F.array_sort(F.collect_list("set_key")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(
        F.transform(
            "s",
            lambda x, i: F.transform(
                F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b"))
            ),
        )
    )
    pairs = listed.select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
    sided = pairs.join(nodes.select(F.col("set_key").alias("a"), F.col("minima").alias("minima_a")), "a")
    sided = sided.join(nodes.select(F.col("set_key").alias("b"), F.col("minima").alias("minima_b")), "b")
    return sided.select("a", "b", "minima_a", "minima_b").mapInArrow(_alike, "a bigint, b bigint, n int")


def _joined(keys: np.ndarray, roots: np.ndarray, sides: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of different roots, enough to join all that are similar, of sets given end to end.

    Where there are two sides, sets meet those of the other side only. Sets of the largest
    root are asked by the others, so sets that are joined already are not compared.
    """
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, number = np.unique(values, return_inverse=True)
    holders = owner[np.argsort(number, kind="stable")]
    ends = np.cumsum(np.bincount(number, minlength=1))
    starts = np.append(0, ends[:-1])
    _, label, count = np.unique(roots, return_inverse=True, return_counts=True)
    two = sides.min() != sides.max()
    tenths = round(10 * SIMILAR)
    found = []
    for i in np.argsort(count[label], kind="stable"):
        if label[i] == np.bincount(label).argmax():
            continue
        mine = number[offsets[i] : offsets[i + 1]]
        common = np.bincount(np.concatenate([holders[starts[v] : ends[v]] for v in mine]), minlength=len(sizes))
        near = (10 * common >= tenths * (sizes + sizes[i] - common)) & (label != label[i])
        for j in np.flatnonzero(near & (sides != sides[i]) if two else near):
            if label[j] != label[i]:
                found.append((int(min(keys[i], keys[j])), int(max(keys[i], keys[j]))))
                label[label == label[j]] = label[i]
    return found


def _block_links(block: pa.Table) -> pa.Table:
    lists = block.column("hashes").combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    key, root, side = (block.column(c).to_numpy() for c in ("set_key", "root", "side"))
    found = _joined(key, root, side, values[offsets[0] : offsets[-1]], offsets - offsets[0])
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def crowded_links(rare: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join all similar sets that share one of their rarest shingles and that ``links`` has not joined.

    ``rare`` has rarest shingles of sets and their sizes, ``links`` verified pairs. Of each
    shingle whose sets are not all joined, the sets are dealt to blocks by root and every
    two blocks are compared in a task of their own, but for two of one and the same root.
    """
    so_far = components(links, "a", "b").withColumnRenamed("node", "set_key")
    rooted = rare.join(so_far, "set_key", "left").select("key", "set_key", "size", F.coalesce("root", "set_key").alias("root"))
    rooted = stored(rooted, "rooted")
    apart = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    before = Window.partitionBy("key").orderBy("root", "set_key")
    dealt = rooted.join(apart, "key").withColumn("block", F.floor((F.sum("size").over(before) - F.col("size")) / BLOCK))
    dealt = stored(dealt, "blocks")
    blocks = dealt.groupBy("key", "block").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    i, j = (blocks.select("key", *(F.col(c).alias(c + k) for c in ("block", "x", "y"))) for k in "ij")
    one = F.least("xi", "xj") == F.greatest("yi", "yj")
    both = i.join(j, "key").where((F.col("blocki") <= F.col("blockj")) & ~one)
    sides = F.array_distinct(F.array(F.struct(F.col("blocki").alias("block"), F.lit(0).alias("side")), F.struct(F.col("blockj").alias("block"), (F.col("blocki") < F.col("blockj")).cast("int").alias("side"))))
    asked = both.select("key", "blocki", "blockj", F.explode(sides).alias("e")).select("key", "blocki", "blockj", "e.block", "e.side")
    members = asked.join(dealt, ["key", "block"]).join(sets.select("set_key", "hashes"), "set_key")
    members = members.select("key", "blocki", "blockj", "set_key", "root", "side", "hashes")
    return members.groupBy("key", "blocki", "blockj").applyInArrow(_block_links, "a bigint, b bigint").distinct()


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b, n): pairs of sets whose fingerprints covering tables link; ``n`` is above that of any pair met by minima.

    Sets of one fingerprint are linked to the least of them, which stands for all in the links.
    """
    of_print = nodes.groupBy("print").agg(F.min("set_key").alias("a"))
    same = nodes.join(of_print, "print").select("a", F.col("set_key").alias("b"))
    near = print_links(of_print.select("print"), RADIUS)
    x, y = (of_print.select(F.col("print").alias(p), F.col("a").alias(k)) for p, k in (("a", "x"), ("b", "y")))
    apart = near.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(apart).where("a <> b").withColumn("n", F.lit(BANDS * ROWS + 1))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``SIMILAR`` or more."""
    sided = pairs.select("a", "b").join(sets.select(F.col("set_key").alias("a"), F.col("hashes").alias("x")), "a")
    sided = sided.join(sets.select(F.col("set_key").alias("b"), F.col("hashes").alias("y")), "b")
    # In tenths, so that a similarity of exactly 0.8 counts.
    common = F.size(F.array_intersect("x", "y"))
    tenths = round(10 * SIMILAR)
    counted = sided.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("n"))
    return counted.where(10 * F.col("c") >= tenths * (F.col("n") - F.col("c"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, root, component_id): one row per input row.

    ``component_id`` is the smallest id that chains of similar texts reach, ``root`` the
    shingle set that stands for the component. Rows with equal sets are one node. Each
    text's likeliest pairs are verified first, then those that these have not joined
    already, so the result is that of verifying all.
    """
    rows = shingle_sets(docs, id_col, text_col)
    each = rows.mapInArrow(
        _sketches, "doc_id bigint, text_key bigint, set_key bigint, bands array<bigint>, minima binary, print bigint"
    )
    each = stored(each, "sketches")
    nodes = each.groupBy("set_key").agg(
        F.min("doc_id").alias("least"),
        F.min("text_key").alias("text_key"),
        F.min("bands").alias("bands"),
        F.min("minima").alias("minima"),
        F.min("print").alias("print"),
    )
    nodes = stored(nodes, "nodes")

    def sets_of(keys: DataFrame) -> DataFrame:
        """Shingles of the sets named, each from one of its texts; texts without one of those keys are not sent."""
        needed = stored(nodes.join(keys, "set_key", "left_semi").select("set_key", "text_key"), "needed")
        texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"), F.lit(0).alias("none"))
        texts = texts.join(needed.select("text_key"), "text_key", "left_semi").dropDuplicates(["text_key"])
        return shingle_sets(texts, "none", "text").select("text_key", "hashes").join(needed, "text_key").select("set_key", "hashes")

    met = stored(buckets(nodes), "buckets")
    crowded = stored(sets_of(met.where(F.col("n") > BUCKET).select("set_key").distinct()), "crowded")
    rare = stored(_rarest(crowded), "rare")
    few = rare.where(F.col("n") <= BUCKET).select(F.lit(-1).alias("band"), "key", "set_key", "n")
    pairs = fingerprint_pairs(nodes).unionByName(candidates(nodes, met.unionByName(few)))
    pairs = stored(pairs.groupBy("a", "b").agg(F.max("n").alias("n")), "pairs")
    sets = stored(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()), "sets")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    ranked = stored(pairs.withColumn("place", place), "ranked")
    links = stored(_verified(ranked.where(F.col("place") <= FIRST), sets), "verified")
    rest = ranked.where(F.col("place") > FIRST)
    if not rest.isEmpty():
        so_far = components(links, "a", "b")
        rest = rest.join(so_far.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
        rest = rest.join(so_far.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
        apart = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
        links = links.unionByName(stored(_verified(apart, sets), "verified"))
    many = rare.where(F.col("n") > BUCKET)
    if not many.isEmpty():
        links = links.unionByName(stored(crowded_links(many, links, crowded), "joined"))
    roots = components(links, "a", "b").withColumnRenamed("node", "set_key")
    rooted = nodes.join(roots, "set_key", "left").select("set_key", "least", F.coalesce("root", "set_key").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(firsts, "root").select("set_key", "root", "component_id")
    return each.join(named, "set_key").select("doc_id", "text_key", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each near-duplicate component, all columns unchanged; which, as for ``simhash.keep_one``."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)
