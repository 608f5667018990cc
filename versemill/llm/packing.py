"""Packing of token sequences by non-negative least squares over fill patterns.

A document is cut into full windows and one remainder. The remainders' lengths form a
histogram of at most ``window`` numbers, whatever the corpus. Patterns of two or three
lengths that fill a window exactly are enumerated, their repeat counts solved against
the histogram by non-negative least squares, rounded down, and what is left is packed
greedily. Pieces then look up their sequence by their rank among pieces of their length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.llm.common import stored

WINDOW = 1024
# Short lengths that take part in patterns of three.
FILLERS = 32
# Pieces of one length that are ranked together at most, on average.
RANKED = 20_000
END_ID = 0


def _lone_breaks(text: str) -> bool:
    """Whether single blanks and line breaks between visible characters are all white space there is."""
    words = text.split()
    between = len(text) - len("".join(words))
    return len(words) == between + 1 and text.count(" ") + text.count("\n") == between


# Where white space stands alone, this first split equals the byte-level one without looking ahead,
# which the faster matcher needs.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def _byte_ranks(content: dict) -> dict[bytes, int] | None:
    """The merge rank of each token's bytes, if the file is plain byte-level BPE with ids in merge order."""
    model, split = content["model"], content.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
    if not plain or content.get("normalizer") or model.get("ignore_merges") or not split.get("use_regex", True):
        return None
    # Visible Latin-1 characters stand for their own byte, the other bytes follow from 256 on.
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    symbol = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*own}))}
    special = {t["content"] for t in content.get("added_tokens", [])}
    ranks = {bytes(map(symbol.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"].get(a + b) for a, b in merges]
    return ranks if made == list(range(256, 256 + len(made))) and len(ranks) == 256 + len(made) else None


class Encoder:
    """Texts to little-endian 32-bit ids of the tokenizer at ``path``.

    Ordinary texts of a byte-level BPE take a faster implementation of the same merges;
    texts with other white space or with a special token's string, and other kinds of
    tokenizer, take the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            ranks = _byte_ranks(json.load(file))
        self.fast = ranks and tiktoken.Encoding("lone", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast and _lone_breaks(text) and not any(s in text for s in self.specials):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


def _cut(path: str, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], list(names))

    return run


def cut_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and one remainder of every row's ids."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        _cut(path, window), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )


def patterns(present: np.ndarray, window: int) -> np.ndarray:
    """Ascending combinations of two or three lengths that fill a window; unused places are zero."""
    lengths = np.flatnonzero(present)
    pairs = [(0, a, window - a) for a in lengths if a <= window - a and present[window - a]]
    low = [a for a in range(1, window // 3 + 1) if present[a]]
    fillers = low[:: max(1, len(low) // FILLERS)]
    triples = [
        (a, b, window - a - b)
        for a in fillers
        for b in lengths[(lengths >= a) & (2 * lengths <= window - a)]
        if present[window - a - b]
    ]
    return np.array(pairs + triples, dtype=np.int64).reshape(-1, 3)


def solve(histogram: np.ndarray, mix: np.ndarray, rounds: int = 2_000) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring their lengths' sums closest to the histogram.

    Accelerated projected gradient steps; the step follows from the most patterns a length is in.
    """
    size = len(histogram)
    target = histogram.astype(float)
    target[0] = 0

    def lengths_of(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(mix[:, k], weights=x, minlength=size) for k in range(3))
        total[0] = 0
        return total

    uses = np.bincount(mix.ravel(), minlength=size)
    uses[0] = 0
    step = 1.0 / (3 * max(1, uses.max()))
    x = y = np.zeros(len(mix))
    momentum = 1.0
    for _ in range(rounds):
        error = lengths_of(y) - target
        after = np.maximum(y - step * error[mix].sum(axis=1), 0)
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = after + (momentum - 1) / faster * (after - x)
        x, momentum = after, faster
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences), covering the histogram exactly.

    Patterns that the least squares solution repeats most are taken first, rounded down
    and never beyond what is there; the rest goes into windows largest first, each
    filled with the largest lengths that still fit.
    """
    left = histogram.copy()
    made: list[tuple[list[int], int]] = []
    mix = patterns(left > 0, window)
    if len(mix):
        counts = solve(histogram, mix)
        for k in np.argsort(-counts, kind="stable"):
            lengths = [int(v) for v in mix[k] if v]
            need = {v: lengths.count(v) for v in lengths}
            times = int(min([np.floor(counts[k]), *(left[v] // n for v, n in need.items())]))
            if times > 0:
                made.append((lengths, times))
                for v, n in need.items():
                    left[v] -= times * n
    while left.any():
        room, lengths, taken = window, [], np.zeros_like(left)
        while room:
            fits = np.flatnonzero((left - taken)[: room + 1] > 0)
            if not len(fits):
                break
            v = int(fits[-1])
            n = int(min(room // v, left[v] - taken[v]))
            lengths += [v] * n
            taken[v] += n
            room -= n * v
        used = np.flatnonzero(taken)
        times = int((left[used] // taken[used]).min())
        left[used] -= times * taken[used]
        made.append((lengths, times))
    return made


def _segments(spark: SparkSession, made: list[tuple[list[int], int]], first: int) -> DataFrame:
    """(size, from_rank, to_rank, sequence, at): which ranks of a length go to which sequences."""
    taken: dict[int, int] = {}
    rows = []
    for lengths, times in made:
        at = 0
        for v in lengths:
            low = taken.get(v, 0)
            rows.append((v, low, low + times, first, at))
            taken[v] = low + times
            at += v
        first += times
    return spark.createDataFrame(rows, "size long, from_rank long, to_rank long, sequence long, at long")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each row's ids end with id 0, so null and empty texts are one piece of one id.
    Repeated rows are packed each; rows with equal or null ids keep their own pieces.
    Only counts per length reach the driver. No rows give no pieces.
    """
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, path, id_col, text_col, window), "pieces")
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in sizes.items():
        histogram[length] = n
    full, histogram[window] = int(histogram[window]), 0
    made = plan(histogram, window)
    segments = _segments(spark, [([window], full)] * (full > 0) + made, 0)
    # Ranks within (length, salt) start where the smaller salts of that length end.
    salts = max(1, -(-max(sizes.values(), default=0) // RANKED))
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts))
    salted = pieces.withColumn("salt", salt)
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    starts = starts.selectExpr(
        "length",
        "salt",
        "coalesce(sum(n) over (partition by length order by salt rows between unbounded preceding and 1 preceding), 0) as before",
    )
    ranked = salted.selectExpr(
        "*", "row_number() over (partition by length, salt order by doc_id, start, ids_crc32, doc_tokens) - 1 as place"
    )
    ranked = ranked.join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("place"))
    # Segments are bounded by the number of patterns, which depends on the window only.
    here = (F.col("length") == F.col("size")) & F.col("rank").between(F.col("from_rank"), F.col("to_rank") - 1)
    return ranked.join(F.broadcast(segments), here).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"),
        F.col("at").alias("offset"),
    )
