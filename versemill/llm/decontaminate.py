"""Benchmark decontamination: windows within a small edit distance of a benchmark item.

The walk of Chakraborty, Goldenberg and Koucky reads a string and repeats each
character or moves on by shared random bits, so that strings a few edits apart become
sequences a few symbols apart. Item-sized windows are embedded this way and hashed
by samples of positions, repeated until the target recall is reached; windows that
meet an item in some repetition are verified by exact edit distance.

Windows are placed by pieces: an item of m characters has floor(m / 9) pieces, more
than the edits allowed, so a window within that many edits holds one piece unchanged
and starts where that piece says, give or take the edits before it. Other windows
cannot qualify and are not embedded.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters of a piece, and edits allowed per character of an item.
PIECE = 9
EDITS = 0.1
# Positions sampled in each repetition; repetitions follow from the target recall.
SAMPLES = 5
RECALL = 0.99
# Share of embedded symbols that a window near the allowed distance is taken to keep.
AGREE = 0.5
# Share of all sampled symbols in which a pair that meets agrees, too; strangers agree in an eighth.
NEAR = 0.25
# Independent walks: one that starts an edit off may stay off for long.
WALKS = 3
# Walked steps per character of an item: two would read it whole on average.
STEPS = 1.9
# Benchmark items sent to the tasks at a time; larger benchmarks take more passes.
BLOCK = 5_000
SEED = 20_240_229
SPACE, END = 32, 0


@cache
def _fold() -> np.ndarray:
    """Code point to comparison symbol: lower case for letters and digits, else a space."""
    table = np.full(sys.maxunicode + 1, SPACE, dtype=np.uint32)
    for i in range(len(table)):
        low = chr(i).lower()
        if chr(i).isalnum():
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Comparison symbols of a text with runs of spaces made one, and the place of each in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = _fold()[codes]
    space = out == SPACE
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    places = np.flatnonzero(keep)
    return out[places], places


def _rolling(x: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` symbols from each position on (shorter at the end)."""
    factor = np.uint64(0x9E3779B97F4A7C15)
    result, done, power = np.zeros(len(x), dtype=np.uint64), 0, x.astype(np.uint64) * factor + np.uint64(1)
    width, scale = 1, factor
    total_scale = np.uint64(1)
    with np.errstate(over="ignore"):
        while width <= size:
            if size & width:
                shifted = np.zeros_like(result)
                shifted[: max(len(x) - done, 0)] = power[done:]
                result = result + shifted * total_scale
                done += width
                total_scale = total_scale * scale
            nxt = power.copy()
            nxt[: max(len(x) - width, 0)] += power[width:] * scale
            power, scale, width = nxt, scale * scale, width * 2
        result ^= result >> np.uint64(29)
        result *= np.uint64(0xBF58476D1CE4E5B9)
        result ^= result >> np.uint64(32)
    return result


def _bits(steps: int) -> np.ndarray:
    """The shared random moves of each walk: by step and symbol."""
    return np.random.default_rng(SEED).integers(0, 2, size=(WALKS, steps, 256), dtype=np.uint8)


def _bytes(symbols: np.ndarray, room: int) -> np.ndarray:
    """One byte per symbol for the walk, and ``room`` more so that no walk leaves the array."""
    folded = ((symbols * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    return np.append(folded, np.zeros(room, dtype=np.uint8))


def embed(folded: np.ndarray, starts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Embedded symbols of the walks from ``starts``, one row per step."""
    out = np.empty((len(bits), len(starts)), dtype=np.uint8)
    at = starts.astype(np.int64)
    for j, move in enumerate(bits):
        np.take(folded, at, out=out[j], mode="clip")
        at += np.take(move, out[j])
    return out


def edit_end(item: str, text: str) -> tuple[int, int]:
    """Least edit distance between ``item`` and any part of ``text``, and that part's end (the first best)."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = ones, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        across = eq | down
        eq |= ((eq & up) + up) ^ up
        grow = down | (~(eq | up) & ones)
        fall = up & eq
        score += bool(grow & top) - bool(fall & top)
        grow, fall = grow << 1 & ones, fall << 1 & ones
        up = fall | (~(across | grow) & ones)
        down = grow & across
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """One block of benchmark items with their pieces, sampled positions and embeddings."""

    def __init__(self, items: list[tuple[int, str]], edits: float) -> None:
        kept = []
        for item_id, text in items:
            symbols = _symbols(text)[0]
            if len(symbols) and symbols[0] == SPACE:
                symbols = symbols[1:]
            if len(symbols) and symbols[-1] == SPACE:
                symbols = symbols[:-1]
            if len(symbols):
                kept.append((item_id, symbols))
        self.ids = [i for i, _ in kept]
        self.symbols = [s for _, s in kept]
        self.text = ["".join(map(chr, s)) for s in self.symbols]
        self.size = np.array([len(s) for s in self.symbols], dtype=np.int64)
        pieces = np.maximum(self.size // PIECE, 1)
        self.edits = np.minimum((self.size * edits).astype(np.int64), pieces - 1)
        repeats = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**SAMPLES) / WALKS))
        self.steps = np.maximum((self.size * STEPS).astype(np.int64), 1)
        self.room = int(self.steps.max(initial=1)) + 1
        self.bits = _bits(self.room)
        rng = np.random.default_rng(SEED + 1)
        self.wanted = (rng.random((len(kept), repeats * SAMPLES)) * self.steps[:, None]).astype(np.int64)
        flat = np.concatenate([*self.symbols, np.zeros(1, np.uint32)])
        starts = np.cumsum(np.append(0, self.size))[:-1]
        self.sampled = np.zeros((WALKS, *self.wanted.shape), dtype=np.uint8)
        for k, s in enumerate(self.symbols):
            folded = _bytes(s, self.room)
            for w in range(WALKS):
                walked = embed(folded, np.zeros(1), self.bits[w, : self.steps[k]])[:, 0]
                self.sampled[w, k] = walked[self.wanted[k]]
        self.anchors: dict[int, tuple[np.ndarray, ...]] = {}
        for width in sorted({int(min(PIECE, m)) for m in self.size}):
            mine = np.flatnonzero(np.minimum(self.size, PIECE) == width)
            rows = [(k, p * width) for k in mine for p in range(int(pieces[k]))]
            item, offset = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
            keys = _rolling(flat, width)[starts[item] + offset]
            by = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, dtype=bool)
            seen[keys >> np.uint64(44)] = True
            self.anchors[width] = (keys[by], item[by], offset[by], seen)

    def places(self, symbols: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, start, cut) of all windows that hold a piece of an item at its own place.

        ``edges`` are the texts' first symbols. Where a text lacks some of the item's
        first symbols, the window starts with the text and is ``cut``; it cannot
        qualify by this piece if more symbols are missing than edits allowed.
        """
        found = []
        for width, (keys, item, offset, seen) in self.anchors.items():
            hashes = _rolling(symbols, width)
            at = np.flatnonzero(seen[hashes >> np.uint64(44)])
            low, high = (np.searchsorted(keys, hashes[at], side) for side in ("left", "right"))
            at, low, count = at[high > low], low[high > low], (high - low)[high > low]
            which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = np.repeat(at, count)
            first = edges[np.searchsorted(edges, place, side="right") - 1]
            missing = first - (place - offset[which])
            near = missing <= self.edits[item[which]]
            start = np.maximum(place - offset[which], first)
            found.append(np.stack([item[which], start, missing > 0])[:, near])
        both = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
        window, cut = np.divmod(np.unique((both[0] * len(symbols) + both[1]) * 2 + both[2]), 2)
        item, start = np.divmod(window, len(symbols))
        return item, start, cut.astype(bool)

    def alike(self, symbols: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which windows agree with their item on all sampled positions of some repetition."""
        result = np.zeros(len(item), dtype=bool)
        folded = _bytes(symbols, self.room)
        # Candidates come by item; those of like lengths are walked together.
        order = np.argsort(self.size[item], kind="stable")
        for low in range(0, len(order), 1 << 13):
            some = order[low : low + (1 << 13)]
            mine = item[some]
            for w in range(WALKS):
                walked = embed(folded, start[some], self.bits[w, : self.steps[mine].max()])
                same = walked[self.wanted[mine], np.arange(len(some))[:, None]] == self.sampled[w, mine]
                met = same.reshape(len(some), -1, SAMPLES).all(axis=2).any(axis=1)
                result[some] |= met & (same.mean(axis=1) >= NEAR)
        return result


def _search(items: Items, edits: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            rows = []
            low = 0
            while low < len(ids):
                group, size = [], 0
                while low < len(ids) and (not group or size < 1 << 20):
                    text = texts[low].as_py() or ""
                    group.append((ids[low], text))
                    size += len(text)
                    low += 1
                rows += _verified(items, group)
            names = ("doc_id", "item_id", "edits", "start", "end")
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], list(names))

    return run


def _verified(items: Items, group: list[tuple[int | None, str]]) -> list[tuple]:
    """(doc_id, item_id, edits, start, end) of the best window of each item in each text of the group."""
    parts = [_symbols(text) for _, text in group]
    gap = np.array([END], dtype=np.uint32)
    flat = np.concatenate([x for symbols, _ in parts for x in (symbols, gap)])
    edges = np.cumsum([0] + [len(s) + 1 for s, _ in parts])
    item, start, hit = items.places(flat, edges[:-1])
    # The walks of a cut window start apart from the item's, so it is verified without them.
    walked = np.flatnonzero(~hit)
    if len(walked):
        hit[walked] = items.alike(flat, item[walked], start[walked])
    item, start = item[hit], start[hit]
    doc = np.searchsorted(edges, start, side="right") - 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    reach: dict[tuple[int, int], int] = {}
    for k, s, d in zip(item.tolist(), start.tolist(), doc.tolist(), strict=True):
        symbols, places = parts[d]
        allowed, m = int(items.edits[k]), int(items.size[k])
        if s <= reach.get((k, d), -1):
            continue
        low = max(s - edges[d] - allowed, 0)
        high = min(s - edges[d] + m + 2 * allowed, len(symbols))
        near = "".join(map(chr, symbols[low:high]))
        edits, end = edit_end(items.text[k], near)
        if edits > allowed:
            continue
        reach[k, d] = s + allowed
        back, length = edit_end(items.text[k][::-1], near[:end][::-1])
        first, last = int(places[low + end - length]), int(places[low + end - 1]) + 1 if end else 0
        best[k, d] = min(best.get((k, d), (1 << 30, 0, 0)), (edits, first, last))
    return [(group[d][0], items.ids[k], *v) for (k, d), v in sorted(best.items(), key=lambda x: (x[0][1], x[0][0]))]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    edits: float = EDITS,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the best place of every item in every document that holds it.

    Texts are compared lower-cased, with every run of other characters than letters and
    digits as one space; places are code points of the original. An item is held if a
    part of the text is at most ``edits`` edits per character away, and fewer than the
    item has pieces; items shorter than two pieces must occur unchanged. Null or empty
    items and texts match nothing. Repeated rows are reported once each. The benchmark
    is the stated query set: it is searched in blocks of ``block`` items, each block in
    one pass without a shuffle.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    asked = benchmark.select(F.col("item_id").cast("bigint"), F.col("text")).where("text is not null")
    n_blocks = max(1, math.ceil(asked.count() / block))
    found = None
    for b in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        items = Items(sorted((r[0] if r[0] is not None else -1, r[1]) for r in mine.collect()), edits)
        part = rows.mapInArrow(
            _search(items, edits), "doc_id bigint, item_id bigint, edits bigint, start bigint, end bigint"
        )
        found = part if found is None else found.unionByName(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, all columns unchanged.

    Rows are told apart by their text's hash, so rows with equal or null ids are judged each.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    held = leaks(keyed.select("text_key", "text"), benchmark, "text_key", "text", **options)
    held = held.select(F.col("doc_id").alias("text_key")).distinct()
    return keyed.join(held, "text_key", "left_anti").select("row.*")
