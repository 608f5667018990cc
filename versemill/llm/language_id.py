"""Language identification by interpolated Kneser-Ney character models.

Texts become runs of letter classes with one boundary between words. Spark counts the
n-grams of the highest order over all training texts, one count per language; lower
orders are continuation counts derived from those. Each language's probabilities live
in arrays sorted by n-gram key and are found by binary search. A text takes the language of lowest
cross-entropy per symbol; a confidence and a rejection limit are calibrated on texts
left out of the counts.

There are 64 classes (boundary, a-z, and 37 that other letters are hashed to), so an
n-gram of order four is a 24-bit key, and however large the corpus, the tables sent to
the tasks have at most 64 ** order entries per language.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASS_BITS = 6
ORDER = 4
DISCOUNT = 0.75
# One training text in this many calibrates instead of being counted, at most CALIBRATE in all.
LEFT_OUT = 64
CALIBRATE = 20_000
# Share of calibration texts of a language whose cross-entropy is beyond its rejection limit.
REJECT = 0.001
# Characters of text worked on at a time.
CHUNK = 1 << 20


@cache
def _classes() -> np.ndarray:
    """Code point to class: 0 for other than letters, a-z, then hashed classes of other letters."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for i in range(len(table)):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[i] = low - 96 if 97 <= low <= 122 else 27 + (low * 0x9E3779B1 >> 7) % 37
    return table


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts one after the other, each begun and ended by a boundary, and where each text begins."""
    table = _classes()
    codes = [np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    sizes = np.array([len(c) for c in codes])
    flat = table[np.concatenate(codes)]
    begins = np.zeros(len(flat), dtype=bool)
    begins[np.cumsum(np.append(0, sizes))[:-1]] = True
    keep = (flat != 0) | begins
    keep[1:] |= flat[:-1] != 0
    kept = np.cumsum(keep)
    return flat[keep], (kept[np.flatnonzero(begins)] - 1)


def _keys(symbols: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram key that ends at each symbol after a text's first, and that symbol's text number."""
    key = symbols.astype(np.uint32)
    step = symbols.astype(np.uint32)
    text = np.zeros(len(symbols), dtype=np.int64)
    text[starts[1:]] = 1
    text = np.cumsum(text)
    for back in range(1, order):
        before = np.zeros_like(step)
        before[back:] = step[:-back]
        before[np.arange(len(step)) - starts[text] < back] = 0
        key = key | before << np.uint32(CLASS_BITS * back)
    first = np.zeros(len(symbols), dtype=bool)
    first[starts] = True
    return key[~first], text[~first]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of stretches of a batch with about ``CHUNK`` characters."""
    first, texts, size = 0, [], 0
    for row, text in enumerate(batch.column("text")):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK:
            yield first, texts
            first, texts, size = row + 1, [], 0
    if texts:
        yield first, texts


# Parts of counts that a task gathers before it sums them up.
GATHERED = 8


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in _groups(batch):
                keys, text = _keys(*_symbols(texts), order)
                names = np.array(langs[first : first + len(texts)])
                for lang in sorted(set(names.tolist())):
                    parts = total.setdefault(lang, [])
                    parts.append(np.unique(keys[(names == lang)[text]], return_counts=True))
                    if len(parts) > GATHERED:
                        parts[:] = [_summed(parts)]
        for lang, parts in total.items():
            seen, counts = _summed(parts)
            for low in range(0, len(seen), 1 << 16):
                part = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen[part])), pa.array(seen[part].astype(np.int64)), pa.array(counts[part])],
                    ["lang", "key", "n"],
                )

    return run


@dataclass
class Table:
    """Interpolated log probabilities of one language: sorted keys and values for each order."""

    keys: list[np.ndarray]
    values: list[np.ndarray]
    backoff: list[np.ndarray]
    contexts: list[np.ndarray]


def _table(keys: np.ndarray, counts: np.ndarray, order: int) -> Table:
    """Kneser-Ney probabilities of all seen n-grams of all orders and the weight each context gives the lower order."""
    mask = lambda n: np.uint32((1 << (CLASS_BITS * n)) - 1)
    grams, numbers = [keys.astype(np.uint32)], [counts.astype(float)]
    for n in range(order - 1, 0, -1):
        # How many different symbols stand before each shorter gram.
        shorter, seen = np.unique(grams[0] & mask(n), return_counts=True)
        grams.insert(0, shorter)
        numbers.insert(0, seen.astype(float))
    probability, weights, contexts = [], [], []
    lower = np.full(1, 1.0 / (1 << CLASS_BITS))
    for n in range(1, order + 1):
        gram, number = grams[n - 1], numbers[n - 1]
        context, where = np.unique(gram >> np.uint32(CLASS_BITS), return_inverse=True)
        total = np.bincount(where, weights=number)
        kinds = np.bincount(where)
        weight = DISCOUNT * kinds / total
        if n == 1:
            below = np.broadcast_to(lower, len(gram))
        else:
            below = probability[-1][np.searchsorted(grams[n - 2], gram & mask(n - 1))]
        probability.append(np.maximum(number - DISCOUNT, 0) / total[where] + weight[where] * below)
        weights.append(weight)
        contexts.append(context)
    return Table(
        grams,
        [np.log(p).astype(np.float32) for p in probability],
        [np.log(w).astype(np.float32) for w in weights],
        contexts,
    )


def _log_probability(table: Table, keys: np.ndarray) -> np.ndarray:
    """Log probability of each key's last symbol after the others: the longest seen gram, then down by context weights."""
    order = len(table.keys)
    result = np.zeros(len(keys), dtype=np.float32)
    open_ = np.ones(len(keys), dtype=bool)
    for n in range(order, 0, -1):
        gram = keys & np.uint32((1 << (CLASS_BITS * n)) - 1)
        at = np.minimum(np.searchsorted(table.keys[n - 1], gram), len(table.keys[n - 1]) - 1)
        seen = open_ & (table.keys[n - 1][at] == gram)
        result[seen] += table.values[n - 1][at[seen]]
        open_ &= ~seen
        context = gram >> np.uint32(CLASS_BITS)
        at = np.minimum(np.searchsorted(table.contexts[n - 1], context), len(table.contexts[n - 1]) - 1)
        known = open_ & (table.contexts[n - 1][at] == context)
        result[known] += table.backoff[n - 1][at[known]]
    result[open_] += np.float32(-np.log(1 << CLASS_BITS))
    return result


@dataclass
class Model:
    """Tables by language, the confidence's steepness and each language's rejection limit."""

    langs: list[str]
    tables: list[Table]
    order: int
    steepness: float = 20.0
    limits: tuple[float, ...] = ()

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (texts by languages), and the number of letters of each text."""
        symbols, starts = _symbols(texts)
        letters = np.add.reduceat((symbols != 0).astype(np.int64), starts)
        keys, text = _keys(symbols, starts, self.order)
        seen = np.zeros(1 << (CLASS_BITS * self.order), dtype=bool)
        seen[keys] = True
        distinct = np.flatnonzero(seen).astype(np.uint32)
        place = np.zeros(len(seen), dtype=np.int32)
        place[distinct] = np.arange(len(distinct), dtype=np.int32)
        which = place[keys]
        n = np.maximum(np.bincount(text, minlength=len(texts)), 1)
        sums = [
            np.bincount(text, weights=_log_probability(t, distinct)[which], minlength=len(texts)) for t in self.tables
        ]
        return -np.stack(sums, axis=1) / n[:, None], letters

    def confidence(self, entropies: np.ndarray) -> np.ndarray:
        scaled = -self.steepness * entropies
        scaled -= scaled.max(axis=1, keepdims=True)
        odds = np.exp(scaled)
        return odds / odds.sum(axis=1, keepdims=True)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _groups(batch):
                entropies, letters = model.entropies(texts)
                best = entropies.argmin(axis=1)
                score = model.confidence(entropies)[np.arange(len(texts)), best]
                lowest = entropies[np.arange(len(texts)), best]
                none = letters == 0
                limits = np.array(model.limits)[best]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)),
                        pa.array(["und" if e else model.langs[b] for b, e in zip(best, none, strict=True)]),
                        pa.array(np.where(none, 0.0, score)),
                        pa.array(np.where(none, np.nan, lowest)),
                        pa.array(none | (lowest > limits)),
                    ],
                    ["doc_id", "lang_pred", "score", "entropy", "rejected"],
                )

    return run


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> Model | None:
    """A model of the rows where ``learn`` holds and the language is not null; None if there are none.

    All of them are counted but one in ``LEFT_OUT`` by text hash, which calibrate: at
    most ``CALIBRATE``, those with the smallest hashes. Counts are summed by language
    and key in Spark; only sums, at most 64 ** order a language, reach the driver.
    """
    if not 2 <= order <= 4:
        raise ValueError("order is 2 to 4")
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    aside = F.pmod(F.xxhash64("text"), F.lit(LEFT_OUT)) == 0
    counted = rows.where(~aside).mapInArrow(_count(order), "lang string, key bigint, n bigint")
    sums = counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lang", F.floor(F.col("key") / 65_536).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("key", "n"))).alias("c")
    )
    arrays = found.orderBy("lang", "part").select("lang", "c.key", "c.n").toArrow()
    by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang, keys, n in zip(*(arrays.column(i) for i in range(3)), strict=True):
        by.setdefault(lang.as_py(), []).append((keys.values.to_numpy(), n.values.to_numpy()))
    if not by:
        return None
    langs = sorted(by)
    tables = [_table(np.concatenate([k for k, _ in by[x]]), np.concatenate([n for _, n in by[x]]), order) for x in langs]
    model = Model(langs, tables, order, limits=tuple([np.inf] * len(langs)))
    kept = rows.where(aside).orderBy(F.xxhash64("text", F.lit(1)), "text", "lang").limit(CALIBRATE)
    return _calibrated(model, kept)


def _calibrated(model: Model, rows: DataFrame) -> Model:
    """Set the steepness of largest likelihood, and limits at the upper tail of right answers' cross-entropy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _groups(batch):
                entropies, letters = model.entropies(texts)
                langs = batch.column("lang").slice(first, len(texts))
                rows_ = pa.array(entropies.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([langs, rows_, pa.array(letters)], ["lang", "e", "letters"])

    found = rows.mapInArrow(run, "lang string, e array<double>, letters bigint").where("letters > 0").toArrow()
    if not found.num_rows:
        return model
    entropies = np.array(found.column("e").to_pylist())
    known = {lang: k for k, lang in enumerate(model.langs)}
    truth = np.array([known.get(x, -1) for x in found.column("lang").to_pylist()])
    entropies, truth = entropies[truth >= 0], truth[truth >= 0]
    everyone = np.arange(len(truth))

    def loss(steepness: float) -> float:
        chance = Model(model.langs, [], model.order, steepness).confidence(entropies)[everyone, truth]
        return -np.log(np.maximum(chance, 1e-12)).mean()

    model.steepness = min(np.geomspace(1, 100, 25), key=loss) if len(truth) else model.steepness
    right = entropies.argmin(axis=1) == truth
    limits = []
    for k in range(len(model.langs)):
        mine = entropies[right & (truth == k), k]
        limits.append(float(np.quantile(mine, 1 - REJECT)) * 1.25 if len(mine) else np.inf)
    model.limits = tuple(limits)
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, entropy and whether the text was rejected.

    A text without a letter, null and empty ones included, is ``und`` with score 0; so
    is every text if nothing could be learned. Ties take the first language by name. A
    rejected text keeps its best language: its cross-entropy is beyond the tail of that
    language's calibration texts.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.selectExpr(
            "doc_id", "'und' AS lang_pred", "0D AS score", "cast('NaN' as double) AS entropy", "true AS rejected"
        )
    return rows.mapInArrow(
        _scored(model), "doc_id bigint, lang_pred string, score double, entropy double, rejected boolean"
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: its id's CRC-32 leaves 2 when divided by 4. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
