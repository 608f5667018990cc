"""Toxicity by a factorization machine over hashed terms.

A text's terms (its words, and the first letters of longer ones) are hashed to a fixed
number of features. The score is a bias, a weight per feature and, for every pair of
features that occur together, the inner product of their factor vectors; the pairs'
sum needs one pass over the features. So an insult next to a group's name can weigh
more than both alone, which no additive weights express, even where each of them is as
common in texts of label 0. Texts are scored whole, however long; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 20
FACTORS = 4
# Letters of a longer word that make a term of their own.
STEM = 5
# Most labelled texts that are learned from: those with the smallest id hashes, for each label half.
SAMPLE = 16_000
EPOCHS = 8
# Terms up to which a text's pairs count in full.
TERMS = 32
SEED = 7


def term_features(text: Column, features: int = FEATURES) -> Column:
    """Distinct feature numbers of a text: each lower-case word, and the stem of each longer one."""
    words = F.array_distinct(
        F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    )
    hashed = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))
    stems = F.transform(
        F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, STEM))),
        lambda w: F.pmod(F.xxhash64(w, F.lit("stem")), F.lit(features)).cast("int"),
    )
    return F.array_distinct(F.concat(hashed, stems))


def evidence(on: np.ndarray, n: np.ndarray, rate: float, prior: float, deviations: float) -> np.ndarray:
    """Linear value of each feature: its log odds for label 1 beyond the base rate, drawn to zero by ``prior`` pseudo-texts.

    A feature ``z`` standard deviations from the base rate keeps (z^2 / (z^2 + deviations^2))^2 of
    it: what may be chance weighs little, and none is left out.
    """
    value = np.log((on + prior * rate) / (n - on + prior * (1 - rate))) - np.log(rate / (1 - rate))
    z2 = (on - n * rate) ** 2 / (np.maximum(n, 1) * rate * (1 - rate))
    return value * (z2 / (z2 + deviations**2)) ** 2


def _row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, weights=values[:, f], minlength=n) for f in range(values.shape[1])], axis=1)


@dataclass
class Machine:
    """``place`` maps a feature to its row of the other arrays; features that were never seen go to row 0, of zeros.

    ``values`` and ``weights`` make the linear part. A feature enters pairs with its
    ``shares``, near 1 for all but rare ones, whatever it tells alone.
    """

    bias: float
    place: np.ndarray
    values: np.ndarray
    weights: np.ndarray
    shares: np.ndarray
    factors: np.ndarray

    def pair_inputs(self, at: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """What each feature brings to its text's pairs; texts of more than ``TERMS`` terms are scaled to as many."""
        return self.shares[at] * np.sqrt(TERMS / np.maximum(counts, TERMS))[rows]

    def odds(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log odds of rows whose features are ``features[offsets[i]:offsets[i + 1]]``."""
        counts = np.diff(offsets)
        n, rows, at = len(counts), np.repeat(np.arange(len(counts)), counts), self.place[features]
        v = self.factors[at] * self.pair_inputs(at, counts, rows)[:, None]
        pairs = (_row_sums(rows, v, n) ** 2 - _row_sums(rows, v * v, n)).sum(axis=1) / 2
        return self.bias + np.bincount(rows, weights=self.weights[at] * self.values[at], minlength=n) + pairs

    def scores(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(features, offsets), -30, 30)))


def train(
    rows: list[np.ndarray],
    labels: np.ndarray,
    features: int = FEATURES,
    factors: int = FACTORS,
    epochs: int = EPOCHS,
    rate: float = 0.1,
    pair_rate: float = 0.05,
    decay: float = 1e-3,
    pair_decay: float = 1e-2,
    batch: int = 128,
    prior: float = 16.0,
    deviations: float = 4.0,
) -> Machine:
    """Fit by mini-batch steps of the logistic loss with per-coordinate rates (Adagrad).

    Weights start from the evidence itself, so a small sample needs few steps. Every
    feature of the sample has factors, also one that tells nothing alone; they are kept
    small by decay and, for rare features, by their shares.
    """
    rng = np.random.default_rng(SEED)
    counts = np.array([len(r) for r in rows])
    offsets = np.append(0, np.cumsum(counts))
    kept, where = np.unique(np.concatenate(rows), return_inverse=True)
    place = np.zeros(features, dtype=np.int32)
    place[kept] = np.arange(1, len(kept) + 1)
    places, size = (where + 1).astype(np.int32), len(kept) + 1
    base = float(labels.mean())
    seen = np.bincount(places, minlength=size)
    on = np.bincount(places, weights=np.repeat(labels, counts), minlength=size)
    values = evidence(on, seen, base, prior, deviations)
    start = rng.normal(0, 0.1, (size, factors))
    values[0], start[0] = 0, 0
    machine = Machine(float(np.log(base / (1 - base))), place, values, np.ones(size), seen / (seen + prior), start)
    past_w, past_v, past_b = np.full(size, 1e-2), np.full((size, factors), 1e-2), 1e-2
    present, number = np.zeros(size, dtype=bool), np.zeros(size, dtype=np.int64)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            length = counts[some]
            row = np.repeat(np.arange(len(some)), length)
            first = np.append(0, np.cumsum(length))[:-1]
            at = places[np.repeat(offsets[some] - first, length) + np.arange(length.sum())]
            inputs, value = machine.pair_inputs(at, length, row), values[at]
            v = machine.factors[at] * inputs[:, None]
            total = _row_sums(row, v, len(some))
            odds = machine.bias + np.bincount(row, weights=machine.weights[at] * value, minlength=len(some))
            odds += ((total**2).sum(axis=1) - np.bincount(row, weights=(v * v).sum(axis=1), minlength=len(some))) / 2
            error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[some]
            past_b += error.mean() ** 2
            machine.bias -= rate * error.mean() / np.sqrt(past_b)
            if not len(at):
                continue
            present[at] = True
            distinct = np.flatnonzero(present)
            present[distinct] = False
            number[distinct] = np.arange(len(distinct))
            which = number[at]
            slope = np.bincount(which, weights=error[row] * value) + decay * (machine.weights[distinct] - 1)
            past_w[distinct] += slope**2
            machine.weights[distinct] -= rate * slope / np.sqrt(past_w[distinct])
            push = _row_sums(which, (error[row] * inputs)[:, None] * (total[row] - v), len(distinct))
            past_v[distinct] += push**2
            step = pair_rate / np.sqrt(past_v[distinct])
            moved = machine.factors[distinct] - step * push
            machine.factors[distinct] = moved * np.maximum(0, 1 - step * pair_decay)
    machine.factors = machine.factors.astype(np.float32)
    return machine


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
) -> Machine | None:
    """A machine fitted on at most ``sample`` labelled texts, up to half of them of either label.

    ``labels`` has the id and a 0/1 column ``toxic``; null labels and ids without a text
    teach nothing. Which rows are taken follows from hashes of their ids alone. Ids in
    the sample are few enough to be sent to every task (eight bytes each). None if
    there are no rows of both labels.
    """
    named = labels.where(learn & F.col("toxic").isin(0, 1)).select(
        F.col(id_col).cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic")
    )
    named = named.groupBy("id").agg(F.max("toxic").alias("toxic")).where("id is not null")
    halves = [
        named.where(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(sample // 2) for t in (0, 1)
    ]
    chosen = halves[0].unionByName(halves[1])
    share = named.agg(F.avg("toxic")).first()[0]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").select("id", "toxic", term_features(F.col("text")).alias("f"))
    # Repeated ids bring repeated texts: the sample's bound holds for rows, too.
    table = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("f")).limit(sample).toArrow()
    truth = np.array(table.column("toxic").to_pylist())
    if len(truth) == 0 or truth.min() == truth.max():
        return None
    machine = train([np.array(f.as_py(), dtype=np.int64) for f in table.column("f")], truth)
    # The sample holds more of the rarer label than there is; the bias takes that back.
    machine.bias += float(np.log(share / (1 - share)) - np.log(truth.mean() / (1 - truth.mean())))
    return machine


def _scored(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("f")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            scores = machine.scores(flat, offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per input row, the chance that label 1 holds.

    A text without terms, null and empty ones included, gets the bias's score; if
    nothing could be learned every text scores 0.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), term_features(F.col(text_col)).alias("f"))
    if machine is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    return rows.mapInArrow(_scored(machine), "doc_id bigint, score double")
