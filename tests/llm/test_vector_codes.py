from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from versemill.llm import vector_codes as vc
from versemill.llm.queries import QUERIES


def brute(vectors, parts=16, entries=64, rounds=2):
    """Codes, errors and codebooks by comparing every part with every entry."""
    x = np.floor(np.array([v for _, v in vectors], dtype=np.float64) * 256).astype(np.int64)
    x = x.reshape(len(x), parts, -1)
    order = sorted(range(len(x)), key=lambda i: (vectors[i][0] is None, vectors[i][0] or 0, x[i].ravel().tolist()))
    book = x[order[:entries]].transpose(1, 0, 2).copy()
    for t in range(rounds + 1):
        d = ((x[:, :, None, :] - book[None]) ** 2).sum(-1)
        code = d.argmin(2)
        if t == rounds:
            return code, d.min(2).sum(1), book
        for p in range(parts):
            for e in range(book.shape[1]):
                mine = x[code[:, p] == e, p]
                if len(mine):
                    book[p, e] = mine.sum(0) // len(mine)


def check(rows, books, vectors, **options):
    code, error, want = brute(vectors, **options)
    assert (books == want).all()
    got = sorted((str(r.carry.vec_id), r.x, bytes(r.code), r.error) for r in rows.collect())
    x = [[math.floor(float(c) * 256) for c in v] for _, v in vectors]
    exact = sorted(
        (str(v[0]), x[i], bytes(code[i].astype(np.uint8)), int(error[i])) for i, v in enumerate(vectors)
    )
    assert got == exact


def test_given_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows, books = vc.compress(frame)
    check(rows, books, [(r.vec_id, r.embedding) for r in frame.collect()])
    measured = rows.agg(F.avg("measured")).first()[0]
    assert measured < 0.8 * vc.PARTS * vc.ENTRIES


def frame_of(spark, vectors):
    rows = [(i, v, i, i, i) for i, v in vectors]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x long, code long, carry long")


@pytest.mark.parametrize("rounds", [1, 2, 6])
def test_ties_repeats_and_few_values(spark, rounds):
    """Few different components: equal distances everywhere, entries without parts, repeated ids and null ids."""
    rng = np.random.default_rng(rounds)
    vectors = [(int(i) % 300 if i % 50 else None, [float(v) for v in rng.integers(-2, 3, 8) / 256]) for i in range(700)]
    rows, books = vc.compress(frame_of(spark, vectors).repartition(5), parts=4, entries=16, rounds=rounds, groups=3)
    check(rows, books, vectors, parts=4, entries=16, rounds=rounds)


@pytest.mark.parametrize("size", [1.0, 3e4, 2e5])
def test_bounds_over_many_rounds(spark, size):
    """Clusters whose entries wander; large components leave real-number arithmetic."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 8)) * size
    vectors = [(i, [float(np.float32(v)) for v in centres[rng.integers(9)] + rng.normal(size=8) * size / 9]) for i in range(600)]
    rows, books = vc.compress(frame_of(spark, vectors), parts=2, entries=32, rounds=7, groups=5)
    check(rows, books, vectors, parts=2, entries=32, rounds=7)


def test_unusable_rows_and_edges(spark):
    good = [(i, [i / 7.0] * 16) for i in range(5)]
    bad = [(10, None), (11, [None] * 16), (12, [float("nan")] * 16), (13, [float("inf")] * 16), (14, [-float("inf")] + [0.0] * 15), (15, []), (16, [1.0] * 3)]
    rows, books = vc.compress(frame_of(spark, good + bad))
    check(rows, books, [(i, np.array(v, np.float32)) for i, v in good])
    assert books.shape == (16, 5, 1)
    for none in (frame_of(spark, bad), frame_of(spark, [])):
        rows, books = vc.compress(none)
        assert rows.count() == 0 and books.size == 0
    with pytest.raises(Exception, match="too large"):
        vc.compress(frame_of(spark, [(1, [6e6] * 16), (2, [-6e6] * 16)]))[0].count()


def test_decoding(spark):
    vectors = [(i, [float(np.float32(v)) for v in np.random.default_rng(i).normal(size=16)]) for i in range(40)]
    rows, books = vc.compress(frame_of(spark, vectors), rounds=1)
    by_id = dict(vectors)
    for r in rows.select("carry.vec_id", vc.decode(F.col("code"), books).alias("v")).collect():
        assert max(abs(a - b) for a, b in zip(r.v, by_id[r.vec_id], strict=True)) <= 0.5 / 256 + 1e-9


def test_query(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    code, error, books = brute([(r.vec_id, r.embedding) for r in frame])
    by_label = {}
    for r, e in zip(frame, error):
        by_label[r.label] = by_label.get(r.label, 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    want = {r.vec_id: ("".join(f"{c:02x}" for c in code[i]), int(error[i]), by_label[r.label], digest) for i, r in enumerate(frame)}
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in QUERIES["op12_vector_codes"](spark, sf).collect()}
    assert got == want
