from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from versemill.llm import language_id, toxicity
from versemill.llm.language_id import held_out


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 5, 400).astype(np.uint8)
    keys, _ = language_id._keys(symbols, np.array([0]), 3)
    gram, n = np.unique(keys, return_counts=True)
    table = language_id._table(gram, n, 3)
    for context in (0, 1, 63, 5 << 6 | 2, 63 << 6 | 63):
        every = (context << 6 | np.arange(64)).astype(np.uint32)
        assert np.exp(language_id._log_probability(table, every)).sum() == pytest.approx(1, abs=1e-3)


def test_languages(docs, odd_wide, odd_rows, none):
    model = language_id.fit(docs, ~held_out())
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out())
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count()
    rows = language_id.identify(odd_wide, model).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (0, 1, 2):
            assert r.lang_pred == "und" and r.score == 0
        elif r.doc_id is not None:
            assert r.lang_pred in model.langs
    assert language_id.identify(none, model).count() == 0
    assert language_id.fit(none, ~held_out()) is None
    assert {r.lang_pred for r in language_id.identify(odd_wide, None).collect()} == {"und"}


def test_pairs_are_learned():
    """Label 1 where features 1 and 2 meet, which no additive weights tell from either alone."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(3_000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([7] + [1] * int(a) + [2] * int(b) + list(rng.integers(10, 60, 3))))
        labels.append(int(a and b))
    machine = toxicity.train(rows, np.array(labels), features=64, deviations=3.0, epochs=15)
    odds = machine.odds(np.array([1, 2, 1, 2]), np.array([0, 1, 2, 4]))
    assert odds[0] < -1 and odds[1] < -1 and odds[2] > 1


def test_pairs_of_neutral_features_are_learned():
    """Features 1 and 2 each stand in texts of label 1 as often as others; only together do they tell."""
    rng = np.random.default_rng(3)
    common = 1 / np.arange(1, 2_001)
    common /= common.sum()
    rows, labels = [], []
    for _ in range(16_000):
        u = rng.random()
        a, b = u < 0.1, 0.085 < u < 0.185
        rows.append(np.unique(np.array([1] * a + [2] * b + list(100 + rng.choice(2_000, 20, p=common)))))
        labels.append(int(rng.random() < (0.51 if a and b else 0.032 if a or b else 0.103)))
    labels = np.array(labels)
    for feature in (1, 2):
        assert abs(labels[[feature in r for r in rows]].mean() - labels.mean()) < 0.02
    machine = toxicity.train(rows, labels)

    def mean_score(*told):
        texts = [np.array([*told, *(100 + rng.choice(2_000, 15, replace=False))]) for _ in range(200)]
        return machine.scores(np.concatenate(texts), np.arange(201) * len(texts[0])).mean()

    assert mean_score() < 0.2 and mean_score(1) < 0.2 and mean_score(2) < 0.2 and mean_score(1, 2) > 0.4


def test_scores_are_sums_over_pairs():
    rng = np.random.default_rng(5)
    rows = [rng.choice(90, rng.integers(0, 70), replace=False) for _ in range(300)]
    machine = toxicity.train(rows, rng.integers(0, 2, 300), features=100, epochs=3)
    asked = [*rows[:40], np.array([95, 96, 3]), np.array([], dtype=np.int64)]
    got = machine.odds(np.concatenate(asked).astype(np.int64), np.append(0, np.cumsum([len(r) for r in asked])))
    for r, odds in zip(asked, got, strict=True):
        at = machine.place[r.astype(np.int64)]
        scale = min(1.0, toxicity.TERMS / max(len(r), 1))
        want = machine.bias + sum(machine.weights[i] * machine.values[i] for i in at)
        for x, i in enumerate(at):
            for j in at[:x]:
                want += scale * machine.shares[i] * machine.shares[j] * float(machine.factors[i] @ machine.factors[j])
        assert odds == pytest.approx(want, abs=1e-4)


def test_toxic_documents(spark, sf, odd_wide, odd_rows, none):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    machine = toxicity.fit(docs, labels, ~held_out())
    scored = toxicity.score(docs, machine).join(labels, "doc_id").where(held_out()).withColumn("p", F.col("score") >= 0.3)
    counts = {(r.toxic, r.p): r["count"] for r in scored.groupBy("toxic", "p").count().collect()}
    assert counts.get((1, True), 0) >= 0.5 * (counts.get((1, True), 0) + counts.get((1, False), 0))
    assert counts.get((0, True), 0) <= 0.1 * (counts.get((0, True), 0) + counts.get((0, False), 0))
    rows = toxicity.score(odd_wide, machine).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, machine).count() == 0
    assert toxicity.fit(docs, labels.limit(0), ~held_out()) is None
    assert {r.score for r in toxicity.score(odd_wide, None).collect()} == {0.0}


def test_letters_of_all_planes(spark):
    """Letters beyond the basic plane are letters; emoji there are none."""
    rows = [(1, "\U00020000\U00020001\U00020002"), (2, "\U0001f600 \U0001f601"), (3, "\U0001e922\U0001e923")]
    learn = [(i, "abc def ghi " * 5, "en") for i in range(10, 40)] + [(i, "\U00020000\U00020001 " * 9, "x") for i in range(40, 70)]
    model = language_id.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string"), F.lit(True))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(frame, model).collect()}
    assert got[1] == "x" and got[2] == "und" and got[3] != "und"
