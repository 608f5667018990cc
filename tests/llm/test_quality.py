from __future__ import annotations

import collections
import math
import re
import time

import regex
import xxhash

from versemill.llm import quality


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) for k in range(5) if windows[tuple(words[i : i + 5])] > 1}
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def buckets(text):
    size = quality.BUCKETS
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    single = [signed(xxhash.xxh64_intdigest(g.encode(), 42)) % size for g in regex.findall(quality.GRAM, text or "")]

    def pair(a, b):
        first = xxhash.xxh64_intdigest(a.to_bytes(4, "little"), 42)
        return signed(xxhash.xxh64_intdigest(b.to_bytes(4, "little"), first)) % size

    return single + [pair(a, b) for a, b in zip(single, single[1:])]


def test_rules_and_ratio(spark, docs, sf, odd, odd_wide, odd_rows, texts):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target = collections.Counter(), collections.Counter()
    grams = {i: buckets(t) for i, t in texts.items()}
    for i, g in grams.items():
        raw.update(g)
        if i in trusted:
            target.update(g)
    size = quality.BUCKETS
    totals = sum(target.values()) + size, sum(raw.values()) + size
    weight = [
        round(1000 * (math.log((target[b] + 1) / totals[0]) - math.log((raw[b] + 1) / totals[1]))) for b in range(size)
    ]
    weights = quality.fit_ratio(docs, labels.where("quality = 1"))
    found = [int(w) for w in weights.split(",")]
    assert max(abs(a - b) for a, b in zip(found, weight, strict=True)) <= 1
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for frame, rows in ((docs, list(texts.items())), (odd_wide, [r[:2] for r in odd_rows])):
        got = quality.assess(frame, weights).select("row.doc_id", "row.text", *names, "kept").collect()
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r[n] for n in names) == rules(r.text)
            g = buckets(r.text)
            assert r.kept == (not r.base_failed and sum(found[b] for b in g) >= quality.THRESHOLD * len(g))


def test_filter_keeps_columns_and_rows(spark, sf, docs, odd_wide, none):
    trusted = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    kept = quality.keep_good(docs, trusted)
    weights = quality.fit_ratio(docs, trusted)
    want = quality.assess(docs, weights).select("row.doc_id", "kept").collect()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want if r.kept)
    assert quality.keep_good(odd_wide, trusted).columns == odd_wide.columns
    assert quality.keep_good(none, trusted).count() == 0


def test_clean_labelled_documents_stay(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.assess(docs, quality.fit_ratio(docs, labels.where("quality = 1")))
    rows = rows.select("row.doc_id", "base_failed", "kept").join(labels, "doc_id")
    assert rows.where("quality = 1 and not base_failed and not kept").count() == 0
    assert rows.where("quality = 0 and kept").count() <= 1


def test_all_trusted_documents_count(spark):
    """More trusted ids than were once sent to the tasks; trusting every document makes all ratios zero."""
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('w', id % 5000) AS text")
    trusted = docs.select("doc_id")
    assert set(quality.fit_ratio(docs, trusted).split(",")) == {"0"}


def test_filters_on_every_output_column(docs):
    """A filter on a count or the verdict must not multiply the expressions behind it."""
    rows = quality.assess(docs, ",".join(["1"] * quality.BUCKETS))
    conditions = ["n_words > 9", "word_chars > 9", "n_symbols = 0", "n_dup_lines = 0", "n_repeat_words = 0"]
    conditions += ["base_failed", "not base_failed and not kept", "kept", "score >= 0", "row.doc_id > 5", "row.text like '%a%'"]
    whole = rows.select("row.doc_id", "row.text", "row", *rows.columns[1:]).drop("row").toPandas()
    for condition in conditions:
        start = time.perf_counter()
        found = rows.where(condition).count()
        assert time.perf_counter() - start < 20
        plain = condition.replace("row.", "")
        if "like" not in condition:
            want = whole.query(plain.replace(" = ", " == "))
            assert found == len(want)


def test_trusted_ids_beyond_the_filter(spark, monkeypatch):
    """Filters of all densities, and too many strays, give the counts of an exact join."""
    docs = spark.range(4_000).selectExpr("if(id % 40 = 0, null, id) AS doc_id", "concat('w', id % 97, ' x', id % 11) AS text")
    trusted = spark.range(9_000).selectExpr("id * 3 AS doc_id").unionByName(spark.sql("SELECT CAST(null AS BIGINT) AS doc_id"))
    ones = trusted.where("doc_id is not null").selectExpr("doc_id AS id", "1 AS target")
    rows = docs.selectExpr("doc_id AS id", "text").join(ones, "id", "left").na.fill(0, ["target"])
    want = sorted(map(tuple, quality._gram_counts(rows, 256).collect()))
    for bits, strays in ((64, 100), (16, 2_000), (1, 4_000), (1, 5)):
        monkeypatch.setattr(quality, "FILTER_BITS", bits)
        monkeypatch.setattr(quality, "STRAYS", strays)
        got = quality.trusted_counts(docs, trusted, "doc_id", "text", 256)
        assert sorted(map(tuple, got.select("bucket", "raw", "target").collect())) == want
