"""Queries over whole texts: summed up inside a text's row, texts of one id taken together."""

from __future__ import annotations

import hashlib
import re

import pytest

import __spark_entry__ as entry
from versemill import bindings as B
from versemill.queries import scalar

TEXTS = [(1, "the known and the other image"), (2, "Image " * 3), (3, ""), (4, None), (5, "ba" * 9000 + " x"), (6, "b" + "a" * 14 + " known")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in TEXTS]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, "known the")], "item_id int, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def words(text):
    return re.findall("[a-z]+", (text or "").lower())


def test_header_counts_inside_a_row(spark, folder):
    df = entry.queries()["v3_header_columns"](spark, folder)
    got = {r.doc_id: (r.n_kept, r.n_duplicates, r.dropped) for r in df.collect()}
    want = {}
    for i, t in TEXTS:
        w, bad = set(words(t)), {"image", "and", "the"}
        if w:
            want[i] = (len(w - bad), len(words(t)) - len(w), ",".join(sorted(w & bad)))
    assert got == want
    assert "posexplode" not in df._jdf.queryExecution().toString()


def test_readings_inside_a_row(spark, folder):
    df = entry.queries()["j22_reading_dictionary"](spark, folder)
    got = {r.doc_id: (r.reading, r.n_known) for r in df.collect()}
    kana = str.maketrans(B.LATIN, B.LATIN_KANA)
    want = {}
    for i, t in TEXTS:
        if words(t):
            read = "".join(w.upper() if len(w) >= 12 else w.translate(kana) if w in ("known", "the") else w for w in words(t))
            want[i] = (hashlib.md5(read.encode()).hexdigest(), sum(w in ("known", "the") for w in words(t)))
    assert got == want
    assert "posexplode" not in df._jdf.queryExecution().toString()


def test_runs_summed_up_by_slice(spark, folder, monkeypatch):
    rows = []
    monkeypatch.setattr(scalar, "scan", lambda df, *a, **k: rows.append(df.count()) or whole(df, *a, **k))
    whole = __import__("versemill.plans.ordered", fromlist=["scan"]).scan
    got = {r.doc_id: (r.n_runs, r.n_kana, r.start_check, r.stop) for r in entry.queries()["f7_script_runs"](spark, folder).collect()}
    want = {}
    for i, t in TEXTS:
        runs = re.findall("[アエイオウ　 ]+|[^アエイオウ　 ]+", (t or "").translate(str.maketrans("aeiou", "アエイオウ")))
        at, check = 0, 0
        for k, r in enumerate(runs, 1):
            check, at = check + at * (k % 7), at + len(r)
        if runs:
            want[i] = (len(runs), sum(r[0] in "アエイオウ　 " for r in runs), check, at)
    assert got == want
    assert rows[0] < 2 * len(TEXTS) + 5
