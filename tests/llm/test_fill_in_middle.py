from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versemill.llm import fill_in_middle as fim


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.lists(st.text(max_size=30), max_size=8), st.sampled_from(["points", "bytes"]))
@settings(max_examples=200, deadline=None)
def test_index_converts_both_ways(texts, unit):
    joined = "".join(texts)
    data = np.frombuffer(joined.encode(), dtype=np.uint8)
    index = fim.ExceptionIndex(data)
    starts = np.array([len(joined[:i].encode()) for i in range(len(joined) + 1)], dtype=np.int64)
    points = np.arange(len(joined) + 1)
    assert (index.to_bytes(points) == starts).all() and (index.to_points(starts) == points).all()
    for b in range(len(data) + 1):
        assert index.to_points(np.array([b]))[0] == np.searchsorted(starts, b, "right") - 1


def rows_of(frame):
    out = fim.arrange(frame).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    return out.select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()


def test_all_forms_against_brute_force(docs, odd_wide, none, texts, odd_rows):
    for frame, count in ((docs, len(texts)), (odd_wide, len(odd_rows)), (none, 0)):
        got = rows_of(frame)
        assert len(got) == count
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
            assert r.back == (r.text or "")
    assert {r.form for r in rows_of(docs)} == {"plain", "psm", "spm"}


def test_marks_edges_and_groups(spark, monkeypatch):
    """Part marks at cut places, texts that hold a mark, and texts of several groups."""
    texts = ["a<P", "<<S>", "<S", "<M>x", "<P<S<M", "<", "é<", "\U0001f600<P", "<P>", "ab<S>", "x" * 5_000_000, "é" * 3_000_000, ""]
    rows = [(i * 100 + k, t) for i, t in enumerate(texts) for k in range(40 if len(t) < 99 else 1)]
    for r in rows_of(spark.createDataFrame(rows, "doc_id long, text string")):
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == r.text


def test_byte_cuts_stand_between_characters(spark):
    text = "aé漢\U0001f600" * 50
    frame = spark.createDataFrame([(i, text) for i in range(200)], "doc_id long, text string")
    out = fim.arrange(frame, unit="bytes").withColumn("back", fim.restore(F.col("output"), F.col("form")))
    for r in out.collect():
        assert r.back == text and "�" not in r.output
        if r.form != "plain":
            digest = hashlib.sha256(f"1:{r.row.doc_id}".encode()).hexdigest()
            drawn = sorted(int(digest[8 * k : 8 * k + 8], 16) % (len(text.encode()) + 1) for k in range(2))
            whole = [len(text.encode()[:b].decode(errors="ignore")) for b in drawn]
            assert [r.prefix_chars, r.prefix_chars + r.middle_chars] == whole
    with pytest.raises(ValueError):
        fim.arrange(frame, unit="words")
