from __future__ import annotations

import random

import pytest

from versemill.llm import decontaminate as d


def plain(text):
    symbols, _ = d._symbols(text or "")
    return "".join(map(chr, symbols)).strip()


def least_edits(item, text):
    """Least edit distance of ``item`` to a part of ``text``, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def items(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "q", text[at] + "z"]) + text[at + 1 :]
    return text


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(60):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 70)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 90)))
        assert d.edit_end(item, text)[0] == least_edits(item, text)


def test_planted_edits_are_found(spark, items, docs):
    rng = random.Random(2)
    clean = [r.text for r in docs.limit(60).collect()]
    rows, want = [], set()
    for k, r in enumerate(items.collect()):
        n = int(len(plain(r.text)) * (k % 5) / 50)
        host = clean[k % len(clean)]
        cut = rng.randrange(len(host))
        rows.append((k, f"{host[:cut]} {edited(rng, r.text, n).upper() if k % 2 else edited(rng, r.text, n)} {host[cut:]}"))
        want.add((k, r.item_id))
    found = d.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(want & got) >= 0.95 * len(want)
    texts = dict(rows)
    item = {r.item_id: plain(r.text) for r in items.collect()}
    for r in found:
        part = plain(texts[r.doc_id][r.start : r.end])
        assert least_edits(item[r.item_id], part) == r.edits <= len(item[r.item_id]) * d.EDITS


def test_documents_against_brute_force(items, docs, texts):
    got = {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()}
    held = {(i, r.item_id) for r in items.collect() for i, t in texts.items() if plain(r.text) in plain(t)}
    assert held <= got
    item = {r.item_id: plain(r.text) for r in items.collect()}
    assert all(least_edits(item[k], plain(texts[i])) <= len(item[k]) * d.EDITS for i, k in got - held)


def test_blocks_give_the_same(items, docs):
    whole, parts = (sorted(map(tuple, d.leaks(docs, items, block=b).collect())) for b in (1_000, 7))
    assert whole == parts


def test_odd_rows(spark, items, odd_wide, odd_rows, none):
    bench = spark.createDataFrame(
        [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "Ein Text mit WÖRTERN und noch einigen Wörtern mehr")],
        "item_id long, text string",
    )
    got = sorted((str(r.doc_id), r.item_id) for r in d.leaks(odd_wide, bench).collect())
    assert got == [("3", 4), ("4", 4), ("5", 5), ("5", 5), ("6", 5), ("None", 4)]
    kept = d.keep_clean(odd_wide, bench)
    assert kept.columns == odd_wide.columns and kept.count() == len(odd_rows) - len(got)
    assert d.leaks(none, items).count() == 0 and d.keep_clean(none, items).count() == 0
    assert d.leaks(odd_wide, bench.limit(0)).count() == 0


def test_items_that_lack_their_first_characters(spark, items):
    rows, want = [(-1, "An unrelated text stands before them.")], set()
    for r in items.collect():
        item = plain(r.text)
        allowed = min(int(len(item) * d.EDITS), len(item) // d.PIECE - 1)
        for n in {1, allowed, item.find(" ") + 1}:
            if n and len(item) - len(plain(item[n:])) <= allowed:
                want.add((len(rows), r.item_id))
                rows.append((len(rows), item[n:]))
    assert want
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 5):
        found = {(r.doc_id, r.item_id) for r in d.leaks(frame.repartition(parts, "doc_id"), items).collect()}
        assert want <= found
        assert not d.keep_clean(frame, items).where("doc_id >= 0").count()
