from __future__ import annotations

import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from versemill.llm import simhash


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((str(rows[i][0]), f"{prints[i]:016x}", str(least[find(i)])) for i in range(len(rows))))


def least_ids(rows):
    """The smallest id of every component, one for each component."""
    prints = [fingerprint(t) for _, t in rows]
    open_, found = set(range(len(rows))), []
    while open_:
        group = [open_.pop()]
        for i in group:
            near = {j for j in open_ if (prints[i] ^ prints[j]).bit_count() <= 2}
            open_ -= near
            group += near
        found.append(str(min((rows[i][0] for i in group if rows[i][0] is not None), default=None)))
    return sorted(found)


def result(df):
    found = df.select("doc_id", simhash.hexadecimal(F.col("print")).alias("p"), "component_id").collect()
    return sorted((str(r.doc_id), r.p, str(r.component_id)) for r in found)


@pytest.mark.parametrize("radius", [1, 2])
def test_masks_cover(radius):
    for bits in itertools.combinations(range(64), radius):
        assert any(all(not m >> b & 1 for b in bits) for m in simhash.masks(radius))


def test_odd_rows(odd_wide, odd_rows):
    assert result(simhash.near_duplicates(odd_wide)) == brute([r[:2] for r in odd_rows])


def test_documents(docs, texts):
    assert result(simhash.near_duplicates(docs)) == brute(list(texts.items()))


def test_no_rows(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("bucket", [1, 32])
def test_large_buckets_lose_no_link(spark, bucket):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(5)]
    values = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(30)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "print long"), bucket=bucket)
    found = {r.node: r.root for r in simhash.components(links, "a", "b").collect()}
    root = {v: v for v in values}
    for _ in values:
        for a, b in itertools.combinations(values, 2):
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
        if all(root[a] == root[b] for a, b in itertools.combinations(values, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2):
            break
    assert {v: found.get(v, v) for v in values} == root


def test_one_of_each_component_stays(odd_wide, odd_rows):
    kept = simhash.keep_one(odd_wide)
    assert kept.columns == odd_wide.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == least_ids([r[:2] for r in odd_rows])
