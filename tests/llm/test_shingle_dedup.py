from __future__ import annotations

import itertools
import random
import re

import corpus_pipeline
from versemill.llm import shingle_dedup


def shingles(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def brute(rows):
    """Smallest id of each row's component; exact similarities of all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        x, y = sets[i], sets[j]
        if x == y or (min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 10 * len(x & y) >= 8 * len(x | y)):
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted((str(rows[i][0]), str(least[find(i)])) for i in range(len(rows)))


def result(df):
    return sorted((str(r.doc_id), str(r.component_id)) for r in df.collect())


def test_documents_and_odd_rows(docs, texts, odd_wide, odd_rows, none):
    assert result(shingle_dedup.near_duplicates(docs)) == brute(list(texts.items()))
    assert result(shingle_dedup.near_duplicates(odd_wide)) == brute([r[:2] for r in odd_rows])
    assert shingle_dedup.keep_one(odd_wide).columns == odd_wide.columns
    assert shingle_dedup.near_duplicates(none).count() == 0 and shingle_dedup.keep_one(none).count() == 0


def test_stage_removes_edited_copies(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(3_000)}" for _ in range(300)]
        rows.append((2 * k, " ".join(words)))
        # Five changed words: 25 of 296 shingles at most, a similarity of 0.84 or more.
        for at in rng.sample(range(300), 5):
            words[at] = "other"
        rows.append((2 * k + 1, " ".join(words)))
    # One large group of near copies.
    base = [f"v{i}" for i in range(200)]
    rows += [(1_000 + k, " ".join(base[:k] + [f"new{k}"] + base[k:])) for k in range(150)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 120, 2), 1_000]


def test_pairs_within_a_template(spark):
    """Texts that share most of their words but are not similar, and pairs among them that are."""
    rng = random.Random(2)
    common = [f"c{i}" for i in range(243)]
    own = lambda: [f"o{rng.randrange(10**9)}" for _ in range(36)]
    rows, pairs = [(k, " ".join(common + own())) for k in range(1_100)], 100
    for k in range(pairs):
        first = own()
        rows.append((10_000 + 2 * k, " ".join(common + first)))
        rows.append((10_001 + 2 * k, " ".join(common + first[:6] + own()[:30])))
    x, y = shingles(rows[-1][1]), shingles(rows[-2][1])
    assert 0.8 <= len(x & y) / len(x | y) < 0.84
    found = {r.doc_id: r.component_id for r in shingle_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[10_001 + 2 * k] == 10_000 + 2 * k for k in range(pairs))
    assert all(found[k] == k for k in range(1_100))


def test_fingerprints_take_part(spark, monkeypatch):
    """Without pairs met by minima, covering tables of fingerprints alone join long texts that differ in a word."""
    rng = random.Random(4)
    rows = []
    for k in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(6_000)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:3_000], "other", *words[3_001:]]))]
    nodes = spark.createDataFrame([(k, p) for k, p in enumerate([0, 1, 3, 7, 1 << 62, 1 << 62])], "set_key long, print long")
    assert sorted(tuple(r) for r in shingle_dedup.fingerprint_pairs(nodes).select("a", "b").collect()) == [
        (0, 1), (0, 2), (0, 4), (1, 2), (1, 3), (1, 4), (2, 3), (4, 5)
    ]
    with monkeypatch.context() as m:
        m.setattr(shingle_dedup, "candidates", lambda nodes, sets_of: nodes.selectExpr("set_key a", "set_key b", "0 n").limit(0))
        alone = result(shingle_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    joined = sum(i != c for i, c in alone)
    assert joined >= 9
    assert result(shingle_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_links_inside_a_crowd(spark, monkeypatch):
    """Every shingle is in many sets and most pairs of sets are nearly similar: none of the similar ones is lost."""
    rng = random.Random(5)
    base, other = ([[f"{side}{p}x{i}" for i in range(10)] for p in range(24)] for side in "ab")
    patterns = set()
    while len(patterns) < 600:
        patterns.add(frozenset(rng.sample(range(24), rng.choice([3, 4]))))
    rows = [(k, " ".join(w for p in range(24) for w in (other if p in s else base)[p])) for k, s in enumerate(sorted(patterns, key=sorted))]
    want = brute(rows)
    assert 20 < len({c for _, c in want}) < 450
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(shingle_dedup, "BLOCK", 12_000)
    assert result(shingle_dedup.near_duplicates(frame)) == want
