from __future__ import annotations

import collections

from versemill.llm import suffix_dedup as s


def brute(rows):
    """Word places of each row that lie in a run of 50 words found twice."""
    words = [s.WORD.findall(t or "") for _, t in rows]
    counts = collections.Counter(tuple(w[k : k + 50]) for w in words for k in range(len(w) - 49))
    return [{k + j for k in range(len(w) - 49) if counts[tuple(w[k : k + 50])] > 1 for j in range(50)} for w in words]


def covered(rows, found):
    spans = collections.defaultdict(set)
    for r in found:
        spans[r.doc_id].add((r.start, r.end))
    out = []
    for i, t in rows:
        places = [(m.start(), m.end()) for m in s.WORD.finditer(t or "")]
        out.append({k for k, (a, b) in enumerate(places) for x, y in spans[i] if x <= a and b <= y})
    return out


def test_documents(docs, texts):
    rows = list(texts.items())
    got, want = covered(rows, s.repeated_passages(docs).collect()), brute(rows)
    assert all(g <= w for g, w in zip(got, want, strict=True))
    assert all(bool(g) == bool(w) for g, w in zip(got, want, strict=True))
    assert sum(map(len, got)) >= 0.95 * sum(map(len, want))


def test_planted_passages(spark):
    passage = " ".join(f"wörd{i * i % 89}x{i}" for i in range(51))
    rows = [(i, " ".join(f"own{i}n{j}" for j in range(i * 3)) + f"\n{passage}\t" + " ".join(f"rest{i}n{j}" for j in range(40))) for i in range(1, 9)]
    rows += [(20, " ".join(f"only{j}" for j in range(200))), (21, " ".join(passage.split()[:49]))]
    found = s.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == list(range(1, 9))
    assert all(dict(rows)[r.doc_id][r.start : r.end] == passage and r.n_words == 51 and r.first_doc_id in range(1, 9) for r in found)


def test_odd_rows(odd_wide, none):
    found = s.repeated_passages(odd_wide).collect()
    assert {r.doc_id for r in found} <= {10, 11} and {10, 11} <= {r.doc_id for r in found}
    assert s.repeated_passages(none).count() == 0


def test_one_of_many_holders_names_itself(spark):
    passage = " ".join(f"hot{i * i % 97}x{i}" for i in range(60))
    ids = [7_919 * k % 3_001 for k in range(1, 1_501)]
    rows = [(i, " ".join(f"a{i}n{j}" for j in range(20)) + f" {passage} " + " ".join(f"b{i}n{j}" for j in range(20))) for i in ids]
    found = s.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == sorted(ids)
    least, second = sorted(ids)[:2]
    assert all((r.first_doc_id, r.other_doc_id) == (least, second if r.doc_id == least else least) for r in found)


def test_nothing_is_left_out_behind_a_frequent_beginning(spark):
    """Passages of 50 words and more that only two texts share, behind 49 words of many texts."""
    rows = []
    own = lambda k, n: [f"w{len(rows)}n{k}n{j}" for j in range(n)]
    for h in range(8):
        head = [f"head{h}i{i * i % 83}x{i}" for i in range(49)]
        rows += [(len(rows) + k, " ".join([f"a{h}k{k}n{j}" for j in range(12)] + head + [f"b{h}k{k}n{j}" for j in range(30)])) for k in range(140)]
        for k in range(10):
            right = [f"r{h}k{k}n{j}" for j in range(3)]
            for _ in range(2):
                rows.append((10_000 * (h + 1) + 2 * k + len(rows) % 2, " ".join(own(0, 12) + head + right + own(1, 30))))
    # Runs of one word of different lengths before the same words.
    for w in range(12):
        tail = [f"tail{w}n{j}" for j in range(30)]
        for n in (30, 41, 43, 75):
            rows.append((1_000_000 + len(rows), " ".join(own(2, 3) + [f"same{w}"] * n + tail + own(3, 1))))
    found = s.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert sum(map(bool, want)) == 160 + 48
    assert covered(rows, found) == want
    pairs = [r for r in found if 10_000 <= r.doc_id < 1_000_000]
    assert len(pairs) == 160 and all((r.n_words, r.other_doc_id) == (52, r.doc_id ^ 1) for r in pairs)
