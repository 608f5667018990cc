from __future__ import annotations

import collections
import zlib

import numpy as np
import pytest

from versemill.llm import packing
from versemill.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_tokenizers(tokenizer, texts, odd_rows):
    encoder = packing.Encoder(tokenizer_path())
    assert encoder.fast
    extra = ["a  b", " a", "a ", "\n", "a \n b", "it's 'll\nx 12é", "<|endoftext|> a", "x\ty z", "x y z"]
    for text in [*texts.values(), *(r[1] or "" for r in odd_rows), *extra]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids


def test_plan_covers_the_histogram():
    rng = np.random.default_rng(1)
    for n in (0, 1, 700, 60_000):
        histogram = np.bincount(rng.integers(1, 1024, n), minlength=1025)
        total = np.zeros_like(histogram)
        for lengths, times in packing.plan(histogram):
            assert sum(lengths) <= 1024
            for v in lengths:
                total[v] += times
        assert (total == histogram).all()


def check(rows, sources, tokenizer):
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.sequence_id].append((r.offset, r.length))
    for held in pieces.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    want = collections.Counter()
    for doc_id, text in sources:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), 1024):
            part = ids[start : start + 1024]
            want[doc_id, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    got = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert got == want
    return sum(r.length for r in rows) / (1024 * len(pieces))


def test_documents(docs, texts, tokenizer):
    assert check(packing.pack(docs, tokenizer_path()).collect(), texts.items(), tokenizer) > 0.95


def test_odd_rows(odd_wide, odd_rows, none, tokenizer):
    check(packing.pack(odd_wide, tokenizer_path()).collect(), [r[:2] for r in odd_rows], tokenizer)
    assert packing.pack(none, tokenizer_path()).count() == 0
