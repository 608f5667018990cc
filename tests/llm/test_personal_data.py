from __future__ import annotations

import collections
import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versemill.llm import personal_data as pd

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and slow_luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0])]


def base(spans):
    return [s[:3] for s in spans if s.kind in pd.BASE]


PIECES = st.sampled_from(
    "a b_ . @ @b.c x@y.zz 1 22 255 256 . .. - -- ( ) + +1 +49 \x20 \x20\x20 4417744280351547 378282246310005 é 漢 ; c_d 192.168.0.1 iban DE89 3702".split(" ")
)


@given(st.lists(PIECES, max_size=25).map("".join))
@settings(max_examples=3000, deadline=None)
def test_base_spans_equal_plain_patterns(text):
    assert base(pd.spans_of(text)) == brute(text)


def test_checksums():
    assert pd.luhn("4417744280351547") == slow_luhn("4417744280351547")
    for n in range(3000):
        assert pd.luhn(f"{n * 7919:016d}") == slow_luhn(f"{n * 7919:016d}")
    assert pd.mod97("DE89370400440532013000") and pd.mod97("GB82WEST12345698765432")
    assert not pd.mod97("DE88370400440532013000")


def kinds(text):
    return collections.Counter(s.kind for s in pd.spans_of(text))


def test_added_spans_need_a_checksum_or_context():
    assert kinds("pay to DE89 3704 0044 0532 0130 00 PLEASE") == {"iban": 1}
    assert kinds("pay to DE88 3704 0044 0532 0130 00 PLEASE")["iban"] == 0
    assert kinds("number 378282246310005 end") == {}
    assert kinds("my credit card 378282246310005 end") == {"shortcard": 1}
    assert kinds("order card 378282246310005 end") == {}
    assert kinds("SSN: 123-45-6789.") == {} and kinds("SSN: 123-45-6789 ok") == {"ssn": 1}
    assert kinds("ssn 666-45-6789 ok") == {} and kinds("pages 123-45-6789 ok") == {}
    assert kinds("phone (017) 555-7713 now") == {"localphone": 1} and kinds("hotel (017) 555-7713 now") == {}
    assert kinds("call +1 (017) 555-7713 now") == {"phone": 1}


def test_context_moves_the_score():
    score = lambda t: pd.spans_of(t)[0].score
    assert score("version 10.0.0.1") < score("at 10.0.0.1") < score("host 10.0.0.1")
    far = "host" + " x" * 40 + " 10.0.0.1"
    assert score(far) == score("at 10.0.0.1")


def test_scans_are_linear():
    for text in ("a" * 400_000, "a@" * 200_000, "1" * 400_000, "1.1." * 100_000, "1 " * 200_000, "+1" + " " * 400_000, "+1 " * 100_000, "GB82" * 100_000, "a@b.c_" * 60_000, "1.2.3.4 " * 30_000 + "123-45-6789 " * 20_000):
        start = time.perf_counter()
        pd.spans_of(text)
        assert time.perf_counter() - start < 5


def test_rows_and_redaction(spark, docs, odd_wide, odd_rows, none, texts):
    extra = spark.createDataFrame(
        [(1, "mail x.y@z.org, 97.51.17.173 and 4417744280351547"), (2, "é" * 50 + " +1 (974) 555-3436"), (2, None), (None, "é" * 50 + " +1 (974) 555-3436")],
        "doc_id long, text string",
    )
    for frame, count in ((docs, len(texts)), (odd_wide, len(odd_rows)), (none, 0), (extra, 4)):
        got = pd.scan(frame).select("row.*", "found", pd.joined(F.col("found"), True).alias("base_line")).collect()
        assert len(got) == count
        for r in got:
            want = brute(r.text or "")
            assert [tuple(s)[:3] for s in r.found if s.kind in pd.BASE] == want
            assert r.base_line == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
    hidden = pd.redact(extra).collect()
    assert [r.text for r in hidden] == ["mail <EMAIL>, <IP> and <CARD>", "é" * 50 + " <PHONE>", None, "é" * 50 + " <PHONE>"]
    assert pd.redact(odd_wide).columns == odd_wide.columns and pd.redact(none).count() == 0
    clean = {r.doc_id: r.text for r in pd.redact(docs).collect()}
    assert all(clean[i] == t for i, t in texts.items() if not pd.spans_of(t))
    assert not any(brute(t) for t in clean.values())


def test_query_digest(spark, sf, texts):
    from versemill.llm.queries import QUERIES

    for r in QUERIES["op11_personal_data"](spark, sf).collect():
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(line.split(",")) - (line == "")
