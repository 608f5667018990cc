from __future__ import annotations

import hashlib
import re

from versemill.llm import secret_scan

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)


def base(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(spans, key=lambda s: (s[1], order.index(s[0])))


def check(rows):
    for r in rows:
        spans = base(r.text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in spans) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_base_spans(odd_wide, odd_rows, docs, texts, none):
    for frame, rows in ((docs, list(texts.items())), (odd_wide, odd_rows)):
        got = secret_scan.scan(frame)
        assert got.count() == len(rows)
        keyed = frame.select("doc_id", "text").distinct()
        check(keyed.join(got, keyed["doc_id"].eqNullSafe(got["doc_id"])).where(keyed["doc_id"].isNotNull() & (keyed["doc_id"] != 3)).collect())
    assert secret_scan.scan(none).count() == 0


def test_many_and_adjacent_matches(spark):
    text = "secret=token:abcdefgh TOKEN: 'x' " + " ".join(f"é api_key=value{i:05d}" for i in range(700))
    text += " " + "0123456789abcdef" * 2 + "g" + "0123456789abcdef" * 4
    rows = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    got = secret_scan.scan(rows).first()
    assert got.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(text)).encode()).hexdigest()


def test_ownership(spark):
    copied, own, token = "password=examplevalue1", "password=ownvalue12345", "Zx9Qw8Er7Ty6Ui5Op4As3Df2"
    rows = [(i, f"see {copied} here", "en", f"s{i}") for i in range(4)]
    rows += [(10, f"my {own} and {token} end", "en", "s1"), (11, f"again {own}", "en", "s1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in secret_scan.scan(frame).collect()}
    assert (got[0].n_live, got[0].n_copied) == (0, 1)
    assert (got[10].n_live, got[10].n_copied) == (2, 0) and "opaque:" in got[10].spans
    clean = {r.doc_id: r.text for r in secret_scan.redact(frame).collect()}
    assert clean[0] == rows[0][1] and clean[10] == "my [REDACTED] and [REDACTED] end" and clean[11] == "again [REDACTED]"


def test_redaction_keeps_the_rest(odd_wide, odd_rows, none):
    out = secret_scan.redact(odd_wide)
    assert out.columns == odd_wide.columns and out.count() == len(odd_rows)
    before = sorted(str(r.text) for r in odd_wide.collect() if not base(r.text))
    after = sorted(str(r.text) for r in out.collect() if "[REDACTED]" not in (r.text or ""))
    assert before == after
    assert secret_scan.redact(none).count() == 0
