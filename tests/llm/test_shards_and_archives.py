from __future__ import annotations

import base64
import collections
import hashlib
import zlib

from pyspark.sql import functions as F

from versemill.llm import archives, stratified_shards
from versemill.llm.common import shared_path


def test_shards(docs, texts, odd_wide, odd_rows, none):
    for frame, rows in ((docs, list(texts.items())), (odd_wide, [r[:2] for r in odd_rows])):
        got = stratified_shards.assign(frame).collect()
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(
            (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
        )
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots[k]) for k in range(8)]
        assert max(counts) - min(counts) <= 1
    # Each source spreads over the shards in its share.
    spread = collections.Counter((r.stratum, r.shard) for r in stratified_shards.assign(docs).collect())
    for source in {s for s, _ in spread}:
        share = [spread[source, k] for k in range(8)]
        assert max(share) - min(share) <= 2
    assert stratified_shards.assign(none).count() == 0


def test_arc_versions_and_damage():
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello\nWARC/1.0\r\n"
    for version, middle in (("1", "text/html"), ("2", "text/html 200 - - 0 x.arc")):
        lines = f"{version} 0 x\n{archives.ARC_TITLES[version]}\n".encode()
        head = b"filedesc://x.arc 0.0.0.0 20240101000000 text/plain %d\n" % len(lines)
        record = f"http://x/a b 1.2.3.4 20240102030405 {middle} {len(body)}\n".encode() + body + b"\n"
        good = head + lines + b"\n" + record * 2
        found = list(archives.arc_records(good))
        assert [r["payload"] for r in found] == [b"hello\nWARC/1.0\r\n"] * 2
        assert found[0]["url"] == "http://x/a b" and found[0]["date"] == "20240102030405"
        cut = list(archives.arc_records(good[:-5]))
        assert len(cut) == 2 and cut[1]["problem"]
    assert list(archives.arc_records(b"junk"))[0]["problem"] and not list(archives.arc_records(b""))
    assert archives._unpacked(b"") == b""


def test_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://a/1", big), (9, "http://a/9", big), (4, None, big), (5, "http://a/5", "small"), (6, "http://a/6", "small")]
    rows += [(7, "http://a b/7", None), (8, "", "WARC/1.1\r\n\r\nfiledesc:\n"), (None, "http://n", big), (None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nX-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    old, new = shared_path(spark, "arc"), shared_path(spark, "warc")
    archives.write_arc(frame.select(F.col("page_id").alias("key"), "url", http.alias("http"), F.col("html").alias("payload")), old)
    page = F.regexp_extract("http", "X-Page-Id: ([0-9]*)", 1)
    key = F.when(page != "", page.cast("long"))
    archives.write_warc(archives.to_warc(archives.read_arc(spark, old), key), new)
    got = archives.read_warc(spark, new).withColumn("key", key).collect()
    assert len(got) == len(rows) and not any(r.problem for r in got)
    ids = {r.key: r.record_id for r in got if r.record_type == "response"}
    for r in got:
        html = (dict((a, c) for a, _, c in rows if a is not None).get(r.key) or "") if r.key is not None else None
        if html is not None:
            assert r.digest == "sha1:" + base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
            assert r.record_type == ("revisit" if r.key in (1, 4) else "response")
            assert r.refers_to_id == (ids[9] if r.key in (1, 4) else None)
            assert r.record_type == "revisit" or bytes(r.payload).decode() == html
    hexed = hashlib.sha1(b"x").hexdigest()
    one = spark.range(1).select(archives.from_base32(archives.base32(F.lit(hexed)))).first()[0]
    assert one == hexed


def test_no_pages(spark):
    frame = spark.createDataFrame([], "key long, url string, http string, payload string")
    old, new = shared_path(spark, "arc"), shared_path(spark, "warc")
    archives.write_arc(frame, old)
    archives.write_warc(archives.to_warc(archives.read_arc(spark, old), F.lit(1)), new)
    assert archives.read_arc(spark, old).count() == 0
