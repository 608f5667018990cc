"""Legacy web archives: ARC files of both versions, and their conversion to WARC.

An ARC file begins with a version block that names its record format; each record is a
header line of that format, whose last field declares how many bytes follow. The
converter parses these and synthesises what WARC adds: record identifiers, ISO dates,
record types, payload digests, and revisit records for repeated payloads.

Files are gzip-compressed as a whole. They are read whole by a task each, as their
records can only be found by walking the declared lengths; the writers bound a file's
size, and archives are by custom cut at some hundred megabytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of records that one written file holds on average at most.
FILE_BYTES = 32 << 20
# Bytes that a parser hands on at a time.
BATCH_BYTES = 8 << 20
# Payloads of at least this many bytes may be replaced by a revisit.
REVISIT_BYTES = 1_000

# Fields of an ARC header line by version, the length last.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "mime", "length"),
    "2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "file", "length"),
}
ARC_TITLES = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CRLF = "\r\n"
DIGITS32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _unpacked(data: bytes) -> bytes:
    """All members of a gzip file one after the other; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(parts)


def _http(content: bytes) -> tuple[str, bytes]:
    """Header and payload of an HTTP message; content of another kind is all payload."""
    if content[:5] == b"HTTP/":
        head, found, body = content.partition(b"\r\n\r\n")
        if found:
            return head.decode("latin-1"), body
    return "", content


def arc_records(data: bytes) -> Iterator[dict]:
    """The records of one ARC file. What follows a broken header or length is one row with a ``problem``."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        if version is None:
            # The version block declares the length of its own two lines.
            size = line.rpartition(" ")[2]
            body = data[end + 1 :] if end >= 0 else b""
            number = body[:1].decode("latin-1")
            if not line.startswith("filedesc:") or not size.isdigit() or number not in ARC_FIELDS:
                yield {"problem": "no version block", "bytes": len(data) - at}
                return
            version, at = number, end + 1 + int(size)
            continue
        fields = ARC_FIELDS[version]
        values = line.rsplit(" ", len(fields) - 1)
        size = values[-1]
        if end < 0 or len(values) != len(fields) or not size.isdigit() or end + 1 + int(size) > len(data):
            yield {"problem": "broken record", "bytes": len(data) - at}
            return
        record = dict(zip(fields, values, strict=True))
        record["http"], record["payload"] = _http(data[end + 1 : end + 1 + int(size)])
        at = end + 1 + int(size)
        yield record


def warc_records(data: bytes) -> Iterator[dict]:
    """The records of one WARC file; header names in lower case. Broken rests are one row with a ``problem``."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")
        record = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = record.get("content-length", "")
        if end < 0 or not lines[0].startswith("WARC/") or not size.isdigit() or end + 4 + int(size) > len(data):
            yield {"problem": "broken record", "bytes": len(data) - at}
            return
        block = data[end + 4 : end + 4 + int(size)]
        record["http"], record["payload"] = _http(block)
        at = end + 4 + int(size)
        yield record


def _parsed(spark: SparkSession, path: str, records, fields: dict[str, str]) -> DataFrame:
    """Rows of all archive files below ``path``: ``fields`` maps record keys to column names."""
    names = [*fields.values(), "http", "payload", "problem"]
    types = [pa.string()] * (len(fields) + 1) + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[dict]) -> pa.RecordBatch:
            keys = [*fields, "http", "payload", "problem"]
            columns = [pa.array([r.get(k) for r in rows], t) for k, t in zip(keys, types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for record in records(_unpacked(content.as_py())):
                    rows.append(record)
                    size += len(record.get("payload", b""))
                    if size > BATCH_BYTES:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    schema = ", ".join([*(f"`{n}` string" for n in fields.values()), "http string", "payload binary", "problem string"])
    return files.mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """url, ip, date (14 digits), mime, http header, payload and problem of every ARC record below ``path``."""
    return _parsed(spark, path, arc_records, {k: k for k in ("url", "ip", "date", "mime")})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of every WARC file below ``path``; ``problem`` is null for sound ones."""
    fields = {
        "warc-type": "record_type",
        "warc-target-uri": "url",
        "warc-date": "date",
        "warc-record-id": "record_id",
        "warc-refers-to": "refers_to_id",
        "warc-payload-digest": "digest",
    }
    return _parsed(spark, path, warc_records, fields)


def _sized(text: Column) -> Column:
    return F.octet_length(text).cast("string")


def _no_blanks(url: Column) -> Column:
    """A URL as one header field: white space percent-encoded, none at all as ``about:blank``."""
    for char in " \t\r\n":
        url = F.replace(url, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.when(F.length(url) > 0, url).otherwise("about:blank")


def write_arc(rows: DataFrame, path: str, date: str = "20240101000000", origin: str = "versemill") -> None:
    """Write rows (key, url, http, payload) as ARC files, versions 1 and 2 by turns.

    ``payload`` is a string or binary; null is empty. Each file begins with its version
    block; files hold a hash share of the rows.
    """
    body = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    content = F.concat(F.col("http"), F.lit(CRLF * 2), body)
    rows = rows.select(_no_blanks(F.coalesce("url", F.lit(""))).alias("url"), content.alias("content"), "key")
    total = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    files = max(2, -(-total // FILE_BYTES))
    file = F.pmod(F.xxhash64("key", "url", "content"), F.lit(files))
    common = F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"))
    second = F.concat_ws(" ", common, F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.concat(F.col("file").cast("string"), F.lit(".arc")))
    line = F.concat_ws(" ", F.when(F.col("file") % 2 == 0, common).otherwise(second), _sized(F.col("content")))
    records = rows.withColumn("file", file).select("file", F.lit(1).alias("turn"), F.concat_ws("\n", line, "content").alias("value"))
    version = F.when(F.col("id") % 2 == 0, F.lit(f"1 0 {origin}\n{ARC_TITLES['1']}\n")).otherwise(
        F.lit(f"2 0 {origin}\n{ARC_TITLES['2']}\n")
    )
    block = F.concat(
        F.lit("filedesc://"), F.col("id").cast("string"), F.lit(f".arc 0.0.0.0 {date} text/plain "), _sized(version), F.lit("\n"), version
    )
    blocks = rows.sparkSession.range(files).select(F.col("id").alias("file"), F.lit(0).alias("turn"), block.alias("value"))
    every = records.unionByName(blocks).repartition(int(files), "file").sortWithinPartitions("file", "turn")
    every.select("file", "value").write.partitionBy("file").option("compression", "gzip").text(path)


def base32(digest: Column) -> Column:
    """Lower-case hex SHA-1 to base 32: five hex digits are four characters."""
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def from_base32(digest: Column) -> Column:
    plain = F.translate(digest, BASE32, DIGITS32)
    return F.lower(F.concat(*(F.lpad(F.conv(F.substring(plain, 1 + 4 * i, 4), 32, 16), 5, "0") for i in range(8))))


def record_id(*parts: Column) -> Column:
    """A name-based identifier: the same capture gets the same one in every run."""
    h = F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    uuid = F.concat(cut[0], F.lit("-"), cut[1], F.lit("-5"), cut[2], F.lit("-a"), cut[3], F.lit("-"), cut[4])
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def to_warc(records: DataFrame, key: Column, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """ARC records as WARC records: key, record_type, url, date, ids, digest, http header and payload.

    ``key`` (a number) tells captures apart. Of records with equal payloads of at least
    ``min_bytes`` the one with the largest key stays a response and the others revisit
    it; records without a key are revisits of one that has a key, and responses where
    none has. Damaged records are left out.
    """
    sound = records.where("problem is null").withColumn("key", key.cast("bigint"))
    sound = sound.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    holders = (
        sound.where(F.col("n") >= min_bytes)
        .groupBy("digest", "n")
        .agg(F.max("key").alias("holder"), F.count("*").alias("copies"))
        .where("copies > 1 and holder is not null")
        .select("digest", "n", "holder")
    )
    joined = sound.join(holders, ["digest", "n"], "left")
    revisit = F.col("holder").isNotNull() & ~F.col("key").eqNullSafe(F.col("holder"))
    # 14 digits, as legacy dates are, to the form with separators.
    date = F.regexp_replace(F.rpad("date", 14, "0"), r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    return joined.select(
        "key",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "url",
        date.alias("date"),
        record_id(F.lit("capture"), F.col("key"), F.col("digest")).alias("record_id"),
        F.when(revisit, record_id(F.lit("capture"), F.col("holder"), F.col("digest"))).alias("refers_to_id"),
        F.concat(F.lit("sha1:"), base32(F.col("digest"))).alias("digest"),
        "http",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str, per_file: int = 5_000) -> None:
    """Write WARC records as text whose last line feed is the record separator's last byte."""
    block = F.concat("http", F.lit(CRLF * 2), F.coalesce(F.col("payload").cast("string"), F.lit("")))
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Date", F.col("date")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Refers-To", F.col("refers_to_id")),
        ("WARC-Payload-Digest", F.col("digest")),
        (
            "WARC-Profile",
            F.when(
                F.col("record_type") == "revisit",
                F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ),
        ),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", _sized(F.col("block"))),
    ]
    # concat_ws leaves out null lines.
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), *(F.concat(F.lit(f"{n}: "), v) for n, v in fields))
    text = F.concat("head", F.lit(CRLF * 2), "block", F.lit("\r\n\r"))
    rows = records.withColumn("block", block).withColumn("head", head).select(text.alias("value"))
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
