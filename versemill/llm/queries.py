"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.llm import (
    archives,
    decontaminate,
    fill_in_middle,
    language_id,
    packing,
    personal_data,
    quality,
    secret_scan,
    simhash,
    stratified_shards,
    suffix_dedup,
    toxicity,
    vector_codes,
)
from versemill.llm.common import read, shared_path, stored
from versemill.llm.language_id import held_out
from versemill.llm.registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Either case of ASCII letters only, which the other engine's case-insensitive match is not.
_LEAD = secret_scan.LEAD.replace("'", "''")
_ASSIGN = secret_scan.ASSIGN.replace("'", "''")


def _spans_sql(kind: str, pattern: str, value: str, least: int) -> str:
    rank = secret_scan.KINDS.index(kind)
    return f"""SELECT id, doc_id, p0 + length(b) AS s, {rank} AS k, '{kind}' AS kind, p0 + length(b) + length(m) AS e,
    {value} AS v FROM (SELECT id, doc_id, m, b, coalesce(sum(length(m) + length(b)) OVER (PARTITION BY id
      ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0
    FROM (SELECT id, doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m,
      unnest(list_slice(string_split_regex(t, '{pattern}'), 1, len(regexp_extract_all(t, '{pattern}')))) AS b,
      unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i FROM d)) WHERE length({value}) >= {least}"""


_SECRETS_SQL = f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, source, lang FROM documents),
base AS ({_spans_sql("assign", _ASSIGN, f"regexp_replace(m, '^{_LEAD}', '')", 8)}
UNION ALL {_spans_sql("access", secret_scan.ACCESS, "m", 16)}
UNION ALL {_spans_sql("hex", secret_scan.HEX, "m", 32)}),
opaque AS ({_spans_sql("opaque", "[A-Za-z0-9+/_=-]{20,}", "m", 20)}),
spare AS (SELECT * FROM opaque o WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]')
  AND regexp_matches(v, '[a-z]') AND len(list_distinct(string_split(v, ''))) >= {secret_scan.VARIETY}
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.id = o.id AND b.s < o.e AND o.s < b.e)),
held AS (SELECT x.*, source, CASE WHEN lang IS NULL THEN source WHEN source IS NULL THEN lang ELSE source || '/' || lang END AS repo
  FROM (SELECT * FROM base UNION ALL SELECT * FROM spare) x JOIN d USING (id)),
spread AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT repo) AS repos FROM held GROUP BY v),
marked AS (SELECT held.*, owners >= {secret_scan.COPIED_OWNERS} AND repos >= {secret_scan.COPIED_REPOSITORIES} AS copied
  FROM held JOIN spread USING (v) WHERE kind <> 'opaque' OR owners <= 1)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (kind <> 'opaque'), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '') AS spans,
  count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied
FROM d LEFT JOIN marked ON d.id = marked.id GROUP BY d.id, d.doc_id"""


@query("op4_secret_scans", _SECRETS_SQL)
def secret_scans(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.scan(read(spark, d, "documents"))


@query("op6_quality_rules")
def quality_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    trusted = read(spark, d, "labels").where("quality = 1").select("doc_id")
    return quality.assess(docs, quality.fit_ratio(docs, trusted)).selectExpr(
        "row.doc_id AS doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


@query("op8_packing")
def packing_query(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"), tokenizer_path())


@query("op9_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))


@query("op10_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, d, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


@query("op2_warc")
def warc(spark: SparkSession, d: str) -> DataFrame:
    """Pages as legacy archives, converted to WARC and read back."""
    pages = read(spark, d, "pages")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
    )
    legacy, modern = shared_path(spark, "arc"), shared_path(spark, "warc")
    archives.write_arc(
        pages.select(F.col("page_id").alias("key"), "url", head.alias("http"), F.col("html").alias("payload")), legacy
    )
    page_id = F.regexp_extract("http", "(?m)^X-Page-Id: (-?[0-9]+)", 1)
    key = F.when(page_id != "", page_id.cast("bigint"))
    archives.write_warc(archives.to_warc(archives.read_arc(spark, legacy), key), modern)
    back = archives.read_warc(spark, modern).where("problem is null")
    back = back.select(
        key.alias("page_id"),
        "record_type",
        "record_id",
        "refers_to_id",
        "digest",
        F.octet_length("payload").cast("bigint").alias("stored_bytes"),
        F.sha1("payload").alias("stored_digest"),
    )
    back = stored(back, "archived")
    holders = back.where("record_type = 'response'").dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("refers_to_id"),
        F.col("page_id").alias("refers_to"),
        F.col("stored_bytes").alias("held_bytes"),
    )
    revisit = F.col("record_type") == "revisit"
    return back.join(holders, "refers_to_id", "left").select(
        "page_id",
        F.when(revisit, F.col("held_bytes")).otherwise(F.col("stored_bytes")).alias("payload_bytes"),
        F.when(revisit, archives.from_base32(F.substring("digest", 6, 32)))
        .otherwise(F.col("stored_digest"))
        .alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
    )


ORACLE["op2_warc"] = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
h AS (SELECT payload_digest, payload_bytes, max(page_id) AS holder FROM s
  WHERE payload_bytes >= {archives.REVISIT_BYTES} GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN holder IS NULL OR holder IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN holder IS DISTINCT FROM page_id THEN holder END AS refers_to
FROM s LEFT JOIN h USING (payload_digest, payload_bytes)"""

# CRC-32 by its rule: a table of 256 remainders, then one step per byte.
_CRC_SQL = """rounds AS (SELECT range AS b, 0 AS k, range::UBIGINT AS c FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM rounds WHERE k < 8),
steps AS (SELECT list(c ORDER BY b) AS tab FROM rounds WHERE k = 8)"""

_SHARDS_SQL = f"""WITH RECURSIVE {_CRC_SQL},
b AS (SELECT doc_id, source, coalesce(text, '') AS t,
  md5('{stratified_shards.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '?') || '|' || coalesce(text, '')) AS key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 1 AS rk, count(*) OVER (PARTITION BY source) AS n FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * rk + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), source NULLS FIRST, key, doc_id) - 1 AS pos,
  count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size,
  CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS UBIGINT)),
    lambda c, x: xor(c >> 8, tab[CAST((xor(c, x) & 255) + 1 AS BIGINT)]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS BIGINT) AS text_crc32,
  'rows' AS law, CAST(pos * {stratified_shards.SHARDS} // total AS INTEGER) AS shard,
  CAST(pos - ((pos * {stratified_shards.SHARDS} // total) * total + {stratified_shards.SHARDS - 1}) // {stratified_shards.SHARDS} AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard FROM p, steps"""


@query("op3_sharding", _SHARDS_SQL)
def sharding(spark: SparkSession, d: str) -> DataFrame:
    return stratified_shards.assign(read(spark, d, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_toxicity")
def toxicity_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    machine = toxicity.fit(docs, read(spark, d, "labels"), ~held_out())
    return toxicity.score(docs, machine).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query("op7_language_id")
def language_id_query(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    found = language_id.identify(docs, language_id.fit(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")


@query("op1_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read(spark, d, "documents"))


_FILL_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (length(t) + 1) AS c1,
  ('0x' || substr(h, 9, 8))::BIGINT % (length(t) + 1) AS c2, CASE WHEN t = '' OR contains(t, '{fill_in_middle.PREFIX}')
    OR contains(t, '{fill_in_middle.SUFFIX}') OR contains(t, '{fill_in_middle.MIDDLE}')
    OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, least(c1, c2)) AS prefix, substr(t, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS middle,
  substr(t, greatest(c1, c2) + 1) AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(least(c1, c2) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(greatest(c1, c2) - least(c1, c2) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{fill_in_middle.PREFIX}' || prefix || '{fill_in_middle.SUFFIX}' || suffix
    || '{fill_in_middle.MIDDLE}' || middle ELSE '{fill_in_middle.SUFFIX}' || suffix || '{fill_in_middle.PREFIX}' || prefix
    || '{fill_in_middle.MIDDLE}' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


@query("op13_fill_in_middle", _FILL_SQL)
def fill_in_middle_query(spark: SparkSession, d: str) -> DataFrame:
    out = fill_in_middle.arrange(read(spark, d, "documents"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _proposals_sql(kind: str, passes: str) -> str:
    """Spans of one pattern that pass a condition on the match ``m`` and its digits ``g``."""
    pattern = _quoted(personal_data.PATTERNS.get(kind, personal_data.PATTERNS["card"]))
    return f"""SELECT id, {personal_data.KINDS.index(kind)} AS k, '{kind}' AS kind, s, e FROM (
  SELECT id, t, m, regexp_replace(m, '[^0-9]', '', 'g') AS g, p0 + length(b) AS s, p0 + length(b) + length(m) AS e FROM (
    SELECT id, t, m, b, coalesce(sum(length(m) + length(b)) OVER (PARTITION BY id
      ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0
    FROM (SELECT id, t, unnest(regexp_extract_all(t, '{pattern}')) AS m,
      unnest(list_slice(string_split_regex(t, '{pattern}'), 1, len(regexp_extract_all(t, '{pattern}')))) AS b,
      unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i FROM d))) WHERE {passes}"""


_LUHN_SQL = """list_sum(list_transform(string_split(reverse(g), ''), lambda x, i:
  CASE WHEN i % 2 = 1 THEN TRY_CAST(x AS INT) ELSE (2 * TRY_CAST(x AS INT)) // 10 + (2 * TRY_CAST(x AS INT)) % 10 END)) % 10 = 0"""
_MOD97_SQL = """list_reduce(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''),
  lambda c: coalesce(TRY_CAST(c AS INT), ascii(c) - 55)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97, 0) = 1"""
_ALONE_SQL = """NOT regexp_matches(substr(t, CAST(s AS BIGINT), CASE WHEN s > 0 THEN 1 ELSE 0 END) || substr(t, CAST(e AS BIGINT) + 1, 1), '[A-Za-z0-9+.-]')"""
_PASSES_SQL = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR TRY_CAST(x AS BIGINT) > 255)) = 0",
    "card": f"length(g) BETWEEN 16 AND 19 AND {_LUHN_SQL}",
    "phone": "length(g) BETWEEN 8 AND 15",
    "iban": f"{_ALONE_SQL} AND {_MOD97_SQL}",
    "shortcard": f"length(g) BETWEEN 13 AND 15 AND {_LUHN_SQL}",
    "ssn": f"{_ALONE_SQL} AND substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8) <> '0000'",
    "localphone": f"{_ALONE_SQL} AND length(g) BETWEEN 9 AND 12",
}


def _near_sql(words: str) -> str:
    return f"regexp_matches(near, '{_quoted(personal_data.words_pattern(words))}')" if words else "false"


_SCORES_SQL = "\n".join(
    f"WHEN '{k}' THEN {r.score + r.checksum} + CASE WHEN {_near_sql(r.words)} THEN {r.raised} ELSE 0 END"
    f" - CASE WHEN {_near_sql(r.against)} THEN {r.lowered} ELSE 0 END"
    for k, r in personal_data.RULES.items()
)
_PERSONAL_SQL = f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
proposed AS ({" UNION ALL ".join(_proposals_sql(k, p) for k, p in _PASSES_SQL.items())}),
free AS (SELECT * FROM proposed p WHERE k < {len(personal_data.BASE)} OR NOT EXISTS (SELECT 1 FROM proposed b
  WHERE b.id = p.id AND b.k < {len(personal_data.BASE)} AND b.s < p.e AND p.s < b.e)),
placed AS (SELECT f.*, substr(' ' || t, CAST(greatest(s + 1 - {personal_data.BEFORE}, 0) AS BIGINT) + 1,
    CAST(least(s + 1, {personal_data.BEFORE}) AS BIGINT)) || chr(10) || substr(t || ' ', CAST(e AS BIGINT) + 1, {personal_data.AFTER}) AS near
  FROM free f JOIN d USING (id)),
scored AS (SELECT *, greatest(0, least(100, CASE kind {_SCORES_SQL} END)) AS score FROM placed),
kept AS (SELECT * FROM scored WHERE k < {len(personal_data.BASE)} OR score >= {personal_data.LEAST})
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY k, s) FILTER (k < {len(personal_data.BASE)}), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY k, s), '') AS spans,
  coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, s), '') AS scores
FROM d LEFT JOIN kept ON d.id = kept.id GROUP BY d.id, d.doc_id"""


@query("op11_personal_data", _PERSONAL_SQL)
def personal_data_query(spark: SparkSession, d: str) -> DataFrame:
    found = F.col("found")
    return personal_data.scan(read(spark, d, "documents")).select(
        F.col("row.doc_id").alias("doc_id"),
        *(personal_data.number_of(found, kind).alias(f"n_{kind}") for kind in personal_data.BASE),
        F.sha2(personal_data.joined(found, base=True), 256).alias("base_sha256"),
        personal_data.joined(found).alias("spans"),
        F.array_join(F.transform(found, lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


# Four components a part, as the given table has.
_PLACES = range(4)


def _assigned_sql(name: str, books: str) -> str:
    """Per part the nearest entry and its distance: distance * entries + entry is smallest."""
    n = vector_codes.ENTRIES
    distance = " + ".join(f"(p.x{k} - c.x{k}) * (p.x{k} - c.x{k})" for k in _PLACES)
    return f"""{name} AS (SELECT r, part, any_value(p.x0) AS x0, any_value(p.x1) AS x1, any_value(p.x2) AS x2, any_value(p.x3) AS x3,
  min(({distance}) * {n} + e) % {n} AS e, min(({distance}) * {n} + e) // {n} AS d FROM p JOIN {books} c USING (part) GROUP BY r, part)"""


def _means_sql(name: str, before: str, assigned: str) -> str:
    floors = ", ".join(f"(sum(x{k}) - ((sum(x{k}) % count(*)) + count(*)) % count(*)) // count(*) AS x{k}" for k in _PLACES)
    return f"""{name} AS (SELECT part, e, {", ".join(f"CAST(coalesce(m.x{k}, b.x{k}) AS BIGINT) AS x{k}" for k in _PLACES)} FROM {before} b
  LEFT JOIN (SELECT part, e, {floors} FROM {assigned} GROUP BY part, e) m USING (part, e))"""


_CODES_SQL = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, label,
  list_transform(embedding, lambda y: CAST(floor(CAST(y AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
p AS (SELECT r, part, {", ".join(f"x[part * 4 + {k + 1}] AS x{k}" for k in _PLACES)} FROM v, range({vector_codes.PARTS}) t(part)),
b0 AS (SELECT p.* EXCLUDE (r), e FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM v
  ORDER BY vec_id, x LIMIT {vector_codes.ENTRIES}) USING (r)),
{_assigned_sql("a0", "b0")}, {_means_sql("b1", "b0", "a0")}, {_assigned_sql("a1", "b1")}, {_means_sql("b2", "b1", "a1")},
{_assigned_sql("a2", "b2")},
codes AS (SELECT r, string_agg(lower(printf('%02x', CAST(e AS BIGINT))), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
books AS (SELECT sha256(string_agg({" || ',' || ".join(f"CAST(x{k} AS VARCHAR)" for k in _PLACES)}, ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN codes USING (r), books"""


@query("op12_vector_codes", _CODES_SQL)
def vector_codes_query(spark: SparkSession, d: str) -> DataFrame:
    rows, books = vector_codes.compress(read(spark, d, "embeddings"))
    rows = rows.select("carry.vec_id", "carry.label", F.lower(F.hex("code")).alias("code"), "error")
    rows = stored(rows, "coded")
    sums = rows.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256")
    )
