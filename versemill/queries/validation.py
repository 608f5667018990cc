"""Validation and normalisation over the word-list, edit and manifest bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from versemill import bindings as B
from versemill.functions import text as T
from versemill.operators import validation as V
from versemill.queries.registry import query

W = B.with_(B.WORDLIST)


@query(
    "v1_cell_cleaning",
    r"""WITH c AS (SELECT doc_id, trim(replace(regexp_replace(replace(text, chr(65279), ''), '\r\n|\r|\n', ' ', 'g'), ',', '、'), ' ') AS t FROM documents)
SELECT doc_id, md5(t) AS cleaned, CAST(length(t) AS BIGINT) AS n FROM c""",
)
def v1(spark, d):
    c = V.clean_strings(B.documents(spark, d).select("doc_id", "text"))
    return c.select("doc_id", F.md5("text").alias("cleaned"), F.length("text").cast("bigint").alias("n"))


@query(
    "v2_reading_errors",
    W + """, bad AS (SELECT * FROM wordlist WHERE NOT regexp_matches(surface, '^[a-z]+ [a-m][a-z]*$')),
 r AS (SELECT list, id, surface, row_number() OVER (PARTITION BY list ORDER BY id) AS rank, count(*) OVER (PARTITION BY list) AS n_bad FROM bad)
SELECT list, id, surface, rank, n_bad, greatest(0, n_bad - 5) AS and_more FROM r WHERE rank <= 5""",
)
def v2(spark, d):
    bad = ~F.col("surface").rlike("^[a-z]+ [a-m][a-z]*$")
    out = V.first_errors(B.wordlist(spark, d).select("list", "id", "surface"), ["list"], bad, ["id"])
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "v3_header_columns",
    f"""WITH h AS (SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, {B.words_sql("text")} AS ws FROM documents),
   unnest(range(1, len(ws) + 1)) AS u(i)), n AS (SELECT doc_id, w, count(*) AS c FROM h GROUP BY 1, 2)
SELECT doc_id, CAST(count(*) FILTER (w NOT IN ('image', 'and', 'the')) AS BIGINT) AS n_kept, CAST(sum(c - 1) AS BIGINT) AS n_duplicates,
  coalesce(string_agg(w, ',' ORDER BY w) FILTER (w IN ('image', 'and', 'the')), '') AS dropped FROM n GROUP BY doc_id""",
)
def v3(spark, d):
    names = F.flatten(F.transform("texts", T.letter_words))
    headers = B.texts(spark, d).select("doc_id", F.explode(F.array(names)).alias("name"))
    return V.resolve_header(headers, "doc_id", "pos", "name", forbidden=("image", "and", "the"))


@query(
    "v4_default_fill",
    W + """, r AS (SELECT list, id AS k, CASE WHEN id % 7 = 0 THEN NULL ELSE id END AS id, CASE WHEN id % 4 = 0 THEN ' ' ELSE original END AS original,
   CASE WHEN id % 11 = 0 THEN 'none' ELSE surface END AS surface, CASE WHEN id % 5 = 0 THEN 'NA' ELSE surface END AS reading FROM wordlist),
 n AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY k) AS rn FROM r WHERE lower(trim(surface)) NOT IN ('', 'na', 'n/a', 'nan', 'none', 'null'))
SELECT list, k, coalesce(CAST(id AS VARCHAR), CAST(rn AS VARCHAR)) AS id, coalesce(nullif(trim(original), ''), surface) AS original, surface,
  CASE WHEN reading = 'NA' THEN '' ELSE reading END AS reading FROM n""",
)
def v4(spark, d):
    k = F.col("id")
    rows = B.wordlist(spark, d).select(
        "list",
        k.alias("k"),
        F.when(k % 7 != 0, k).alias("id"),
        F.when(k % 4 == 0, " ").otherwise(F.col("original")).alias("original"),
        F.when(k % 11 == 0, "none").otherwise(F.col("surface")).alias("surface"),
        F.when(k % 5 == 0, "NA").otherwise(F.col("surface")).alias("reading"),
    )
    return V.fill_defaults(rows, ["list"], ["k"], B.row_slice("k"))


@query(
    "v5_volume_limits",
    """SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, count(*) AS n_rows, count(*) FILTER (contains(text, 'http')) AS n_images,
  CASE WHEN sum(strlen(text)) > 120000 THEN 'bytes' WHEN count(*) > 52 THEN 'rows' WHEN count(*) FILTER (contains(text, 'http')) > 3 THEN 'images' ELSE '' END AS violation
FROM documents GROUP BY source""",
)
def v5(spark, d):
    return V.volume_limits(
        B.documents(spark, d), ["source"], F.col("text"), F.col("text").contains("http"),
        max_bytes=120_000, max_rows=52, max_images=3,
    )


@query(
    "v6_fingerprint",
    W + """SELECT list, left(sha256(string_agg(id || ',' || original || ',' || surface, chr(10) ORDER BY id)), 16) AS fingerprint,
  count(*) AS n_rows FROM wordlist GROUP BY list""",
)
def v6(spark, d):
    line = F.concat_ws(",", F.col("id").cast("string"), "original", "surface")
    return V.list_fingerprint(B.wordlist(spark, d), ["list"], ["id"], line)


@query(
    "v7_list_summary",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
SELECT source, count(*) AS n_rows, count(DISTINCT lang) AS n_langs, count(*) FILTER (n_chars < 200) AS n_short,
  count(*) FILTER (contains(text, 'http')) AS n_image_rows, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (rn <= 3) AS samples
FROM s GROUP BY source""",
)
def v7(spark, d):
    from versemill.plans.ordered import top_rows

    docs = B.documents(spark, d).select(
        "doc_id", "source", "lang", "n_chars", F.col("text").contains("http").alias("has_image")
    )
    counts = docs.groupBy("source").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("lang").alias("n_langs"),
        F.count_if(F.col("n_chars") < 200).alias("n_short"),
        F.count_if("has_image").alias("n_image_rows"),
    )
    samples = (
        top_rows(docs.select("source", "doc_id"), ["source"], [F.col("doc_id")], 3)
        .groupBy("source")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ","
            ).alias("samples")
        )
    )
    return counts.join(samples, "source")


@query(
    "v8_asset_binding",
    """WITH r AS (SELECT p_partkey, 'p' || p_partkey % 400 AS original, CASE p_partkey % 4 WHEN 0 THEN 'p' || p_partkey % 300 || '.png'
   WHEN 1 THEN 'p' || p_partkey % 500 WHEN 2 THEN '' ELSE CASE WHEN p_size % 2 = 0 THEN 'http://x/y.png' ELSE NULL END END AS image FROM part),
 a AS (SELECT 'p' || page_id || '.png' AS name, 'p' || page_id AS stem FROM pages),
 w AS (SELECT *, coalesce(trim(image), '') AS named FROM r),
 j AS (SELECT w.*, coalesce(x.name, y.name) AS found FROM w LEFT JOIN a x ON w.named = x.name
   LEFT JOIN a y ON y.stem = CASE WHEN named <> '' THEN regexp_replace(named, '\\.[^.]*$', '') ELSE original END)
SELECT p_partkey, CASE WHEN NOT regexp_matches(named, '[/:]') THEN found END AS asset,
  CASE WHEN regexp_matches(named, '[/:]') THEN 'path' WHEN found IS NOT NULL THEN 'bound' WHEN named <> '' THEN 'missing' ELSE 'none' END AS bind_status FROM j""",
)
def v8(spark, d):
    k = F.col("p_partkey")
    text = lambda n: F.concat(F.lit("p"), (k % n).cast("string"))
    rows = B.table(spark, d, "part").select(
        "p_partkey",
        text(400).alias("original"),
        F.when(k % 4 == 0, F.concat(text(300), F.lit(".png")))
        .when(k % 4 == 1, text(500))
        .when(k % 4 == 2, "")
        .otherwise(F.when(F.col("p_size") % 2 == 0, "http://x/y.png"))
        .alias("image"),
    )
    stem = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    assets = B.table(spark, d, "pages").select(F.concat(stem, F.lit(".png")).alias("name"), stem.alias("stem"))
    return V.bind_assets(rows, assets, "image", "original").select("p_partkey", "asset", "bind_status")


@query(
    "v9_content_dedupe",
    """WITH s AS (SELECT sha1(text) AS digest, min(doc_id) AS stored_as, count(*) AS n_copies FROM documents GROUP BY 1)
SELECT d.doc_id, s.digest, s.stored_as, s.n_copies FROM documents d JOIN s ON sha1(d.text) = s.digest WHERE d.doc_id IN (SELECT doc_id FROM labels)""",
)
def v9(spark, d):
    return V.dedupe_content(
        B.documents(spark, d), "doc_id", F.sha1("text"), B.table(spark, d, "labels").select("doc_id")
    )


@query(
    "v9_ambiguous_stems",
    """SELECT regexp_extract(lower(url), '^https?://([^/]*)', 1) AS stem, count(*) AS n_files FROM pages GROUP BY 1 HAVING count(*) > 1""",
)
def v9_stems(spark, d):
    return V.ambiguous_stems(
        B.table(spark, d, "pages"), F.regexp_extract(F.lower("url"), "^https?://([^/]*)", 1)
    )


@query(
    "v10_editor_list_check",
    W + """SELECT list, id, CASE WHEN id % 6 = 0 THEN 'null' ELSE surface END AS surface, '' AS reading, '' AS note,
  CASE WHEN id % 6 = 0 THEN 'no surface' ELSE '' END AS problem FROM wordlist""",
)
def v10(spark, d):
    rows = B.wordlist(spark, d).select(
        "list", "id", F.when(F.col("id") % 6 == 0, "null").otherwise(F.col("surface")).alias("surface")
    )
    return V.require_editor_columns(rows, "id", "surface", {"reading": "", "note": ""})


_WORD_COUNT = "len(regexp_extract_all(text, '[^\\s]+'))"


@query(
    "v11_edit_acceptance",
    B.with_(B.TURNS) + f""", o AS (SELECT song_id, line_id, {_WORD_COUNT} AS n_words, 4 + line_id % 7 AS n_notes, text AS surface FROM turns),
 n AS (SELECT song_id, CASE WHEN song_id % 10 = 0 THEN line_id + 100 ELSE line_id END AS line_id, {_WORD_COUNT} + CASE WHEN song_id % 7 = 0 THEN 1 ELSE 0 END AS n_words,
   string_split(role, '') AS moras, length(role) AS nm, CASE WHEN line_id % 2 = 0 THEN text ELSE text || '!' END AS surface FROM turns),
 j AS (SELECT n.*, o.n_notes, o.surface AS os, CASE WHEN o.line_id IS NULL THEN 'unknown line' WHEN o.n_words <> n.n_words THEN 'word count'
   WHEN nm > n_notes THEN 'too many moras' ELSE 'ok' END AS status FROM n LEFT JOIN o USING (song_id, line_id))
SELECT song_id, line_id, status, CASE WHEN status = 'ok' THEN rtrim(array_to_string(moras, ' ') || repeat(' ー', CAST(n_notes - nm AS BIGINT))) END AS note_kana,
  coalesce(status = 'ok' AND surface <> os, false) AS clears_filler FROM j""",
)
def v11(spark, d):
    t = B.turns(spark, d)
    n_words = F.size(F.regexp_extract_all("text", F.lit(r"[^\s]+"), 0))
    song, line = F.col("song_id"), F.col("line_id")
    old = t.select("song_id", "line_id", n_words.alias("n_words"), (4 + line % 7).alias("n_notes"), F.col("text").alias("surface"))
    new = t.select(
        "song_id",
        F.when(song % 10 == 0, line + 100).otherwise(line).alias("line_id"),
        (n_words + F.when(song % 7 == 0, 1).otherwise(0)).alias("n_words"),
        F.split("role", "").alias("moras"),
        F.when(line % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("surface"),
    )
    return V.accept_edits(old, new, ["song_id", "line_id"])


@query(
    "v12_manifest_check",
    r"""SELECT page_id, concat_ws(',', CASE WHEN page_id % 9 = 0 THEN 'revision' END, CASE WHEN page_id % 8 = 0 THEN 'digest' END,
  CASE WHEN page_id % 11 = 0 THEN 'time' END, CASE WHEN NOT regexp_full_match(url, 'https://[a-z.]+/[^/?#]+/[^/?#]+') THEN 'url' END) AS failures FROM pages""",
)
def v12(spark, d):
    k = F.col("page_id")
    rows = B.table(spark, d, "pages").select(
        "page_id",
        "url",
        F.when(k % 9 == 0, 0).otherwise(3).alias("revision"),
        F.when(k % 8 == 0, F.sha1("html")).otherwise(F.sha2("html", 256)).alias("sha256"),
        F.length("html").alias("size"),
        F.when(k % 11 == 0, "2024-01-01").otherwise("2024-01-01T10:00:00+09:00").alias("updated_at"),
    )
    return V.manifest_failures(rows, V.publisher_rules("[a-z.]+", "/")).select("page_id", "failures")


@query(
    "v13_rollback_guard",
    B.with_(B.ASSETS1, B.ASSETS2) + """, a2 AS (SELECT url, page_id, sha256, CASE WHEN page_id % 4 = 0 THEN 0 WHEN page_id % 6 = 3 THEN 1 ELSE revision END AS revision FROM assets2)
SELECT a2.url, CAST(a2.revision AS BIGINT) AS revision, a.revision AS active_rev, CASE WHEN a2.revision < a.revision THEN 'rollback'
  WHEN a2.revision = a.revision AND a2.sha256 <> a.sha256 THEN 'changed' ELSE 'ok' END AS verdict FROM a2 LEFT JOIN assets1 a ON a.url = a2.url""",
)
def v13(spark, d):
    k = F.col("page_id")
    incoming = B.assets(spark, d, 2).withColumn(
        "revision",
        F.when(k % 4 == 0, 0).when(k % 6 == 3, 1).otherwise(F.col("revision")).cast("bigint"),
    )
    return V.rollback_guard(B.assets(spark, d, 1), incoming)


@query(
    "v14_layout_columns",
    """WITH keys AS (SELECT DISTINCT event_type, unnest(['v' || event_id % 3, json_keys(props)[1]]) AS k FROM events),
 l AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' WHEN 3 THEN 'error' ELSE 'absent' END AS event_type,
   ['v' || s_nationkey % 9, 'w' || s_nationkey % 2] AS cols FROM supplier),
 x AS (SELECT s_suppkey, event_type, c, k.k IS NOT NULL AS known FROM (SELECT s_suppkey, event_type, unnest(cols) AS c FROM l) l LEFT JOIN keys k USING (event_type) WHERE k.k = l.c OR true),
 y AS (SELECT l.s_suppkey, c, EXISTS (SELECT 1 FROM keys k WHERE k.event_type = l.event_type AND k.k = l.c) AS known FROM (SELECT s_suppkey, event_type, unnest(cols) AS c FROM l) l)
SELECT s_suppkey, CASE WHEN bool_or(known) THEN '' ELSE string_agg(c, ',' ORDER BY c) END AS missing FROM y GROUP BY s_suppkey""",
)
def v14(spark, d):
    rows = B.table(spark, d, "events").select(
        "event_type",
        F.concat(
            F.array(F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string"))),
            F.json_object_keys("props"),
        ).alias("keys"),
    )
    k = F.col("s_suppkey")
    layouts = B.table(spark, d, "supplier").select(
        "s_suppkey",
        F.element_at(
            F.array(*[F.lit(x) for x in ("view", "click", "signup", "error", "absent")]), (k % 5 + 1).cast("int")
        ).alias("event_type"),
        F.array(
            F.concat(F.lit("v"), (F.col("s_nationkey") % 9).cast("string")),
            F.concat(F.lit("w"), (F.col("s_nationkey") % 2).cast("string")),
        ).alias("cols"),
    )
    return V.layout_mismatch(layouts, rows, "event_type", "cols", "keys").select("s_suppkey", "missing")


@query(
    "v15_missing_values",
    """WITH x AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN ' n/a ' WHEN 2 THEN 'NaN' WHEN 3 THEN 'None' WHEN 4 THEN 'NULL' WHEN 5 THEN '  ' ELSE p_name END AS v FROM part)
SELECT p_partkey, CASE WHEN lower(trim(v)) IN ('', 'na', 'n/a', 'nan', 'none', 'null') THEN '' ELSE v END AS v FROM x""",
)
def v15(spark, d):
    cases = ("NA", " n/a ", "NaN", "None", "NULL", "  ")
    v = F.coalesce(
        F.try_element_at(F.array(*[F.lit(x) for x in cases]), (F.col("p_partkey") % 7 + 1).cast("int")),
        F.col("p_name"),
    )
    return B.table(spark, d, "part").select("p_partkey", T.blank_missing(v).alias("v"))


@query(
    "v16_duration_limit",
    B.with_(B.NOTES) + """, m AS (SELECT song_id, max(end_ms) AS ms FROM notes GROUP BY 1)
SELECT c_custkey AS song_id, ms AS end_ms, coalesce(ms <= 26000, true) AS accepted FROM customer LEFT JOIN m ON song_id = c_custkey""",
)
def v16(spark, d):
    songs = B.table(spark, d, "customer").select(F.col("c_custkey").alias("song_id"))
    out = V.duration_check(songs, B.notes(spark, d), "song_id", F.col("end_ms"), 26_000)
    return out.withColumnRenamed("seconds", "end_ms")


@query(
    "v17_singable_flags",
    B.with_(B.WORDS) + """SELECT line_id, pos, word_id, cents, qty, qty % 4 = 0 AS unplaced, qty % 4 <> 0 AND flag = 'R' AS silent FROM words""",
)
def v17(spark, d):
    n = (F.col("qty") % 4).cast("int")
    w = B.words(spark, d).withColumns(
        {
            "note_ids": F.array_repeat(F.col("pos"), n),
            "kana": F.array_repeat(F.when(F.col("flag") == "R", "ー").otherwise("ラ"), n),
        }
    )
    return V.singable_flags(w, "note_ids", "kana").select(
        "line_id", "pos", "word_id", "cents", "qty", "unplaced", "silent"
    )


@query(
    "v18_lyric_coverage",
    B.with_(B.TURNS) + """SELECT song_id, count(*) AS n_lines, count(*) FILTER (role = 'assistant' AND song_id % 4 > 0) AS n_lyric_lines,
  CASE WHEN count(*) FILTER (role = 'assistant' AND song_id % 4 > 0) > 0 THEN count(*) FILTER (length(text) < 300) ELSE 0 END AS n_unmatched FROM turns GROUP BY song_id""",
)
def v18(spark, d):
    return V.lyric_coverage(
        B.turns(spark, d),
        "song_id",
        matched=F.length("text") >= 300,
        has_lyrics=(F.col("role") == "assistant") & (F.col("song_id") % 4 > 0),
    )
