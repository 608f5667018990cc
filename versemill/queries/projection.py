"""Filter, rule and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from versemill import bindings as B
from versemill.functions import text as T
from versemill.operators import projection as P
from versemill.queries.registry import query


@query(
    "p1_facet_filter",
    """SELECT p_partkey, p_name FROM part WHERE (p_type = 'ECONOMY' OR p_type = 'PROMO' OR p_brand = 'PROMO')
  AND (p_size = 11 OR p_size = 28 OR contains(p_name, 'red'))""",
)
def p1(spark, d):
    chosen = {
        "kind": [P.equals_any(["p_type"], "ECONOMY"), P.equals_any(["p_type", "p_brand"], "PROMO")],
        "size": [P.equals_any(["p_size"], 11), P.equals_any(["p_size"], 28), P.contains("p_name", "red")],
        "unused": [],
    }
    return B.table(spark, d, "part").where(P.facet_filter(chosen)).select("p_partkey", "p_name")


@query(
    "p2_default_facet_filter",
    B.with_(B.WORDLIST) + """SELECT list, id FROM wordlist WHERE list = 'STANDARD'
  OR (CAST(substr(original, 7) AS INT) % 3 = 0 AND size % 2 = 0)""",
)
def p2(spark, d):
    w = B.wordlist(spark, d).where(F.col("list") != "STANDARD")
    brand = F.substring("original", 7, 10).cast("int")
    value = lambda facet, c, ok: w.select(
        "list", F.lit(facet).alias("facet"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), ok.alias("is_default")
    ).distinct()
    facets = value("maker", "original", brand % 3 == 0).unionByName(value("length", "size", F.col("size") % 2 == 0))
    return P.default_filter(B.wordlist(spark, d), facets, "list", ["original", "size"]).select("list", "id")


@query(
    "p3_filter_round_trip",
    B.with_(B.WORDLIST) + """, f AS (SELECT list, id, CASE WHEN id % 2 = 0 THEN '(brand~=' || original || ') and (size~=' || size || ')'
     ELSE '(size~=' || size || ') and (brand~=' || original || '0)' END AS w FROM wordlist),
 n AS (SELECT *, '|' || replace(replace(replace(replace(w, ' or ', '|'), ' and ', '|'), '(', '|'), ')', '|') || '|' AS wn FROM f),
 b AS (SELECT DISTINCT list, original FROM wordlist), s AS (SELECT DISTINCT list, size FROM wordlist),
 bs AS (SELECT n.list, n.id, string_agg('brand~=' || original, ' or ' ORDER BY original) AS c FROM n JOIN b ON n.list = b.list AND contains(wn, '|brand~=' || original || '|') GROUP BY 1, 2),
 ss AS (SELECT n.list, n.id, string_agg('size~=' || s.size, ' or ' ORDER BY s.size) AS c FROM n JOIN s ON n.list = s.list AND contains(wn, '|size~=' || s.size || '|') GROUP BY 1, 2)
SELECT n.list, n.id, concat_ws(' and ', '(' || bs.c || ')', '(' || ss.c || ')') AS restored, concat_ws(' and ', '(' || bs.c || ')', '(' || ss.c || ')') = w AS survives
FROM n LEFT JOIN bs USING (list, id) LEFT JOIN ss USING (list, id)""",
)
def p3(spark, d):
    w = B.wordlist(spark, d)
    brand, size = F.concat(F.lit("brand~="), "original"), F.concat(F.lit("size~="), F.col("size").cast("string"))
    filters = w.select(
        "list",
        "id",
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("("), brand, F.lit(") and ("), size, F.lit(")")))
        .otherwise(F.concat(F.lit("("), size, F.lit(") and ("), brand, F.lit("0)")))
        .alias("w"),
    )
    facets = (
        w.select("list", F.lit(1).alias("facet_no"), F.col("original").alias("value_no"), brand.alias("fragment"))
        .unionByName(
            w.select("list", F.lit(2).alias("facet_no"), F.lpad(F.col("size").cast("string"), 9, "0").alias("value_no"), size.alias("fragment"))
        )
        .distinct()
    )
    return P.survives_round_trip(filters, facets, "list", "w").select("list", "id", "restored", "survives")


@query(
    "p4_element_visibility",
    """SELECT page_id, starts_with(url, 'https:') AS secure, NOT starts_with(url, 'https:') AS plain,
  page_id % 3 > 0 AND NOT starts_with(url, 'http://') AS both, page_id % 3 = 0 AS untitled FROM pages""",
)
def p4(spark, d):
    p = B.table(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, "N/A").otherwise("t").alias("title"))
    return p.select(
        "page_id",
        P.element_visible(require_prefix={"url": "https:"}).alias("secure"),
        P.element_visible(require_not_prefix={"url": "https:"}).alias("plain"),
        P.element_visible(require="title", require_not_prefix={"url": "http://"}).alias("both"),
        P.element_visible(require_empty="title").alias("untitled"),
    )


@query(
    "p5_shown_or_fallback",
    """WITH x AS (SELECT p_partkey, p_partkey % 5 = 0 AS miss, p_partkey % 3 = 0 AS img, p_size % 2 = 0 AS need, p_partkey % 7 > 0 AS tx, p_size % 3 > 0 AS fb FROM part),
 y AS (SELECT *, miss OR (NOT img AND (need OR NOT tx)) AS use_fallback FROM x)
SELECT p_partkey, use_fallback, img OR CASE WHEN use_fallback THEN fb ELSE tx END AS shown FROM y""",
)
def p5(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = B.table(spark, d, "part").select(
        "p_partkey",
        "p_size",
        F.when(k % 3 == 0, "a.png").otherwise("NA").alias("image"),
        F.array(F.lit(" "), F.when(k % 7 > 0, F.col("p_name")).otherwise("")).alias("texts"),
        F.array(F.when(s % 3 > 0, F.col("p_name")).otherwise("")).alias("fallback_texts"),
    )
    return P.route(rows, k % 5 == 0, "image", s % 2 == 0, "texts", "fallback_texts").select(
        "p_partkey", "use_fallback", "shown"
    )


@query(
    "p6_template_projection",
    """WITH x AS (SELECT *, CASE WHEN c_custkey % 3 > 0 THEN CAST(1900 + c_custkey % 90 AS VARCHAR) ELSE 'NA' END AS b,
   CASE WHEN c_custkey % 4 > 1 THEN CAST(1990 + c_custkey % 30 AS VARCHAR) ELSE '' END AS e FROM customer)
SELECT c_custkey, trim('[' || c_name || '] ' || c_mktsegment || ' ') AS label, CASE WHEN b <> 'NA' AND e <> '' THEN b || '-' || e WHEN b <> 'NA' THEN b || '年生まれ'
  WHEN e <> '' THEN e || '年没' ELSE '' END AS lifespan FROM x""",
)
def p6(spark, d):
    k = F.col("c_custkey")
    c = B.table(spark, d, "customer").select(
        "c_custkey",
        "c_name",
        "c_mktsegment",
        F.when(k % 3 > 0, (1900 + k % 90).cast("string")).otherwise("NA").alias("birth_year"),
        F.when(k % 4 > 1, (1990 + k % 30).cast("string")).otherwise("").alias("death_year"),
    )
    return c.select(
        "c_custkey",
        P.template("[{c_name}] {c_mktsegment} {unknown}", c.columns).alias("label"),
        P.lifespan(F.col("birth_year"), F.col("death_year")).alias("lifespan"),
    )


@query(
    "p7_typed_parameters",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'bool' WHEN 'click' THEN 'int' WHEN 'signup' THEN 'string' ELSE 'float' END AS kind,
  CASE WHEN event_type = 'view' THEN user_id % 2 = 0 END AS flag, CASE WHEN event_type = 'click' THEN user_id END AS whole,
  CASE WHEN event_type IN ('purchase', 'error') THEN value WHEN event_type = 'click' THEN CAST(user_id AS DOUBLE) END AS real,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
def p7(spark, d):
    value = (
        F.when(F.col("event_type") == "view", F.when(F.col("user_id") % 2 == 0, "True").otherwise("false"))
        .when(F.col("event_type") == "click", F.col("user_id").cast("string"))
        .when(F.col("event_type") == "signup", "high")
        .otherwise(F.col("value").cast("string"))
    )
    k = F.get_json_object("props", "$.k")
    spec = F.concat(F.lit("A=old; K = "), k, F.lit(" |junk\nA="), value)
    m = P.parse_params(F.col("spec"))
    t = P.typed_value(F.col("m")["A"])
    return (
        B.table(spark, d, "events")
        .select("event_id", spec.alias("spec"))
        .select("event_id", m.alias("m"))
        .select("event_id", t.alias("t"), F.col("m")["K"].cast("bigint").alias("k"))
        .select("event_id", "t.kind", "t.flag", "t.whole", "t.real", "k")
    )


@query(
    "p8_time_window_slice",
    B.with_(B.NOTES) + """, n AS (SELECT *, note_id % 8 AS line_id FROM notes), k AS (SELECT * FROM n WHERE start_ms >= 5000 AND start_ms < 9000)
SELECT song_id, line_id, count(*) AS n_notes FROM n SEMI JOIN k USING (song_id, line_id) GROUP BY 1, 2""",
)
def p8(spark, d):
    n = B.notes(spark, d).withColumn("line_id", F.col("note_id") % 8)
    _, lines = P.time_slice(n, n, ["song_id", "line_id"], F.col("start_ms"), F.lit(5000), F.lit(9000))
    return lines.groupBy("song_id", "line_id").agg(F.count("*").alias("n_notes"))


@query(
    "p9_preview_window",
    B.with_(B.NOTES) + """, n AS (SELECT *, start_ms // 2000 AS line_id FROM notes)
SELECT song_id, min(start_ms) AS head_start, (list(line_id ORDER BY pitch DESC, line_id))[1] AS high_line, (list(line_id ORDER BY pitch, line_id))[1] AS low_line FROM n GROUP BY song_id""",
)
def p9(spark, d):
    n = B.notes(spark, d).withColumn("line_id", F.expr("start_ms div 2000"))
    return P.preview_windows(n, "song_id", "line_id", "start_ms", "pitch")


@query(
    "p10_owner_jobs",
    B.with_(B.JOBS) + "SELECT owner, job_id, status, row_number() OVER (PARTITION BY owner ORDER BY created_h DESC, job_id DESC) AS place FROM jobs",
)
def p10(spark, d):
    return P.owner_jobs(B.jobs(spark, d), "owner", "created_h", "job_id", 168).select("owner", "job_id", "status", "place")


@query(
    "p11_accompaniment",
    B.with_(B.NOTES) + "SELECT note_id, channel, start_ms, CASE WHEN channel = 'error' THEN pitch ELSE greatest(0, least(127, pitch + 40)) END AS pitch FROM notes WHERE channel <> 'view'",
)
def p11(spark, d):
    c = F.col("channel")
    out = P.accompaniment(B.notes(spark, d), c == "view", c == "error", "pitch", F.lit(40))
    return out.select("note_id", "channel", "start_ms", "pitch")


_DOT = r"regexp_replace({}, '([^\x00-\x7f])-([^\x00-\x7f])', '\1・\2', 'g')"


@query(
    "p12_display_value",
    f"SELECT doc_id, md5({_DOT.format(_DOT.format(chr(39).join(['replace(text, ', 'é', ', ', 'é-é', ')'])))}) AS shown FROM documents",
)
def p12(spark, d):
    hyphened = F.replace("text", F.lit("é"), F.lit("é-é"))
    return B.documents(spark, d).select("doc_id", F.md5(T.display_value(hyphened)).alias("shown"))


@query(
    "p13_word_record",
    B.with_(B.WORDS) + """SELECT w.line_id, w.pos, w.cents, CASE WHEN w.qty % 3 = 0 THEN 'word ' || w.word_id ELSE p_name END AS surface,
  coalesce(CASE WHEN w.qty % 5 = 0 THEN w.flag END, p_brand) AS original, p_type FROM words w LEFT JOIN part ON p_partkey = w.word_id""",
)
def p13(spark, d):
    rows = B.table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("surface"), F.col("p_brand").alias("original"), "p_type"
    )
    q = F.col("qty")
    own = {
        "surface": F.when(q % 3 == 0, F.concat(F.lit("word "), F.col("word_id").cast("string"))).otherwise(" "),
        "original": F.when(q % 5 == 0, F.col("flag")),
    }
    out = P.word_record(B.words(spark, d), rows, F.col("word_id") == F.col("p_partkey"), own)
    return out.select("line_id", "pos", "cents", "surface", "original", "p_type")


@query(
    "p14_default_rows",
    B.with_(B.JOBS) + """, t AS (SELECT owner AS song_id, created_h - 300 AS tick, cents % 900000 + 100000 AS tempo FROM jobs WHERE created_h >= 300 AND status <> 'P'), m AS (SELECT song_id, min(tick) AS f FROM t GROUP BY 1)
SELECT song_id, tick, tempo FROM t UNION ALL SELECT c_custkey, 0, 500000 FROM customer LEFT JOIN m ON song_id = c_custkey WHERE f IS NULL OR f > 0""",
)
def p14(spark, d):
    j = B.jobs(spark, d).where((F.col("created_h") >= 300) & (F.col("status") != "P"))
    t = j.select(F.col("owner").alias("song_id"), (F.col("created_h") - 300).alias("tick"), (F.col("cents") % 900_000 + 100_000).alias("tempo"))
    songs = B.table(spark, d, "customer").select(F.col("c_custkey").alias("song_id"))
    return P.inject_default(t, songs, "song_id", "tick", {"tempo": F.lit(500_000).cast("bigint")})
