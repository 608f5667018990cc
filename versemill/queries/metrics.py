"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from versemill import bindings as B
from versemill.functions import music as MU
from versemill.operators import metrics as A
from versemill.operators import validation as V
from versemill.queries.joins import _FRAMES, _SPANS, _frames
from versemill.queries.registry import query

BY, ORDER = ["song_id"], ["start_ms", "note_id"]
N = B.with_(B.NOTES)
WIN = "WINDOW w AS (PARTITION BY song_id ORDER BY start_ms, note_id)"


@query(
    "a1_channel_hit_rate",
    N + """, t AS (SELECT song_id, note_id, start_ms AS tt FROM notes WHERE channel = 'error'),
 c AS (SELECT t.song_id, n.channel, t.note_id, bool_or(abs(n.start_ms - t.tt) <= 200) AS hit FROM t JOIN notes n ON n.song_id = t.song_id WHERE n.channel <> 'error' GROUP BY 1, 2, 3),
 r AS (SELECT song_id, channel, count(*) AS n_ticks, count(*) FILTER (hit) AS n_hits FROM c GROUP BY 1, 2),
 o AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY n_hits / n_ticks < 0.9, CASE WHEN n_hits / n_ticks >= 0.9 THEN 0 ELSE -(n_hits / n_ticks) END,
   CASE channel WHEN 'view' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, channel) AS k FROM r)
SELECT song_id, channel, n_hits, n_ticks FROM o WHERE k = 1""",
)
def a1(spark, d):
    n = B.notes(spark, d)
    t = n.where(F.col("channel") == "error").select("song_id", "note_id", F.col("start_ms").alias("at"))
    return A.channel_hit_rate(t, n.where(F.col("channel") != "error"), BY, "channel", "at", "start_ms", 200, 1000, ["view", "signup"])


@query(
    "a2_monophony",
    N + """, g AS (SELECT *, lead(start_ms) OVER (PARTITION BY song_id, channel ORDER BY start_ms, note_id) AS nx FROM notes WHERE channel <> 'click'),
 r AS (SELECT song_id, channel, count(*) AS n, count(*) FILTER (end_ms <= nx) AS n_clear, sum(pitch) AS p FROM g GROUP BY 1, 2),
 s AS (SELECT *, CASE WHEN n < 2 THEN 1.0 ELSE n_clear / (n - 1) END AS ratio FROM r)
SELECT song_id, channel, n, n_clear, round(ratio, 6) AS ratio, round(ratio * ratio * p / n, 6) AS score FROM s""",
)
def a2(spark, d):
    out = A.monophony(B.notes(spark, d), ["song_id", "channel"], BY, ORDER, B.song_slice(), "start_ms", "end_ms", "pitch", F.col("channel") == "click")
    return out.withColumns({"ratio": F.round("ratio", 6), "score": F.round("score", 6)})


_PAIRS = f"pr AS (SELECT song_id, channel, pitch - lag(pitch) OVER w AS pd, start_ms - lag(start_ms) OVER w AS td FROM notes {WIN}), pairs AS (SELECT * FROM pr WHERE pd IS NOT NULL AND channel <> 'view')"


def _pairs(spark, d):
    from versemill.plans.ordered import lag, scan

    n = scan(B.notes(spark, d), BY, ORDER, B.song_slice(), pp=lag("pitch"), ps=lag("start_ms"))
    return n.where(F.col("pp").isNotNull() & (F.col("channel") != "view")).select(
        "song_id", "channel", (F.col("pitch") - F.col("pp")).alias("pd"), (F.col("start_ms") - F.col("ps")).alias("td")
    )


_slice = lambda w: lambda c: F.floor(F.col(c) / w)


@query(
    "a3_contour_match",
    B.with_(B.NOTES, _PAIRS) + """, tot AS (SELECT song_id, channel, count(*) * 2 AS n_moras, count(*) AS n_notes FROM notes GROUP BY 1, 2),
 m AS (SELECT song_id, channel, median(pd) AS mid, count(*) AS n FROM pairs GROUP BY 1, 2),
 v AS (SELECT p.song_id, p.channel, median(abs(pd - mid)) AS mad FROM pairs p JOIN m USING (song_id, channel) GROUP BY 1, 2)
SELECT song_id, channel, n AS n_pairs, CAST(mid AS DOUBLE) AS median_diff, CAST(mad AS DOUBLE) AS mad, round(n / n_moras - mad / 24, 6) AS score FROM tot JOIN m USING (song_id, channel) JOIN v USING (song_id, channel)""",
)
def a3(spark, d):
    tot = B.notes(spark, d).groupBy("song_id", "channel").agg((F.count("*") * 2).alias("n_moras"), F.count("*").alias("n_notes"))
    return A.contour_match(_pairs(spark, d), tot, ["song_id", "channel"], "pd", _slice(16)).withColumn("score", F.round("score", 6))


@query("a4_transposition", B.with_(B.NOTES, _PAIRS) + "SELECT song_id, CAST(round_even(median(pd), 0) AS BIGINT) AS transpose FROM pairs GROUP BY 1")
def a4(spark, d):
    return A.transposition(_pairs(spark, d), BY, "pd", _slice(16)("pd"))


@query(
    "a6_modal_pitch",
    B.with_(B.NOTES, B.JOBS, _SPANS, _FRAMES) + """, m AS (SELECT job_id, median(pitch // 2) AS mid, count(*) AS n FROM fr GROUP BY 1), h AS (SELECT job_id, pitch // 2 AS s, count(*) AS c FROM fr GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY c DESC, abs(s - mid), s) AS k FROM h JOIN m USING (job_id))
SELECT job_id, n, greatest(36, least(96, s)) AS midi FROM r WHERE k = 1""",
)
def a6(spark, d):
    f = _frames(spark, d).withColumn("pitch", F.expr("pitch div 2"))
    return A.modal_pitch(f, ["job_id"], "pitch")


@query(
    "a7_shift_plan",
    B.with_(B.NOTES) + """, g AS (SELECT k, k + o AS v FROM unnest(range(-6, 7)) AS a(k), unnest([0, 12, -12, 24, -24]) AS b(o)),
 h AS (SELECT song_id, channel, pitch, count(*) AS c FROM notes GROUP BY 1, 2, 3),
 r AS (SELECT song_id, channel, k, v, sum(CASE WHEN pitch + v < 54 OR pitch + v > 54 + 24 + song_id % 30 THEN c ELSE 0 END) AS o FROM h, g GROUP BY 1, 2, 3, 4),
 p AS (SELECT song_id, channel, o, v, row_number() OVER (PARTITION BY song_id, channel ORDER BY o, abs(v), -v) AS n FROM r WHERE k = 0),
 q AS (SELECT song_id, channel, o, v, k, row_number() OVER (PARTITION BY song_id, channel ORDER BY o, abs(k), abs(v), v, k) AS n FROM r)
SELECT p.song_id, p.channel, CAST(CASE WHEN p.channel <> 'view' AND p.o > 0 THEN q.v ELSE p.v END AS BIGINT) AS vocal_shift,
  CAST(CASE WHEN p.channel <> 'view' AND p.o > 0 THEN q.k ELSE 0 END AS BIGINT) AS key_shift, CAST(CASE WHEN p.channel <> 'view' AND p.o > 0 THEN q.o ELSE p.o END AS BIGINT) AS out_of_range
FROM p JOIN q ON p.song_id = q.song_id AND p.channel = q.channel AND p.n = 1 AND q.n = 1""",
)
def a7(spark, d):
    return A.shift_plan(
        B.notes(spark, d), ["song_id", "channel"], "pitch", F.lit(54), F.lit(78) + F.col("song_id") % 30, F.col("channel") != "view"
    )


@query(
    "a8_evaluation_report",
    B.with_(B.NOTES, _PAIRS) + """, tot AS (SELECT song_id, count(*) AS n_truth FROM notes GROUP BY 1),
 m AS (SELECT song_id, round_even(median(pd), 0) AS tr, median(td) AS off FROM pairs GROUP BY 1), x AS (SELECT song_id, tr, off, pd - tr AS r, abs(td - off) AS t FROM pairs JOIN m USING (song_id))
SELECT song_id, count(*) AS n_matched, round(count(*) / any_value(n_truth), 6) AS coverage, CAST(any_value(tr) AS BIGINT) AS transpose, round(count(*) FILTER (r = 0) / count(*), 6) AS pitch_acc,
  round(count(*) FILTER (abs(r) <= 1) / count(*), 6) AS pitch_acc1, CAST(any_value(off) AS DOUBLE) AS time_offset, round(sum(t) / count(*), 6) AS onset_mae,
  CAST((list(t ORDER BY t))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS DOUBLE) AS onset_p90 FROM x JOIN tot USING (song_id) GROUP BY 1""",
)
def a8(spark, d):
    tot = B.notes(spark, d).groupBy("song_id").agg(F.count("*").alias("n_truth"))
    out = A.evaluation_report(_pairs(spark, d), tot, BY, "pd", "td", _slice(16), _slice(64))
    rounded = {c: F.round(c, 6) for c in ("coverage", "pitch_acc", "pitch_acc1", "onset_mae")}
    return out.withColumns(rounded)


@query(
    "a9_first_seen_words",
    B.with_(B.WORDS) + """, v AS (SELECT line_id, pos, word_id, cents, CASE WHEN qty % 4 = 0 THEN 'w' || word_id % 9 ELSE flag END AS value FROM words WHERE qty % 7 <> 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY line_id, value ORDER BY pos, word_id, cents) AS k FROM v) SELECT line_id, value, pos, word_id, cents FROM r WHERE k = 1""",
)
def a9(spark, d):
    w = B.words(spark, d)
    value = F.when(F.col("qty") % 4 == 0, F.concat(F.lit("w"), (F.col("word_id") % 9).cast("string"))).otherwise(F.col("flag"))
    return A.first_seen(w, ["line_id"], value, ["pos", "word_id", "cents"], F.col("qty") % 7 != 0)


@query(
    "a10_credits_by_image",
    """SELECT img, page_id, word FROM (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS img, page_id, html AS word, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]*)', 1) ORDER BY page_id) AS k FROM pages) WHERE k = 1""",
)
def a10(spark, d):
    from versemill.plans.ordered import first_row

    p = B.table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("img"), "page_id", F.col("html").alias("word"))
    return first_row(p, ["img"], ["page_id"])


@query(
    "a11_first_known_merge",
    """WITH u AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, page_id, CASE WHEN page_id % 3 > 0 THEN 'p' || page_id ELSE ' ' END AS page, CASE WHEN page_id % 5 = 0 THEN 'c' || page_id END AS credit FROM pages)
SELECT host, arg_min(page, page_id) FILTER (trim(page) <> '') AS page, arg_min(credit, page_id) FILTER (credit IS NOT NULL) AS credit, count(*) AS n_rows FROM u GROUP BY host""",
)
def a11(spark, d):
    i = F.col("page_id")
    u = B.table(spark, d, "pages").select(
        F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), "page_id",
        F.when(i % 3 > 0, F.concat(F.lit("p"), i.cast("string"))).otherwise(" ").alias("page"),
        F.when(i % 5 == 0, F.concat(F.lit("c"), i.cast("string"))).alias("credit"),
    )
    return A.merge_first_known(u, "host", ["page_id"], ["page", "credit"])


@query(
    "a12_manifest_health",
    """WITH e AS (SELECT page_id % 20 AS gen, CASE WHEN page_id % 11 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN page_id % 9 <> 0 THEN 'c' END AS credit, CASE WHEN page_id % 13 <> 0 THEN 'f' END AS lp, page_id % 6 = 0 AS orph FROM pages)
SELECT gen, count(*) FILTER (NOT orph) AS n_active, count(*) FILTER (NOT orph AND status = 'ok') AS n_available, count(*) FILTER (NOT orph AND status = 'failed') AS n_failed,
  count(*) FILTER (NOT orph AND credit IS NULL) AS n_credit_unknown, count(*) FILTER (NOT orph AND status = 'ok' AND lp IS NULL) AS n_missing_files,
  count(*) FILTER (NOT orph AND (status = 'failed' OR credit IS NULL OR lp IS NULL)) = 0 AS promotable FROM e GROUP BY gen""",
)
def a12(spark, d):
    i = F.col("page_id")
    e = B.table(spark, d, "pages").select(
        (i % 20).alias("gen"), F.when(i % 11 == 0, "failed").otherwise("ok").alias("status"), F.when(i % 9 != 0, "c").alias("credit"),
        F.when(i % 13 != 0, "f").alias("local_path"), F.when(i % 6 == 0, "t").alias("orphaned_at"),
    )
    return A.manifest_health(e, ["gen"])


_DIFF = """o AS (SELECT url, page_id, sha256, CASE WHEN page_id % 11 = 0 THEN '2023-12-01' END AS orphaned_at FROM assets1),
 df AS (SELECT coalesce(o.url, n.url) AS url, CASE WHEN n.url IS NULL THEN 'orphaned' WHEN o.url IS NULL THEN 'new' WHEN n.sha256 <> o.sha256 THEN 'updated' ELSE 'unchanged' END AS status,
  coalesce(n.sha256, o.sha256) AS sha256, CASE WHEN n.url IS NULL THEN coalesce(o.orphaned_at, '2024-01-01') END AS orphaned_at FROM o FULL JOIN assets2 n ON o.url = n.url)"""


def _diff(spark, d):
    old = B.assets(spark, d, 1).withColumn("orphaned_at", F.when(F.col("page_id") % 11 == 0, "2023-12-01"))
    return A.generation_diff(old, B.assets(spark, d, 2), "2024-01-01")


@query("j16_generation_diff", B.with_(B.ASSETS1, B.ASSETS2, _DIFF) + "SELECT url, status, sha256, orphaned_at FROM df")
def j16(spark, d):
    return _diff(spark, d)


@query(
    "a20_sync_counters",
    B.with_(B.ASSETS1, B.ASSETS2, _DIFF) + """SELECT count(*) FILTER (status <> 'orphaned') AS total, count(*) FILTER (status = 'new') AS "new", count(*) FILTER (status = 'updated') AS updated,
  count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'orphaned') AS orphaned FROM df""",
)
def a20(spark, d):
    return A.sync_counters(_diff(spark, d))


@query(
    "a13_variant_volume",
    f"""WITH w AS (SELECT source, unnest({B.words_sql("text")}) AS w FROM documents) SELECT source, CAST(length(w) AS BIGINT) AS n_units, count(*) AS n_variants FROM w GROUP BY 1, 2""",
)
def a13(spark, d):
    from versemill.operators.soundalike import text_words

    return A.variant_volume(text_words(B.documents(spark, d), "text", "source"), ["source"], F.length("word").cast("bigint"))


@query(
    "a13_line_unit_bound",
    r"""WITH s AS (SELECT song_id, line_id, sum(length(w) % 4 + 1) AS s FROM (SELECT conv_id AS song_id, turn AS line_id, unnest(regexp_extract_all(text, '[^\s]+')) AS w FROM conversations) GROUP BY 1, 2)
SELECT song_id, CAST(max(s) + 2 AS BIGINT) AS max_units FROM s GROUP BY 1""",
)
def a13_bound(spark, d):
    w = B.turns(spark, d).select("song_id", "line_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), 0)).alias("w"))
    return A.line_unit_bound(w, BY, ["line_id"], F.length("w") % 4 + 1)


@query(
    "a14_peak_envelope",
    """WITH s AS (SELECT vec_id, (i - 1) // 8 AS block, max(abs(CAST(embedding[i] AS DOUBLE))) AS p FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i) GROUP BY 1, 2)
SELECT vec_id, block, round(p / max(p) OVER (PARTITION BY vec_id), 3) AS peak FROM s""",
)
def a14(spark, d):
    s = B.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).withColumn("e", F.col("e").cast("double"))
    return A.peak_envelope(s, ["vec_id"], "i", "e", 8)


@query(
    "a15_roll_up_lines",
    B.with_(B.WORDS) + """SELECT line_id, pos // 1000 AS part, string_agg(word_id || flag, '' ORDER BY pos, word_id, cents) AS kana, string_agg(flag, '' ORDER BY pos, word_id, cents) AS flag, count(*) AS n FROM words GROUP BY 1, 2""",
)
def a15(spark, d):
    w = B.words(spark, d).withColumn("kana", F.concat(F.col("word_id").cast("string"), "flag"))
    out = A.roll_up_lines(w, ["line_id"], ["pos", "word_id", "cents"], ["kana", "flag"], "word_id", F.floor(F.col("pos") / 1000))
    return out.select("line_id", "part", "kana", "flag", F.size("note_ids").cast("bigint").alias("n"))


@query(
    "a16_stage_durations",
    N + "SELECT channel AS stage, song_id AS job, CAST(sum(end_ms - start_ms) AS BIGINT) AS seconds, count(*) AS n FROM notes GROUP BY GROUPING SETS ((channel), (song_id), ())",
)
def a16(spark, d):
    n = B.notes(spark, d).select(F.col("channel").alias("stage"), F.col("song_id").alias("job"), "start_ms", "end_ms")
    return A.stage_durations(n, "job", "stage", "start_ms", "end_ms")


@query(
    "a18_headline_words",
    B.with_(B.WORDS) + """, w AS (SELECT line_id, pos, word_id, cents, CASE WHEN qty % 3 > 0 THEN 'w' || word_id ELSE '' END AS w, qty % 5 > 1 AS filler FROM words),
 r AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY pos, word_id, cents) AS k FROM w WHERE w <> ''), a AS (SELECT line_id, bool_or(NOT filler) AS real FROM w GROUP BY 1),
 t AS (SELECT line_id, string_agg(w, ' ' ORDER BY k) AS t FROM r WHERE k <= 4 GROUP BY 1) SELECT line_id, CASE WHEN a.real THEN coalesce(t, '') ELSE '' END AS headline FROM a LEFT JOIN t USING (line_id)""",
)
def a18(spark, d):
    q = F.col("qty")
    w = B.words(spark, d).withColumns({"w": F.when(q % 3 > 0, F.concat(F.lit("w"), F.col("word_id").cast("string"))).otherwise(""), "filler": q % 5 > 1})
    return A.headline_words(w, ["line_id"], ["pos", "word_id", "cents"], "w", "filler")


@query(
    "a19_representative_row",
    B.with_(B.WORDLIST) + "SELECT original, id, surface FROM (SELECT *, row_number() OVER (PARTITION BY original ORDER BY size % 4 <> 0, id) AS k FROM wordlist) WHERE k = 1",
)
def a19(spark, d):
    w = B.wordlist(spark, d).select("original", "id", "surface", "size")
    return V.representative_rows(w, ["original"], F.col("size") % 4 == 0, ["id"]).select("original", "id", "surface")


@query(
    "a21_planned_length",
    N + """, m AS (SELECT song_id, max(end_ms) AS s FROM notes GROUP BY 1), a AS (SELECT c_custkey AS song_id, CASE WHEN c_custkey % 3 > 0 THEN 25000 + c_custkey % 2000 END AS al, c_custkey % 4 AS pages FROM customer),
 t AS (SELECT a.*, s, greatest(coalesce(s + 300, 0), coalesce(al, 0)) AS total FROM a LEFT JOIN m USING (song_id))
SELECT song_id, total, CASE WHEN pages > 0 AND total - coalesce(s, 0) < 600 THEN total + (pages + 1) * 300 ELSE total END AS planned FROM t""",
)
def a21(spark, d):
    k = F.col("c_custkey")
    audio = B.table(spark, d, "customer").select(k.alias("song_id"), F.when(k % 3 > 0, 25_000 + k % 2000).alias("audio_len"), (k % 4).alias("pages"))
    return A.planned_length(B.notes(spark, d), audio, BY, "end_ms", 300, 300, 600).select("song_id", "total", "planned")


@query(
    "a22_mix_gain",
    """WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE -s_acctbal / 120 END AS v, -CAST(s_nationkey AS DOUBLE) * 3 AS b FROM supplier)
SELECT s_suppkey, round(CASE WHEN v > -70 AND b > -70 THEN least(0.6, greatest(0.15, pow(10.0, (v - 2.0 - b) / 20))) ELSE 0.6 END, 6) AS gain FROM x""",
)
def a22(spark, d):
    v = F.when(F.col("s_suppkey") % 7 != 0, -F.col("s_acctbal") / 120)
    b = -F.col("s_nationkey").cast("double") * 3
    return B.table(spark, d, "supplier").select("s_suppkey", F.round(MU.accompaniment_gain(v, b), 6).alias("gain"))


@query(
    "a23_token_spans",
    B.with_(B.WORDS) + """, t AS (SELECT line_id, pos, cents, word_id AS s, word_id + qty AS e, singer_id AS sc FROM words WHERE qty % 6 <> 0), m AS (SELECT DISTINCT line_id, pos FROM words),
 r AS (SELECT *, row_number() OVER (PARTITION BY line_id, pos ORDER BY cents, s, e) AS a, row_number() OVER (PARTITION BY line_id, pos ORDER BY cents DESC, s DESC, e DESC) AS z FROM t)
SELECT m.line_id, m.pos, max(CASE WHEN a = 1 THEN s END) AS start, max(CASE WHEN z = 1 THEN e END) AS "end", max(CASE WHEN a = 1 THEN sc END) AS score FROM m LEFT JOIN r USING (line_id, pos) GROUP BY 1, 2""",
)
def a23(spark, d):
    w = B.words(spark, d)
    key = F.struct("cents", "word_id", "qty").alias("k")
    t = w.where(F.col("qty") % 6 != 0).select("line_id", "pos", key, F.col("word_id").alias("start"), (F.col("word_id") + F.col("qty")).alias("end"), F.col("singer_id").alias("score"))
    return A.token_spans_to_moras(w.select("line_id", "pos").distinct(), t, ["line_id"], "pos", "k")


@query(
    "a24_score_digest",
    B.with_(B.TURNS) + """, t AS (SELECT song_id, string_agg(text, '' ORDER BY line_id) AS t, count(*) FILTER (role = 'user') AS n_sung FROM turns GROUP BY 1)
SELECT song_id, CAST(length(t) AS BIGINT) AS n_chars, n_sung, CASE WHEN length(t) > 40 THEN left(t, 20) || '…' || right(t, 20) ELSE t END AS digest FROM t""",
)
def a24(spark, d):
    return A.score_digest(B.turns(spark, d), BY, ["line_id"], "text", F.col("role") == "user")


_U = "u AS (SELECT note_id, 'note' AS kind, start_ms AS at FROM notes)"


@query("k1_lexicographic_argmin", B.with_(B.WORDS) + "SELECT word_id, line_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY qty DESC, abs(cents - 5000000), line_id, pos, cents) AS k FROM words) WHERE k = 1")
def k1(spark, d):
    from versemill.plans.ordered import first_row

    w = B.words(spark, d).withColumns({"a": -F.col("qty"), "b": F.abs(F.col("cents") - 5_000_000)})
    return first_row(w, ["word_id"], ["a", "b", "line_id", "pos", "cents"]).select("word_id", "line_id", "pos")


@query("k2_top_k_per_group", B.with_(B.WORDS) + "SELECT singer_id, line_id, pos, cents, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY singer_id ORDER BY cents DESC, line_id, pos, word_id) AS k FROM words) WHERE k <= 5")
def k2(spark, d):
    from versemill.plans.ordered import top_rows

    out = top_rows(B.words(spark, d), ["singer_id"], [F.col("cents").desc(), F.col("line_id"), F.col("pos"), F.col("word_id")], 5)
    return out.select("singer_id", "line_id", "pos", "cents", F.col("rank").cast("bigint").alias("rank"))


@query("k3_song_order_sort", N + "SELECT song_id, start_ms, pitch, note_id FROM notes ORDER BY song_id, start_ms, pitch DESC, note_id")
def k3(spark, d):
    return B.notes(spark, d).select("song_id", "start_ms", "pitch", "note_id").orderBy("song_id", "start_ms", F.col("pitch").desc(), "note_id")


@query(
    "u1_timeline_union",
    N + """SELECT song_id, 'word' AS kind, start_ms AS s, end_ms AS e FROM notes WHERE channel <> 'view' UNION ALL SELECT song_id, 'title', 0, min(start_ms) FROM notes GROUP BY 1
UNION ALL SELECT song_id, 'section', max(end_ms), max(end_ms) + 300 FROM notes GROUP BY 1""",
)
def u1(spark, d):
    n = B.notes(spark, d)
    part = lambda df, kind, s, e: df.select("song_id", F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"))
    g = n.groupBy("song_id").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("z"))
    words = part(n.where(F.col("channel") != "view"), "word", F.col("start_ms"), F.col("end_ms"))
    title = part(g, "title", F.lit(0).cast("bigint"), F.col("a"))
    section = part(g, "section", F.col("z"), F.col("z") + 300)
    return words.unionByName(title).unionByName(section).orderBy("song_id", "s", "e", "kind")


@query(
    "u2_ordered_name_union",
    """WITH n AS (SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority, 'F', o_orderstatus || '1', 'surface']) AS c, generate_subscripts([1, 2, 3, 4, 5], 1) AS i FROM orders),
 f AS (SELECT o_orderkey, c, min(i) AS i FROM n GROUP BY 1, 2) SELECT o_orderkey, string_agg(c, ',' ORDER BY i) AS names FROM f GROUP BY 1""",
)
def u2(spark, d):
    fields = F.array("o_orderstatus", "o_orderpriority")
    columns = F.array(F.lit("F"), F.concat("o_orderstatus", F.lit("1")), F.lit("surface"))
    return B.table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_distinct(F.concat(fields, columns)), ",").alias("names"))


@query("u3_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u3(spark, d):
    return B.table(spark, d, "documents").select("doc_id").join(B.table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_anti")


@query("u4_intersection", f"SELECT word FROM (SELECT unnest({B.words_sql("text")}) AS word FROM documents) INTERSECT SELECT unnest({B.words_sql("text")}) FROM benchmark")
def u4(spark, d):
    from versemill.operators.soundalike import text_words

    lines = text_words(B.table(spark, d, "benchmark").select("text"), "text").distinct()
    return text_words(B.documents(spark, d), "text").distinct().join(lines, "word", "left_semi")


@query(
    "a17_throughput_factor",
    B.with_(B.JOBS).replace("WITH", "WITH RECURSIVE", 1) + """, r AS (SELECT owner, job_id, created_h, (cents % 90 + 1) / (job_id % 50 + 1) AS x, row_number() OVER (PARTITION BY owner ORDER BY created_h, job_id) AS rn FROM jobs WHERE job_id % 50 <> 7),
 f AS (SELECT owner, job_id, rn, CAST(printf('%.4f', x) AS DOUBLE) AS factor FROM r WHERE rn = 1 UNION ALL SELECT r.owner, r.job_id, r.rn, CAST(printf('%.4f', 0.7::DOUBLE * f.factor + 0.3::DOUBLE * r.x) AS DOUBLE) FROM f JOIN r ON r.owner = f.owner AND r.rn = f.rn + 1)
SELECT job_id, factor FROM f""",
)
def a17(spark, d):
    j = B.jobs(spark, d)
    wall = (F.col("cents") % 90 + 1).cast("double")
    score = F.when(F.col("job_id") % 50 != 7, F.col("job_id") % 50 + 1).otherwise(0).cast("double")
    return A.throughput_factor(j, ["owner"], ["created_h", "job_id"], wall, score).select("job_id", "factor")
