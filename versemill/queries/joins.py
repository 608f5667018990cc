"""Lookup, interval, as-of and merge joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from versemill import bindings as B
from versemill.functions import kana as K
from versemill.functions.text import letter_words
from versemill.operators import mapping as M
from versemill.operators import timejoin as TJ
from versemill.plans.ordered import by_width, materialize
from versemill.queries.registry import query

BY, ORDER = ["song_id"], ["start_ms", "note_id"]
N = B.with_(B.NOTES)


@query(
    "j1_word_row_lookup",
    B.with_(B.WORDS) + """, r AS (SELECT p_partkey % 500 AS id, p_name AS surface, p_partkey AS pos, p_brand AS brand, p_size AS size FROM part),
 w AS (SELECT line_id, pos AS wpos, cents, word_id % 500 AS id, CASE WHEN qty % 2 = 0 THEN 'red widget' ELSE 'x' END AS surface, flag = 'R' AS filler FROM words),
 e AS (SELECT id, surface, min(pos) AS pos FROM r GROUP BY 1, 2), f AS (SELECT id, min(pos) AS pos FROM r GROUP BY 1)
SELECT w.line_id, wpos, w.cents, CASE WHEN NOT filler THEN r.pos END AS pos, CASE WHEN NOT filler THEN r.brand END AS brand
FROM w LEFT JOIN e USING (id, surface) LEFT JOIN f USING (id) LEFT JOIN r ON r.pos = coalesce(e.pos, f.pos)""",
)
def j1(spark, d):
    rows = B.table(spark, d, "part").select(
        (F.col("p_partkey") % 500).alias("id"), F.col("p_name").alias("surface"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("brand")
    )
    words = B.words(spark, d).select(
        "line_id", F.col("pos").alias("wpos"), "cents", (F.col("word_id") % 500).alias("id"),
        F.when(F.col("qty") % 2 == 0, "red widget").otherwise("x").alias("surface"), (F.col("flag") == "R").alias("filler"),
    )
    out = M.lookup_rows(words, rows, "id", "surface", "pos", ["pos", "brand"], "filler")
    return out.select("line_id", "wpos", "cents", "pos", "brand")


_TEMPO = """tempo AS (SELECT owner AS song_id, created_h AS tick, max(300000 + cents % 500000) AS us FROM jobs WHERE status <> 'P' GROUP BY 1, 2
  UNION SELECT DISTINCT owner, 0, 500000 FROM jobs WHERE NOT (created_h = 0 AND status <> 'P')),
 tempo1 AS (SELECT song_id, tick, max(us) AS us FROM tempo GROUP BY 1, 2),
 seg AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY song_id ORDER BY tick), 0) AS base FROM (SELECT *, coalesce((tick - lag(tick) OVER x) * lag(us) OVER x, 0) AS step FROM tempo1 WINDOW x AS (PARTITION BY song_id ORDER BY tick)))"""


def _tempo(spark, d):
    j = B.jobs(spark, d)
    rows = j.where(F.col("status") != "P").select(
        F.col("owner").alias("song_id"), F.col("created_h").alias("tick"), (300_000 + F.col("cents") % 500_000).alias("us")
    )
    head = j.where(~((F.col("created_h") == 0) & (F.col("status") != "P"))).select(
        F.col("owner").alias("song_id"), F.lit(0).cast("bigint").alias("tick"), F.lit(500_000).cast("bigint").alias("us")
    ).distinct()
    return rows.unionByName(head).groupBy("song_id", "tick").agg(F.max("us").alias("us"))


@query(
    "j3_tempo_map_time",
    B.with_(B.JOBS, _TEMPO) + """, p AS (SELECT job_id, owner AS song_id, created_h * 13 % 2500 AS at FROM jobs),
 h AS (SELECT p.*, seg.base + (p.at - seg.tick) * seg.us AS scaled FROM p ASOF JOIN seg ON p.song_id = seg.song_id AND p.at >= seg.tick),
 b AS (SELECT h.job_id, h.scaled, seg.tick + (h.scaled + 123456 - seg.base) // seg.us AS back_tick FROM h ASOF JOIN seg ON h.song_id = seg.song_id AND h.scaled + 123456 >= seg.base)
SELECT job_id, CAST(scaled AS BIGINT) AS scaled, CAST(back_tick AS BIGINT) AS back_tick FROM b""",
)
def j3(spark, d):
    seg = TJ.tempo_segments(_tempo(spark, d), BY, "tick", "us", 256)
    p = B.jobs(spark, d).select("job_id", F.col("owner").alias("song_id"), (F.col("created_h") * 13 % 2500).alias("at"))
    timed = TJ.ticks_to_time(p, seg, BY, "at", "tick", "us", 256)
    back = TJ.time_to_ticks(timed.withColumn("later", F.col("scaled") + 123_456), seg, BY, "later", "tick", "us", 100_000_000, "back_tick")
    return back.select("job_id", "scaled", "back_tick")


_GRID = """sig0 AS (SELECT owner AS song_id, created_h AS tick, max(2 + cents % 5) AS num FROM jobs WHERE status = 'P' GROUP BY 1, 2),
 sig AS (SELECT * FROM sig0 UNION ALL SELECT song_id, 0, 4 FROM sig0 GROUP BY 1 HAVING min(tick) > 0),
 sx AS (SELECT *, lead(tick) OVER (PARTITION BY song_id ORDER BY tick) AS nx FROM sig),
 meas AS (SELECT song_id, m AS m_start, CASE WHEN nx IS NOT NULL THEN least(m + 96 * num // 4, nx) ELSE m + 96 * num // 4 END AS m_end, num FROM sx, unnest(range(tick, coalesce(nx, greatest(2500, tick + 1)), 96 * num // 4)) AS u(m))"""


def _measures(spark, d):
    j = B.jobs(spark, d).where(F.col("status") == "P")
    sig = j.groupBy(F.col("owner").alias("song_id"), F.col("created_h").alias("tick")).agg(F.max(2 + F.col("cents") % 5).alias("num"))
    from versemill.operators.projection import inject_default

    sig = inject_default(sig, sig, "song_id", "tick", {"num": F.lit(4).cast("bigint")}).withColumn("den", F.lit(4))
    ends = sig.select("song_id").distinct().withColumn("end_tick", F.lit(2500).cast("bigint"))
    return TJ.measure_grid(sig, ends, BY, "tick", "num", "den", 24, 256)


@query("j4_measure_grid", B.with_(B.JOBS, _GRID) + "SELECT song_id, m_start, m_end, num AS beats FROM meas")
def j4(spark, d):
    return _measures(spark, d).select("song_id", "m_start", "m_end", "beats")


@query(
    "j4_beats_per_song",
    B.with_(B.JOBS, _GRID) + "SELECT song_id, count(*) AS n_beats, CAST(sum(b) AS BIGINT) AS tick_sum FROM meas, unnest(range(m_start, m_end, 24)) AS u(b) GROUP BY 1",
)
def j4_beats(spark, d):
    beats = TJ.beats_in_measures(_measures(spark, d), BY, 24)
    return beats.groupBy("song_id").agg(F.count("*").alias("n_beats"), F.sum("beat_tick").alias("tick_sum"))


_UNITS = r"""units AS (SELECT song_id, line_id, i AS unit, ws[i] AS w, sum(length(ws[i])) OVER (PARTITION BY song_id, line_id ORDER BY i) AS c1
   FROM (SELECT song_id, line_id, regexp_extract_all(text, '[^\s]+') AS ws FROM turns), unnest(range(1, len(ws) + 1)) AS u(i)),
 chars AS (SELECT song_id, line_id, CAST(max(c1) AS BIGINT) AS n FROM units GROUP BY 1, 2),
 cn AS (SELECT song_id, line_id, k AS note_no, 5 * k AS n0, 5 * k + 4 AS n1, 100 + k * 37 % 50 AS ms FROM chars, unnest(range(0, (n + 9) // 10)) AS u(k))"""


def _units(spark, d):
    w = B.turns(spark, d).select("song_id", "line_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), 0)).alias("p", "w"))
    w = w.select("song_id", "line_id", (F.col("p") + 1).cast("bigint").alias("unit"), "w")
    return materialize(TJ.char_spans(w, ["song_id", "line_id"], ["unit"], by_width("unit", 4096), "w"))


def _char_notes(units):
    """Notes over the first half of a line's characters, each five apart and four long."""
    n = units.groupBy("song_id", "line_id").agg(F.max("c1").alias("n"))
    k = n.withColumn("note_no", F.explode(F.expr("sequence(0L, (n + 9) div 10 - 1)")))
    return k.select(
        "song_id", "line_id", "note_no", (5 * F.col("note_no")).alias("n0"), (5 * F.col("note_no") + 4).alias("n1"),
        (100 + F.col("note_no") * 37 % 50).alias("ms"),
    )


@query(
    "j5_unit_note_seconds",
    B.with_(B.TURNS, _UNITS) + """, h AS (SELECT u.song_id, u.line_id, unit, sum(ms) AS s FROM units u JOIN cn ON u.song_id = cn.song_id AND u.line_id = cn.line_id AND c1 - length(w) < n1 AND n0 < c1 GROUP BY 1, 2, 3),
 m AS (SELECT song_id, line_id, sum(s) / count(*) AS mean FROM h GROUP BY 1, 2),
 x AS (SELECT u.song_id, u.line_id, u.unit, coalesce(CAST(s AS DOUBLE), mean) AS duration FROM units u LEFT JOIN h USING (song_id, line_id, unit) LEFT JOIN m USING (song_id, line_id))
SELECT song_id, line_id, unit, round(duration, 6) AS duration, round(sqrt(duration) / avg(sqrt(duration)) OVER (PARTITION BY song_id, line_id), 6) AS weight FROM x""",
)
def j5(spark, d):
    line = ["song_id", "line_id"]
    u = _units(spark, d)
    out = TJ.unit_durations(u, _char_notes(u), line, "unit", "ms")
    out = TJ.length_weights(out, line, F.col("duration"), 0.5)
    return out.select(*line, "unit", F.round("duration", 6).alias("duration"), F.round("weight", 6).alias("weight"))


@query(
    "j6_word_note_sets",
    B.with_(B.TURNS, _UNITS) + """SELECT u.song_id, u.line_id, unit, string_agg(CAST(note_no AS VARCHAR), ',' ORDER BY note_no) AS notes
FROM units u JOIN cn ON u.song_id = cn.song_id AND u.line_id = cn.line_id AND c1 - length(w) < n1 AND n0 < c1 GROUP BY 1, 2, 3""",
)
def j6(spark, d):
    u = _units(spark, d)
    out = TJ.words_to_notes(u, _char_notes(u), ["song_id", "line_id"], "unit", "note_no")
    return out.select("song_id", "line_id", "unit", F.array_join(F.transform("note_ids", lambda x: x.cast("string")), ",").alias("notes"))


_SPANS = "spans AS (SELECT job_id, owner AS song_id, created_h * 10 AS s, created_h * 10 + 100 + job_id % 400 AS e FROM jobs WHERE owner IN (SELECT song_id FROM notes))"
_FRAMES = """first AS (SELECT j.job_id, n.pitch FROM spans j JOIN notes n ON j.song_id = n.song_id AND n.start_ms >= j.s AND n.start_ms < j.e),
 again AS (SELECT j.job_id, n.pitch FROM spans j JOIN notes n ON j.song_id = n.song_id AND n.start_ms >= j.s - 50 AND n.start_ms < j.e + 50 WHERE j.job_id NOT IN (SELECT job_id FROM first)),
 fr AS (SELECT *, false AS retried FROM first UNION ALL SELECT *, true FROM again)"""


def _frames(spark, d):
    spans = B.jobs(spark, d).select(
        "job_id", F.col("owner").alias("song_id"), (F.col("created_h") * 10).alias("s"), (F.col("created_h") * 10 + 100 + F.col("job_id") % 400).alias("e")
    )
    n = B.notes(spark, d).select("song_id", "start_ms", "pitch")
    return TJ.frames_per_span(n, spans, BY, ["job_id"], "start_ms", "s", "e", 50, 256)


@query(
    "j7_frames_in_spans",
    B.with_(B.NOTES, B.JOBS, _SPANS, _FRAMES) + "SELECT job_id, retried, count(*) AS n_frames, CAST(sum(pitch) AS BIGINT) AS pitch_sum FROM fr GROUP BY 1, 2",
)
def j7(spark, d):
    return _frames(spark, d).groupBy("job_id", "retried").agg(F.count("*").alias("n_frames"), F.sum("pitch").alias("pitch_sum"))


@query(
    "j8_split_at_measures",
    N + """, b AS (SELECT song_id, m * 70 AS m0, m * 70 + 70 AS m1 FROM (SELECT song_id, min(start_ms) // 70 AS a, max(end_ms) // 70 AS z FROM notes GROUP BY 1), unnest(range(a, z + 1)) AS u(m))
SELECT note_id, greatest(m0, start_ms) AS piece_start, least(m1, end_ms) AS piece_end, CASE WHEN m0 <= start_ms AND m1 >= end_ms THEN '' WHEN m0 <= start_ms THEN 'start'
  WHEN m1 >= end_ms THEN 'stop' ELSE 'continue' END AS tie, m0 <= start_ms AS has_lyric FROM notes n JOIN b ON n.song_id = b.song_id AND m0 < end_ms AND start_ms < m1""",
)
def j8(spark, d):
    n = B.notes(spark, d)
    m = (
        n.groupBy("song_id")
        .agg(F.expr("min(start_ms) div 70").alias("a"), F.expr("max(end_ms) div 70").alias("z"))
        .withColumn("m", F.explode(F.sequence("a", "z")))
        .select("song_id", (F.col("m") * 70).alias("m_start"), (F.col("m") * 70 + 70).alias("m_end"))
    )
    out = TJ.split_at_measures(n.select("song_id", "note_id", "start_ms", "end_ms"), m, BY, "note_id", "start_ms", "end_ms", 256)
    return out.drop("song_id")


@query(
    "j9_line_time_range",
    B.with_(B.NOTES, B.WORDS) + """, x AS (SELECT line_id, pos, cents, word_id, start_ms, end_ms, row_number() OVER (PARTITION BY line_id ORDER BY pos, word_id, cents) AS a, row_number() OVER (PARTITION BY line_id ORDER BY pos DESC, word_id DESC, cents DESC) AS z FROM words JOIN notes ON note_id = word_id)
SELECT line_id, max(CASE WHEN a = 1 THEN start_ms END) AS range_start, max(CASE WHEN z = 1 THEN end_ms END) AS range_end FROM x GROUP BY 1""",
)
def j9(spark, d):
    lines = B.words(spark, d).select("line_id", "pos", "cents", "word_id", F.col("word_id").alias("note_id"))
    return M.position_ranges(lines, B.notes(spark, d), ["line_id"], ["pos", "word_id", "cents"], "note_id", "start_ms", "end_ms")


@query(
    "j15_lyric_overlay",
    B.with_(B.WORDS) + """, base AS (SELECT DISTINCT line_id, k AS note FROM words, unnest(range(0, 50, 10)) AS u(k)),
 c AS (SELECT line_id, word_id % 50 AS note, max_by('w' || word_id, lpad(CAST(pos AS VARCHAR), 3, '0') || lpad(CAST(word_id AS VARCHAR), 12, '0')) AS k, count(*) > 1 AS many FROM words GROUP BY 1, 2)
SELECT line_id, note, coalesce(c.k, 'n' || note) AS kana, coalesce(many, false) AS double_claim FROM base LEFT JOIN c USING (line_id, note)""",
)
def j15(spark, d):
    w = B.words(spark, d)
    base = w.select("line_id").distinct().select("line_id", F.explode(F.expr("sequence(0L, 40L, 10L)")).alias("note"))
    base = base.withColumn("orig", F.concat(F.lit("n"), F.col("note").cast("string")))
    claims = w.select("line_id", (F.col("word_id") % 50).alias("note"), "pos", "word_id", F.concat(F.lit("w"), F.col("word_id").cast("string")).alias("k"))
    return M.overlay_last(base, claims, ["line_id", "note"], "orig", "k", ["pos", "word_id"], "word_id")


@query(
    "j17_alias_resolution",
    r"""WITH k AS (SELECT page_id, lower(replace(regexp_extract(url, '([a-z]{2}/[0-9]*)', 1), '_', ' ')) AS t FROM pages WHERE true),
 al AS (SELECT 'fr/' || page_id AS f, 'en/' || (page_id + 1) AS t FROM pages UNION ALL SELECT 'en/' || page_id, 'File ' || page_id FROM pages WHERE page_id % 2 = 0),
 a AS (SELECT lower(f) AS f, max(lower(t)) AS t FROM al GROUP BY 1)
SELECT page_id, coalesce(a2.t, a1.t, k.t) AS resolved FROM k LEFT JOIN a a1 ON a1.f = k.t LEFT JOIN a a2 ON a2.f = coalesce(a1.t, k.t)""",
)
def j17(spark, d):
    pages = B.table(spark, d, "pages")
    i = F.col("page_id").cast("string")
    aliases = pages.select(F.concat(F.lit("fr/"), i).alias("from_key"), F.concat(F.lit("en/"), (F.col("page_id") + 1).cast("string")).alias("to_key")).unionByName(
        pages.where(F.col("page_id") % 2 == 0).select(F.concat(F.lit("EN/"), i).alias("from_key"), F.concat(F.lit("File_"), i).alias("to_key"))
    )
    keys = pages.select("page_id", F.regexp_extract("url", "([a-z]{2}/[0-9]*)", 1).alias("title"))
    return M.resolve_alias(keys, aliases, "title").select("page_id", "resolved")


@query(
    "j18_beat_snap",
    N + """, t AS (SELECT song_id, note_id, start_ms AS tt FROM notes WHERE channel = 'error'), b AS (SELECT DISTINCT song_id, start_ms AS beat FROM notes WHERE channel = 'view'),
 c AS (SELECT note_id, beat, row_number() OVER (PARTITION BY note_id ORDER BY abs(beat - tt), beat) AS r FROM t JOIN b ON t.song_id = b.song_id AND beat > tt - 400 AND beat < tt + 300)
SELECT t.note_id, coalesce(c.beat, t.tt) AS snapped FROM t LEFT JOIN c ON c.note_id = t.note_id AND r = 1""",
)
def j18(spark, d):
    n = B.notes(spark, d)
    t = n.where(F.col("channel") == "error").select("song_id", "note_id", F.col("start_ms").alias("at"))
    b = n.where(F.col("channel") == "view").select("song_id", F.col("start_ms").alias("beat"))
    return TJ.snap_to_nearest(t, b, BY, "at", "beat", F.col("at") - 400, F.col("at") + 300, 1000).select("note_id", "snapped")


@query(
    "j19_sung_gap",
    N + """, s AS (SELECT song_id, note_id, end_ms AS a, end_ms + 40 + note_id % 100 AS b FROM notes WHERE channel = 'click'),
 p AS (SELECT s.note_id, max(n.end_ms) AS pe FROM s JOIN notes n ON n.song_id = s.song_id AND n.end_ms <= s.a GROUP BY 1),
 q AS (SELECT s.note_id, min(n.start_ms) AS ns FROM s JOIN notes n ON n.song_id = s.song_id AND n.start_ms >= s.b GROUP BY 1)
SELECT s.note_id, CASE WHEN pe IS NOT NULL AND ns IS NOT NULL THEN greatest(b - a, ns - pe) ELSE b - a END AS sung_gap FROM s LEFT JOIN p USING (note_id) LEFT JOIN q USING (note_id)""",
)
def j19(spark, d):
    n = B.notes(spark, d)
    s = n.where(F.col("channel") == "click").select("song_id", "note_id", F.col("end_ms").alias("a"), (F.col("end_ms") + 40 + F.col("note_id") % 100).alias("b"))
    return TJ.sung_gaps(s, n, BY, "a", "b", "start_ms", "end_ms", 1000).select("note_id", "sung_gap")


_MANAGED = "CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'f' || page_id END AS local_path, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'c' END AS credit"


@query(
    "j20_asset_state",
    f"""WITH m AS (SELECT url, {_MANAGED} FROM pages WHERE page_id % 5 <> 0)
SELECT p.page_id, CASE WHEN m.url IS NULL THEN 'unmanaged' WHEN local_path IS NULL THEN 'missing' ELSE 'available' END AS state,
  CASE WHEN m.url IS NULL THEN 'not applicable' WHEN credit IS NULL THEN 'unknown' ELSE 'known' END AS credit_state FROM pages p LEFT JOIN m USING (url)""",
)
def j20(spark, d):
    pages = B.table(spark, d, "pages").select("page_id", "url")
    i = F.col("page_id")
    managed = pages.where(i % 5 != 0).select("url", F.when(i % 3 != 0, F.concat(F.lit("f"), i.cast("string"))).alias("local_path"), F.when(i % 4 != 0, "c").alias("credit"))
    return M.asset_state(pages, managed).select("page_id", "state", "credit_state")


@query(
    "j21_membership",
    """SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))""",
)
def j21(spark, d):
    allowed = B.table(spark, d, "nation").where(F.col("n_regionkey").isin(1, 3)).select(F.col("n_nationkey").alias("c_nationkey"))
    return B.table(spark, d, "customer").join(allowed, "c_nationkey", "left_semi").select("c_custkey")


@query(
    "j22_reading_dictionary",
    f"""WITH t AS (SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, {B.words_sql("text")} AS ws FROM documents), unnest(range(1, len(ws) + 1)) AS u(i)),
 dict AS (SELECT DISTINCT w, translate(w, '{B.LATIN}', '{B.LATIN_KANA}') AS r FROM (SELECT unnest({B.words_sql("text")}) AS w FROM benchmark))
SELECT doc_id, md5(string_agg(CASE WHEN length(t.w) >= 12 THEN upper(t.w) ELSE coalesce(r, t.w) END, '' ORDER BY i)) AS reading, count(r) AS n_known FROM t LEFT JOIN dict USING (w) GROUP BY 1""",
)
def j22(spark, d):
    from versemill.operators.soundalike import text_words

    words = text_words(B.table(spark, d, "benchmark").select("text"), "text").distinct()
    readings = words.select(F.col("word").alias("w"), F.translate("word", B.LATIN, B.LATIN_KANA).alias("reading"))
    forced = lambda w: F.when(F.length(w) >= 12, F.upper(w))
    out = M.read_tokens(B.documents(spark, d).select("doc_id", "text"), readings, ["doc_id"], "text", letter_words, "w", forced)
    return out.select("doc_id", F.md5("reading").alias("reading"), "n_known")


@query(
    "j23_particle_override",
    B.with_(B.TURNS, _UNITS) + """, p AS (SELECT song_id, line_id, c1 - length(w) AS c0, c1, w FROM units WHERE lower(w) IN ('de', 'la', 'le', 'in', 'of', 'to', 'the'))
SELECT cn.song_id, cn.line_id, note_no, coalesce(upper(p.w), 'n') AS reading FROM cn LEFT JOIN p ON p.song_id = cn.song_id AND p.line_id = cn.line_id AND n0 >= c0 AND n0 < c1""",
)
def j23(spark, d):
    from versemill.plans.intervals import points_in_spans

    u = _units(spark, d)
    notes = _char_notes(u).select("song_id", "line_id", "note_no", "n0")
    tagged = u.where(F.lower("w").isin("de", "la", "le", "in", "of", "to", "the")).select("song_id", "line_id", "c0", "c1", "w")
    out = points_in_spans(notes, tagged, ["song_id", "line_id"], "n0", "c0", "c1", 64, how="left")
    return out.select("song_id", "line_id", "note_no", F.coalesce(F.upper("w"), F.lit("n")).alias("reading"))


@query(
    "j24_reading_candidates",
    B.with_(B.WORDLIST) + """, r AS (SELECT list, replace(surface, 'e', '') AS reading, min(id) AS first_at FROM wordlist GROUP BY 1, 2)
SELECT list, reading, first_at, row_number() OVER (PARTITION BY list ORDER BY first_at, reading) AS number FROM r""",
)
def j24(spark, d):
    return M.reading_candidates(B.wordlist(spark, d), ["list"], F.replace("surface", F.lit("e"), F.lit("")), "id")


@query(
    "j25_margin_choice",
    """WITH s AS (SELECT vec_id, i - 1 AS variant, CAST(embedding[i] AS DOUBLE) * 10 AS score FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)),
 b AS (SELECT vec_id, variant, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, variant) AS r FROM s), f AS (SELECT vec_id, score AS ds FROM s WHERE variant = 0)
SELECT vec_id, ds AS default_score, score AS best_score, CAST(CASE WHEN score - ds >= 2.0 THEN variant ELSE 0 END AS BIGINT) AS chosen FROM b JOIN f USING (vec_id) WHERE r = 1""",
)
def j25(spark, d):
    s = B.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("variant", "e"))
    s = s.withColumn("score", F.col("e").cast("double") * 10)
    return M.choose_with_margin(s, ["vec_id"], "variant", "score", 2.0).withColumn("chosen", F.col("chosen").cast("bigint"))


@query(
    "j26_truth_accuracy",
    """WITH x AS (SELECT d.source, d.lang, l.doc_id, l.quality AS truth, CAST(d.n_chars % 2 AS INT) AS got FROM labels l LEFT JOIN documents d USING (doc_id)),
 w AS (SELECT source, lang, bool_and(got = truth) AS word_ok, count(*) AS n, count(*) FILTER (got = truth) AS n_ok FROM x GROUP BY 1, 2)
SELECT source, count(*) AS n_words, count(*) FILTER (word_ok) AS n_words_ok, CAST(sum(n) AS BIGINT) AS n_notes, CAST(sum(n_ok) AS BIGINT) AS n_notes_ok FROM w GROUP BY ROLLUP (source)""",
)
def j26(spark, d):
    from versemill.operators.metrics import accuracy_report

    docs = B.documents(spark, d).select("doc_id", "source", "lang", (F.col("n_chars") % 2).cast("int").alias("got"))
    x = B.table(spark, d, "labels").join(docs, "doc_id", "left")
    return accuracy_report(x, "source", ["source", "lang"], F.col("got") == F.col("quality"))


@query(
    "j27_offset_map",
    B.with_(B.TURNS, _UNITS) + """, m AS (SELECT song_id, line_id, unit, count(*) OVER (PARTITION BY song_id, line_id) AS n, CASE WHEN length(w) % 4 > 0 THEN unit + length(w) % 3 END AS dst FROM units)
SELECT song_id, line_id, unit, CAST(least(coalesce(max(dst) OVER (PARTITION BY song_id, line_id ORDER BY unit), 0), n) AS BIGINT) AS target FROM m""",
)
def j27(spark, d):
    u = _units(spark, d)
    n = u.groupBy("song_id", "line_id").agg(F.count("*").alias("n"))
    m = u.withColumn("dst", F.when(F.length("w") % 4 > 0, F.col("unit") + F.length("w") % 3)).join(n, ["song_id", "line_id"])
    out = M.fill_offset_map(m, ["song_id", "line_id"], "unit", "dst", "n", by_width("unit", 4096))
    return out.select("song_id", "line_id", "unit", "target")


@query(
    "j28_edit_merge",
    N + """, e AS (SELECT song_id, note_id, note_id - note_id % 3 AS old_id, start_ms + 5 AS s, greatest(end_ms - 20, start_ms + 15) AS e FROM notes),
 r AS (SELECT *, row_number() OVER (PARTITION BY song_id, old_id ORDER BY s, note_id) AS rn FROM e)
SELECT r.note_id, rn = 1 AS first_claim, e AS end_ms, CASE WHEN rn = 1 THEN o.pitch END AS pitch, CASE WHEN rn = 1 THEN o.channel END AS channel FROM r LEFT JOIN notes o ON o.song_id = r.song_id AND o.note_id = r.old_id""",
)
def j28(spark, d):
    n = B.notes(spark, d)
    e = n.select("song_id", "note_id", (F.col("note_id") - F.col("note_id") % 3).alias("old_id"), (F.col("start_ms") + 5).alias("s"), F.greatest(F.col("end_ms") - 20, F.col("start_ms") + 15).alias("end_ms"))
    old = n.select("song_id", F.col("note_id").alias("old_id"), "pitch", "channel")
    out = M.first_claims(e, BY, ["s", "note_id"], old, "old_id", ["pitch", "channel"])
    return out.select("note_id", "first_claim", "end_ms", "pitch", "channel")


@query(
    "j29_catalogue_overlay",
    """WITH b AS (SELECT c_custkey AS id, c_custkey AS pos, c_name AS title, c_mktsegment AS kind FROM customer WHERE c_custkey % 7 <> 0),
 l AS (SELECT c_custkey AS id, c_custkey * 2 AS pos, CASE WHEN c_custkey % 2 = 0 THEN 'local ' || c_custkey END AS title, 'mine' AS kind FROM customer WHERE c_custkey % 7 < 3)
SELECT id, CASE WHEN b.pos IS NULL THEN 1 ELSE 0 END AS appended, coalesce(b.pos, l.pos) AS pos, coalesce(l.title, b.title) AS title, coalesce(l.kind, b.kind) AS kind FROM b FULL JOIN l USING (id)""",
)
def j29(spark, d):
    c = B.table(spark, d, "customer")
    k = F.col("c_custkey")
    base = c.where(k % 7 != 0).select(k.alias("id"), k.alias("pos"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("kind"))
    local = c.where(k % 7 < 3).select(
        k.alias("id"), (k * 2).alias("pos"), F.when(k % 2 == 0, F.concat(F.lit("local "), k.cast("string"))).alias("title"), F.lit("mine").alias("kind")
    )
    return M.overlay_catalogue(base, local, "id", "pos", ["title", "kind"])


@query(
    "j30_label_resolution",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'saved ' || o_orderkey END, CASE WHEN c_custkey % 3 > 0 THEN nullif(trim(c_name), '') END, 'song') AS label
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def j30(spark, d):
    o = B.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = B.table(spark, d, "customer").where(F.col("c_custkey") % 3 > 0).select("c_custkey", "c_name")
    saved = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("saved "), F.col("o_orderkey").cast("string"))).otherwise(" ")
    blank = lambda x: F.when(F.trim(x) != "", x)
    return o.join(c, "c_custkey", "left").select("o_orderkey", F.coalesce(blank(saved), blank(F.col("c_name")), F.lit("song")).alias("label"))


@query(
    "j31_tempo_at_measure_start",
    B.with_(B.JOBS, _GRID) + """SELECT j.job_id, (SELECT max(m_start) FROM meas WHERE meas.song_id = j.owner AND m_start <= j.created_h) AS m_start FROM jobs j""",
)
def j31(spark, d):
    e = B.jobs(spark, d).select("job_id", F.col("owner").alias("song_id"), "created_h")
    return TJ.snap_to_measure_start(e, _measures(spark, d), BY, "created_h", 256).select("job_id", "m_start")


@query(
    "j32_vocabulary_tokens",
    """WITH v AS (SELECT tok, min(id) AS id FROM (SELECT substr(p_type, 1, 1) AS tok, p_size AS id FROM part UNION ALL SELECT lower(substr(p_type, 2, 1)), p_size + 100 FROM part) GROUP BY 1),
 c AS (SELECT p_partkey, i - 1 AS char_no, p_name[i] AS ch FROM part, unnest(range(1, length(p_name) + 1)) AS u(i))
SELECT p_partkey, char_no, ch AS char, CAST(coalesce(a.id, b.id) AS BIGINT) AS token_id FROM c LEFT JOIN v a ON a.tok = ch LEFT JOIN v b ON b.tok = upper(ch) WHERE coalesce(a.id, b.id) IS NOT NULL""",
)
def j32(spark, d):
    p = B.table(spark, d, "part")
    v = p.select(F.substring("p_type", 1, 1).alias("tok"), F.col("p_size").cast("bigint").alias("token_id")).unionByName(
        p.select(F.lower(F.substring("p_type", 2, 1)).alias("tok"), (F.col("p_size") + 100).cast("bigint").alias("token_id"))
    )
    out = M.vocabulary_tokens(p.select("p_partkey", "p_name"), v, "p_name", "tok", F.upper)
    return out.select("p_partkey", F.col("char_no").cast("bigint").alias("char_no"), "char", "token_id")
