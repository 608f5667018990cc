"""Pairing, similarity, placement and map-fit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from versemill import bindings as B
from versemill.functions import kana as K
from versemill.operators import matching as M
from versemill.operators import placement as PL
from versemill.operators import timeline as TL
from versemill.plans.ordered import by_width
from versemill.queries.joins import _UNITS, _units
from versemill.queries.registry import query

BY = ["song_id"]
N = B.with_(B.NOTES)
_REC = lambda *ctes: B.with_(*ctes).replace("WITH", "WITH RECURSIVE", 1)


@query(
    "j2_nearest_pairing",
    _REC(B.NOTES) + """, ev AS (SELECT song_id, note_id AS event_id, start_ms AS tt, row_number() OVER (PARTITION BY song_id ORDER BY start_ms, note_id) AS rn FROM notes WHERE channel = 'error'),
 cd AS (SELECT ev.song_id, ev.event_id, ev.rn, list(n.note_id ORDER BY abs(n.start_ms - tt), -n.pitch, n.note_id) FILTER (n.note_id IS NOT NULL) AS c FROM ev LEFT JOIN notes n ON n.song_id = ev.song_id AND n.channel = 'view' AND abs(n.start_ms - tt) <= 600 GROUP BY 1, 2, 3),
 g AS (SELECT song_id, rn, event_id, c[1] AS note_id, CASE WHEN c[1] IS NULL THEN []::BIGINT[] ELSE [c[1]] END AS used FROM cd WHERE rn = 1 UNION ALL
  SELECT cd.song_id, cd.rn, cd.event_id, list_filter(cd.c, lambda x: NOT list_contains(g.used, x))[1],
   CASE WHEN list_filter(cd.c, lambda x: NOT list_contains(g.used, x))[1] IS NULL THEN g.used ELSE list_append(g.used, list_filter(cd.c, lambda x: NOT list_contains(g.used, x))[1]) END
  FROM g JOIN cd ON cd.song_id = g.song_id AND cd.rn = g.rn + 1)
SELECT event_id, note_id FROM g WHERE note_id IS NOT NULL""",
)
def j2(spark, d):
    n = B.notes(spark, d)
    e = n.where(F.col("channel") == "error").select("song_id", F.col("note_id").alias("event_id"), F.col("start_ms").alias("at"))
    v = n.where(F.col("channel") == "view")
    out = M.pair_events(e, v, BY, "event_id", "at", "note_id", "start_ms", "pitch", 600, 1024)
    return out.select("event_id", "note_id")


@query(
    "j11_line_similarity",
    """WITH a AS (SELECT DISTINCT item_id, substr(text, i, 8) AS g FROM benchmark, unnest(range(1, length(text) - 6)) AS u(i)), z AS (SELECT item_id, count(*) AS n_grams FROM a GROUP BY 1),
 b AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, length(text) - 6), lambda i: substr(text, i, 8))) AS g FROM documents) SEMI JOIN a USING (g)),
 h AS (SELECT item_id, doc_id, count(*) AS n_common FROM a JOIN b USING (g) GROUP BY 1, 2)
SELECT item_id, doc_id, n_common, n_grams FROM h JOIN z USING (item_id) WHERE n_common >= 0.35 * n_grams""",
)
def j11(spark, d):
    lines = B.table(spark, d, "benchmark").select("item_id", "text")
    return M.line_similarity(lines, B.documents(spark, d).select("doc_id", "text"), [], "item_id", "doc_id", "text", 8, 0.35)


def _lyrics(spark, d):
    """Lyric sheet of a song: its lines from the second on, upper-cased every third line."""
    t = B.turns(spark, d)
    shown = F.when(F.col("line_id") % 3 == 2, F.upper("text")).otherwise(F.col("text"))
    return t, t.where(F.col("line_id") > 0).select("song_id", (F.col("line_id") - 1).alias("lyric_no"), shown.alias("text"))


@query("j11_line_alignment")
def j11_align(spark, d):
    lines, lyrics = _lyrics(spark, d)
    similar = M.line_similarity(lines, lyrics, BY, "line_id", "lyric_no", "text", 5, 0.35)
    return M.align_lines(lines, similar, "song_id", "line_id", "lyric_no", F.col("n_common") / F.col("n_grams"), 0.05)


_CH = """tc AS (SELECT song_id, line_id, c0 + j AS pos, w[j + 1] AS ch FROM (SELECT song_id, line_id, w, CAST(sum(length(w)) OVER (PARTITION BY song_id ORDER BY line_id) AS BIGINT) - length(w) AS c0 FROM (SELECT song_id, line_id, text AS w FROM turns)), unnest(range(0, length(w))) AS u(j)),
 ec AS (SELECT song_id, line_id, c0 + j AS pos, w[j + 1] AS ch FROM (SELECT song_id, line_id, w, CAST(sum(length(w)) OVER (PARTITION BY song_id ORDER BY line_id) AS BIGINT) - length(w) AS c0 FROM (SELECT song_id, line_id, replace(text, 'ou', 'o') AS w FROM turns)), unnest(range(0, length(w))) AS u(j)),
 tg AS (SELECT *, ch || coalesce(lead(ch) OVER w, chr(3)) || coalesce(lead(ch, 2) OVER w, chr(3)) || coalesce(lead(ch, 3) OVER w, chr(3)) AS gram FROM tc WINDOW w AS (PARTITION BY song_id ORDER BY pos)),
 eg AS (SELECT *, ch || coalesce(lead(ch) OVER w, chr(3)) || coalesce(lead(ch, 2) OVER w, chr(3)) || coalesce(lead(ch, 3) OVER w, chr(3)) AS gram FROM ec WINDOW w AS (PARTITION BY song_id ORDER BY pos)),
 mb AS (SELECT t.*, e.pos AS before FROM tg t ASOF LEFT JOIN eg e ON t.song_id = e.song_id AND t.gram = e.gram AND t.pos >= e.pos),
 ma AS (SELECT t.*, e.pos AS after FROM mb t ASOF LEFT JOIN eg e ON t.song_id = e.song_id AND t.gram = e.gram AND t.pos <= e.pos),
 mm AS (SELECT song_id, line_id, pos, CASE WHEN after IS NULL OR (before IS NOT NULL AND pos - before <= after - pos) THEN before ELSE after END AS matched FROM ma WHERE before IS NOT NULL OR after IS NOT NULL)"""


def _matched(spark, d):
    t = B.turns(spark, d)
    sl = by_width("line_id", 1024)
    truth = M.stream_chars(t, BY, ["line_id"], sl, "text", "line_id")
    est = M.stream_chars(t.withColumn("text", F.replace("text", F.lit("ou"), F.lit("o"))), BY, ["line_id"], sl, "text", "line_id")
    return M.match_characters(truth, est, BY, 4), est


@query(
    "j12_character_match",
    B.with_(B.TURNS, _CH) + "SELECT song_id, line_id, count(*) AS n_matched, CAST(sum(abs(matched - pos)) AS BIGINT) AS drift FROM mm GROUP BY 1, 2",
)
def j12(spark, d):
    m, _ = _matched(spark, d)
    return m.groupBy("song_id", "line_id").agg(F.count("*").alias("n_matched"), F.sum(F.abs(F.col("matched") - F.col("pos"))).alias("drift"))


@query(
    "j12_owner_match",
    B.with_(B.TURNS, _CH) + """SELECT song_id, line_id, est_line FROM (SELECT mm.song_id, mm.line_id, e.line_id AS est_line, row_number() OVER (PARTITION BY mm.song_id, mm.line_id ORDER BY mm.pos) AS k
  FROM mm JOIN ec e ON e.song_id = mm.song_id AND e.pos = mm.matched) WHERE k = 1""",
)
def j12_owner(spark, d):
    m, est = _matched(spark, d)
    return M.match_owners(m, est, BY, "line_id", "est_line")


@query("j14_mora_placement")
def j14(spark, d):
    """The first word of a name on the notes of all others, or the other way round if it is longer."""
    names = F.split(F.translate("p_name", B.LATIN, B.LATIN_KANA), " ")
    a = K.split_moras(F.element_at(names, 1))
    b = F.flatten(F.transform(F.slice(names, F.lit(2), F.size(names)), K.split_moras))
    swap = F.size(a) > F.size(b)
    p = B.table(spark, d, "part").select("p_partkey", F.when(swap, b).otherwise(a).alias("moras"), F.when(swap, a).otherwise(b).alias("notes"))
    out = PL.place_moras(p, "moras", "notes")
    return out.select("p_partkey", "score", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query(
    "w5_skyline",
    _REC(B.NOTES) + """, o AS (SELECT *, end_ms + 200 AS e, row_number() OVER (PARTITION BY song_id ORDER BY start_ms, -pitch, note_id) AS rn FROM notes),
 f AS (SELECT song_id, note_id, rn, start_ms AS s, e AS ce, pitch AS cp, true AS kept FROM o WHERE rn = 1 UNION ALL
  SELECT o.song_id, o.note_id, o.rn, o.start_ms, CASE WHEN o.start_ms < f.ce AND o.pitch <= f.cp THEN f.ce ELSE o.e END, CASE WHEN o.start_ms < f.ce AND o.pitch <= f.cp THEN f.cp ELSE o.pitch END,
   NOT (o.start_ms < f.ce AND o.pitch <= f.cp) FROM f JOIN o ON o.song_id = f.song_id AND o.rn = f.rn + 1),
 k AS (SELECT note_id, s, least(ce, coalesce(lead(s) OVER (PARTITION BY song_id ORDER BY rn), ce)) AS e FROM f WHERE kept)
SELECT note_id, s AS start_ms, e AS end_ms FROM k WHERE e > s""",
)
def w5(spark, d):
    n = B.notes(spark, d).select("song_id", "note_id", "start_ms", (F.col("end_ms") + 200).alias("end_ms"), "pitch", (-F.col("pitch")).alias("low"))
    out = M.skyline(n, BY, ["start_ms", "low", "note_id"], B.song_slice(), "start_ms", "end_ms", "pitch")
    return out.select("note_id", "start_ms", "end_ms")


@query("w24_chunk_cuts")
def w24(spark, d):
    tiles = TL.fill_rests(B.notes(spark, d), BY, ["start_ms", "note_id"], B.song_slice(), "start_ms", "end_ms", 60)
    segments = tiles.where(F.col("end") > F.col("start")).select("song_id", "start", "end", (F.col("kind") == "rest").alias("is_rest"))
    return M.chunk_cuts(segments, BY, "start", "end", "is_rest", 4000, 200, 28)


@query(
    "w28_anchored_fill",
    N + """, s AS (SELECT song_id, note_id, row_number() OVER (PARTITION BY song_id ORDER BY start_ms, note_id) AS rn, channel IN ('error', 'view') AS miss FROM notes),
 t AS (SELECT song_id, CAST(count(*) * 2 + 3 AS BIGINT) AS n_full FROM s GROUP BY 1),
 a AS (SELECT *, sum(CASE WHEN miss THEN 0 ELSE 1 END) OVER w AS run, last_value(CASE WHEN NOT miss THEN rn * 2 + 1 END IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo,
   first_value(CASE WHEN NOT miss THEN rn * 2 END IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM s WINDOW w AS (PARTITION BY song_id ORDER BY rn)),
 g AS (SELECT a.*, n_full, row_number() OVER (PARTITION BY song_id, run ORDER BY rn) AS i, count(*) OVER (PARTITION BY song_id, run) AS m FROM a JOIN t USING (song_id) WHERE miss),
 h AS (SELECT *, coalesce(lo, 0) AS l, coalesce(hi, n_full) - coalesce(lo, 0) AS n FROM g)
SELECT note_id, CASE WHEN n >= m THEN l + n // m * (i - 1) + least(i - 1, n % m) END AS from_mora, CASE WHEN n >= m THEN l + n // m * i + least(i, n % m) END AS to_mora FROM h""",
)
def w28(spark, d):
    from versemill.plans.ordered import row_number, scan

    order, sl = ["start_ms", "note_id"], B.song_slice()
    n = scan(B.notes(spark, d).select("song_id", "start_ms", "note_id", "channel"), BY, order, sl, rn=row_number())
    n = n.withColumns({"miss": F.col("channel").isin("error", "view"), "at": F.col("rn") * 2, "len": F.lit(1).cast("bigint")})
    totals = n.groupBy("song_id").agg((F.count("*") * 2 + 3).alias("n_full"))
    out = M.fill_missing_readings(n, totals, BY, order, sl, "miss", "at", "len")
    return out.select("note_id", "from_mora", "to_mora")


@query(
    "w31_reading_cut_snap",
    B.with_(B.TURNS, _UNITS) + """, t AS (SELECT *, c1 - length(w) AS c0, CAST(sum(length(w) * 2 + unit % 3) OVER x AS BIGINT) AS r1, CAST(sum(length(w) * 2 + unit % 3) OVER x AS BIGINT) - length(w) * 2 - unit % 3 AS r0 FROM units WINDOW x AS (PARTITION BY song_id, line_id ORDER BY unit)),
 c AS (SELECT song_id, line_id, k * 37 AS cut FROM (SELECT song_id, line_id, max(r1) AS r FROM t GROUP BY 1, 2), unnest(range(1, r // 37 + 1)) AS u(k))
SELECT c.song_id, c.line_id, c.cut, CAST(CASE WHEN cut = r0 THEN c0 WHEN cut - r0 >= r1 - cut THEN c1 ELSE c0 END AS BIGINT) AS surface_cut FROM c JOIN t ON t.song_id = c.song_id AND t.line_id = c.line_id AND cut >= r0 AND cut < r1""",
)
def w31(spark, d):
    from versemill.plans.ordered import running_sum, scan

    line = ["song_id", "line_id"]
    size = F.length("w") * 2 + F.col("unit") % 3
    t = scan(_units(spark, d), line, ["unit"], by_width("unit", 4096), r1=running_sum(size)).withColumn("r0", F.col("r1") - size)
    ends = t.groupBy(*line).agg(F.max("r1").alias("r")).where(F.col("r") >= 37)
    cuts = ends.withColumn("k", F.explode(F.expr("sequence(1L, r div 37)"))).select(*line, (F.col("k") * 37).alias("cut"))
    return M.snap_reading_cuts(cuts, t, line, "cut")


@query("a5_global_map_fit")
def a5(spark, d):
    """Moras: the song's notes stretched by 3 % and moved; the fit must find that map."""
    n = B.notes(spark, d)
    moras = n.where(F.col("channel") != "error").select("song_id", F.round(F.col("start_ms") * 1.03 + 700).cast("bigint").alias("onset"))
    out = M.fit_global_map(moras, n, "song_id", "onset", "start_ms")
    return out.select("song_id", "scale", F.round("offset", 3).alias("offset"), F.round("cost", 3).alias("cost"))


def _voices(spark, d):
    """Moras: the song's notes but every ninth, moved a little; notes: those not of one channel."""
    from versemill.plans.ordered import row_number, scan

    n = B.notes(spark, d).select("song_id", "start_ms", "end_ms", "note_id", "pitch", "channel")
    order, sl = ["start_ms", "note_id"], B.song_slice()
    m = n.where(F.col("note_id") % 9 != 0).withColumns(
        {"onset": F.col("start_ms") + F.col("note_id") % 80 - 40, "mora_pitch": F.col("pitch") + F.col("note_id") % 3}
    )
    m = scan(m, BY, order, sl, rn=row_number()).withColumn("mora_no", F.col("rn") - 1)
    v = scan(n.where(F.col("channel") != "error"), BY, order, sl, rn=row_number()).withColumn("note_no", F.col("rn") - 1)
    return m.select("song_id", "mora_no", "onset", "mora_pitch"), v.select("song_id", "note_no", "start_ms", "end_ms", "pitch")


@query("j10_cost_matching")
def j10(spark, d):
    moras, notes = _voices(spark, d)
    out = M.match_moras(moras, notes, "song_id", "mora_no", "onset", "mora_pitch", "note_no", "start_ms", "end_ms", "pitch")
    return out.select("song_id", "mora_no", "note_no")


@query(
    "x2_token_reader",
    B.with_(B.TURNS, _UNITS) + """, t AS (SELECT *, c1 - length(w) AS c0, CAST(sum(length(w) * 2 + unit % 3) OVER x AS BIGINT) AS r1, CAST(sum(length(w) * 2 + unit % 3) OVER x AS BIGINT) - length(w) * 2 - unit % 3 AS r0 FROM units WINDOW x AS (PARTITION BY song_id, line_id ORDER BY unit)),
 p AS (SELECT song_id, line_id, k AS part, k * 37 AS reading_end, 1 + k % 5 AS w, L, n FROM (SELECT song_id, line_id, max(r1) AS r, max(c1) AS L, max(r1) // 37 + 1 AS n FROM t GROUP BY 1, 2), unnest(range(1, r // 37 + 2)) AS u(k)),
 tok AS (SELECT t.* FROM t SEMI JOIN (SELECT * FROM turns WHERE role = 'user') u USING (song_id, line_id)),
 rd AS (SELECT song_id, line_id, max(r1) AS reading FROM tok GROUP BY 1, 2),
 a AS (SELECT p.*, reading, CASE WHEN reading_end = r0 THEN c0 WHEN reading_end - r0 >= r1 - reading_end THEN c1 ELSE c0 END AS snapped,
  sum(p.w) OVER (PARTITION BY p.song_id, p.line_id ORDER BY part) AS up, sum(p.w) OVER (PARTITION BY p.song_id, p.line_id) AS tot
  FROM p LEFT JOIN rd USING (song_id, line_id) LEFT JOIN tok ON tok.song_id = p.song_id AND tok.line_id = p.line_id AND reading_end >= r0 AND reading_end < r1),
 b AS (SELECT *, CASE WHEN reading IS NULL THEN CAST(round_even(L * up / tot, 0) AS BIGINT) WHEN reading_end >= reading THEN L ELSE coalesce(snapped, 0) END AS target FROM a),
 c AS (SELECT *, max(greatest(0, least(target, L - (n - part)) - part)) OVER (PARTITION BY song_id, line_id ORDER BY part) AS top FROM b),
 e AS (SELECT *, CASE WHEN part = n THEN L ELSE top + part END AS ce FROM c)
SELECT song_id, line_id, CAST(part AS BIGINT) AS part, reading IS NOT NULL AS by_reading,
  CAST(coalesce(lag(ce) OVER (PARTITION BY song_id, line_id ORDER BY part), 0) AS BIGINT) AS cut_start, CAST(ce AS BIGINT) AS cut_end FROM e""",
)
def x2(spark, d):
    """Lines cut by the tokens of a reader that knows only the user's turns; the others are shared out."""
    from versemill.plans.ordered import materialize, running_sum, scan

    line = ["song_id", "line_id"]
    size = F.length("w") * 2 + F.col("unit") % 3
    t = scan(_units(spark, d), line, ["unit"], by_width("unit", 4096), r1=running_sum(size)).withColumn("r0", F.col("r1") - size)
    # Parts, readings and cuts all come from it.
    t = materialize(t.select(*line, "r0", "r1", "c0", "c1"))
    ends = t.groupBy(*line).agg(F.max("r1").alias("r"), F.max("c1").cast("bigint").alias("chars"))
    parts = ends.withColumn("part", F.explode(F.expr("sequence(1L, r div 37 + 1)"))).withColumn("reading_end", F.col("part") * 37)
    tokens = t.join(B.turns(spark, d).where("role = 'user'").select(*line), line, "left_semi")
    out = M.split_by_tokens(parts, tokens, line, ["part"], by_width("part", 1024), "reading_end", 1 + F.col("part") % 5, "chars")
    return out.select(*line, "part", "by_reading", F.col("cut_start").cast("bigint").alias("cut_start"), F.col("cut_end").cast("bigint").alias("cut_end"))
