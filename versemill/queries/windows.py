"""Window, sessionisation and timeline queries over notes, turns, jobs and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from versemill import bindings as B
from versemill.functions import kana as K
from versemill.operators import timeline as TL
from versemill.plans.ordered import by_width
from versemill.queries.registry import query

BY, ORDER = ["song_id"], ["start_ms", "note_id"]
S = B.song_slice
N = B.with_(B.NOTES)
WIN = "WINDOW w AS (PARTITION BY song_id ORDER BY start_ms, note_id)"
_I = lambda e: f"CAST({e} AS BIGINT)"


@query(
    "w1_line_segmentation",
    N + f"SELECT note_id, {_I('sum(CASE WHEN channel = $$signup$$ THEN 1 ELSE 0 END) OVER w')} AS line_no FROM notes {WIN}".replace("$$", "'"),
)
def w1(spark, d):
    n = B.notes(spark, d)
    return TL.line_numbers(n, BY, ORDER, S(), F.col("channel") == "signup").select("note_id", "line_no")


_RAW = """CASE channel WHEN 'signup' THEN '/る' WHEN 'error' THEN CASE WHEN note_id % 2 = 0 THEN '/る[ほ]' ELSE '意[' END
  WHEN 'click' THEN 'ほ' WHEN 'view' THEN CASE WHEN note_id % 3 = 0 THEN '/' ELSE 'め' END ELSE CASE WHEN note_id % 2 = 0 THEN '止[と]' ELSE 'い]' END END"""


def _lyric_events(spark, d):
    i = F.col("note_id")
    raw = (
        F.when(F.col("channel") == "signup", "/る")
        .when(F.col("channel") == "error", F.when(i % 2 == 0, "/る[ほ]").otherwise("意["))
        .when(F.col("channel") == "click", "ほ")
        .when(F.col("channel") == "view", F.when(i % 3 == 0, "/").otherwise("め"))
        .otherwise(F.when(i % 2 == 0, "止[と]").otherwise("い]"))
    )
    return B.notes(spark, d).select("song_id", "start_ms", "note_id", raw.alias("raw"))


_PARSED = f"""ev AS (SELECT song_id, start_ms, note_id, {_RAW} AS raw FROM notes),
 e1 AS (SELECT *, regexp_replace(raw, '^[/<]+', '') AS t, regexp_matches(raw, '^[/<]') AS b FROM ev),
 e2 AS (SELECT *, last_value(CASE WHEN contains(t, '[') AND NOT contains(t, ']') THEN 'open' WHEN contains(t, ']') THEN 'closed' END IGNORE NULLS)
    OVER (PARTITION BY song_id ORDER BY start_ms, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st,
    sum(CASE WHEN b THEN 1 ELSE 0 END) OVER w AS nb FROM e1 {WIN}),
 e3 AS (SELECT *, last_value(CASE WHEN t <> '' THEN nb END IGNORE NULLS)
    OVER (PARTITION BY song_id ORDER BY start_ms, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM e2),
 parsed AS (SELECT song_id, start_ms, note_id, raw, nb > coalesce(pb, 0) AS line_break,
    CASE WHEN st = 'open' THEN '' WHEN contains(t, '[') THEN split_part(t, '[', 1) ELSE t END AS surface,
    CASE WHEN st = 'open' THEN split_part(t, ']', 1) WHEN contains(t, '[') THEN split_part(split_part(t, '[', 2), ']', 1) ELSE t END AS kana
    FROM e3 WHERE t <> '')"""


@query(
    "w2_bracket_carry",
    B.with_(B.NOTES, _PARSED) + "SELECT note_id, surface, kana, line_break FROM parsed",
)
def w2(spark, d):
    return TL.parse_lyric_events(_lyric_events(spark, d), BY, ORDER, S()).select(
        "note_id", "surface", "kana", "line_break"
    )


@query(
    "w3_row_pattern_repair",
    B.with_(B.NOTES, _PARSED) + f""", p AS (SELECT *, lead(raw) OVER w AS r1, lead(raw, 2) OVER w AS r2, lead(surface) OVER w AS s1, lead(kana) OVER w AS k1,
    lead(line_break) OVER w AS b1, row_number() OVER w AS rn FROM parsed {WIN}),
 q AS (SELECT *, coalesce(rn > 1 AND line_break AND b1 AND surface <> '' AND surface = s1 AND raw = '/' || surface AND r1 = '/' || surface || '[' || k1 || ']'
    AND r2 = k1 AND surface = kana AND k1 <> '' AND k1 <> kana, false) AS hit FROM p),
 z AS (SELECT *, coalesce(lag(hit) OVER w, false) AS after_hit FROM q {WIN})
SELECT note_id, CASE WHEN after_hit THEN '' ELSE surface END AS surface, CASE WHEN after_hit THEN 'ー' ELSE kana END AS kana,
  line_break AND NOT hit AND NOT after_hit AS line_break, hit AS repaired FROM z""",
)
def w3(spark, d):
    events = TL.parse_lyric_events(_lyric_events(spark, d), BY, ORDER, S())
    return TL.repair_word_breaks(events, BY, ORDER, S()).select(
        "note_id", "surface", "kana", "line_break", "repaired"
    )


@query(
    "w4_phrase_grouping",
    N + f""", g AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w < 400 THEN 0 ELSE 1 END AS new FROM notes {WIN}),
 h AS (SELECT *, sum(new) OVER w AS phrase FROM g {WIN})
SELECT note_id, {_I('phrase')} AS phrase, (row_number() OVER (PARTITION BY song_id, phrase ORDER BY start_ms, note_id) - 1) // 12 AS part FROM h""",
)
def w4(spark, d):
    out = TL.group_phrases(B.notes(spark, d), BY, ORDER, S(), "start_ms", "end_ms", 400)
    return out.select("note_id", "phrase", "part")


@query(
    "w6_legato_gap_close",
    N + f""", g AS (SELECT *, lead(start_ms) OVER w AS nx FROM notes {WIN})
SELECT note_id, CASE WHEN nx - end_ms > 0 AND nx - end_ms <= 150 THEN nx ELSE end_ms END AS end_ms FROM g""",
)
def w6(spark, d):
    out = TL.close_small_gaps(B.notes(spark, d), BY, ORDER, S(), "start_ms", "end_ms", 150)
    return out.select("note_id", "end_ms")


_MONO = f"mono AS (SELECT song_id, note_id, channel, pitch, start_ms, least(end_ms, coalesce(lead(start_ms) OVER w, end_ms)) AS end_ms FROM notes {WIN})"


def _mono(spark, d):
    """Single-voice notes: each ends at the latest where the next one starts."""
    from versemill.plans.ordered import lead, scan

    n = scan(B.notes(spark, d), BY, ORDER, S(), nx=lead("start_ms"))
    return n.withColumn("end_ms", F.least("end_ms", F.coalesce("nx", "end_ms"))).drop("nx")


@query(
    "w7_melisma_insertion",
    B.with_(B.NOTES, _MONO) + f""", a AS (SELECT *, channel <> 'error' AS m, row_number() OVER w AS rn, coalesce(start_ms - lag(end_ms) OVER w > 250, true) AS far FROM mono {WIN}),
 b AS (SELECT *, max(CASE WHEN m THEN rn END) OVER w AS lm, max(CASE WHEN NOT m AND far THEN rn END) OVER w AS lf FROM a {WIN})
SELECT note_id, NOT m AS is_melisma FROM b WHERE m OR (lm IS NOT NULL AND (lf IS NULL OR lf < lm))""",
)
def w7(spark, d):
    out = TL.insert_melisma(_mono(spark, d), BY, ORDER, S(), "start_ms", "end_ms", F.col("channel") != "error", 250)
    return out.select("note_id", "is_melisma")


_ID_SLICE = lambda: F.floor(F.col("note_id") / 4096)


@query(
    "w8_monotone_clamp",
    N + """, j AS (SELECT song_id, note_id, start_ms + note_id * 7919 % 500 - 250 AS s, end_ms + note_id * 7919 % 500 - 250 AS e FROM notes),
 a AS (SELECT *, max(s) OVER w AS ms FROM j WINDOW w AS (PARTITION BY song_id ORDER BY note_id)),
 b AS (SELECT *, greatest(e, ms + 50) AS me, lead(ms) OVER w AS nx FROM a WINDOW w AS (PARTITION BY song_id ORDER BY note_id))
SELECT note_id, ms AS start_ms, least(me, coalesce(nx, me)) AS end_ms FROM b""",
)
def w8(spark, d):
    jitter = F.col("note_id") * 7919 % 500 - 250
    n = B.notes(spark, d).withColumns({"start_ms": F.col("start_ms") + jitter, "end_ms": F.col("end_ms") + jitter})
    out = TL.monotone_spans(n, BY, ["note_id"], _ID_SLICE(), "start_ms", "end_ms", 50)
    return out.select("note_id", "start_ms", "end_ms")


@query(
    "w8_tick_cascade",
    N + f""", RECURSIVE_IN AS (SELECT song_id, note_id, start_ms AS s, end_ms AS e, row_number() OVER w AS rn FROM notes {WIN}),
 lv AS (SELECT *, max(greatest(e, s + 1) - rn) OVER (PARTITION BY song_id ORDER BY rn) AS top,
   max(greatest(e, s + 1) - rn) OVER (PARTITION BY song_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM RECURSIVE_IN)
SELECT note_id, greatest(s, coalesce(before + rn - 1, s)) AS start_tick, top + rn AS end_tick FROM lv""",
)
def w8_cascade(spark, d):
    out = TL.cascade_spans(B.notes(spark, d), BY, ORDER, S(), "start_ms", "end_ms", 1)
    return out.select("note_id", F.col("start_ms").alias("start_tick"), F.col("end_ms").alias("end_tick"))


@query(
    "w9_interpolate_missing",
    N + """, g AS (SELECT song_id, note_id, CASE WHEN channel <> 'error' THEN start_ms END AS s, CASE WHEN channel <> 'error' THEN end_ms END AS e FROM notes),
 h AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pe,
   first_value(s IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY note_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns FROM g)
SELECT note_id, coalesce(s, pe) AS start_ms, CASE WHEN s IS NOT NULL THEN e ELSE greatest(coalesce(ns, pe), pe) END AS end_ms FROM h""",
)
def w9(spark, d):
    known = F.col("channel") != "error"
    n = B.notes(spark, d).withColumns(
        {"start_ms": F.when(known, F.col("start_ms")), "end_ms": F.when(known, F.col("end_ms"))}
    )
    out = TL.interpolate_spans(n, BY, ["note_id"], _ID_SLICE(), "start_ms", "end_ms")
    return out.select("note_id", "start_ms", "end_ms")


@query(
    "w10_pitch_fill",
    N + """, g AS (SELECT song_id, note_id, CASE WHEN channel IN ('view', 'purchase') THEN pitch * 2 END AS p FROM notes)
SELECT note_id, greatest(36, least(96, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY note_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(p IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY note_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 60))) AS pitch FROM g""",
)
def w10(spark, d):
    n = B.notes(spark, d).withColumn("pitch", F.when(F.col("channel").isin("view", "purchase"), F.col("pitch") * 2))
    return TL.fill_pitch(n, BY, ["note_id"], _ID_SLICE(), "pitch").select("note_id", "pitch")


@query(
    "w11_voiced_run_end",
    N + f""", g AS (SELECT *, channel IN ('view', 'click') AS u, row_number() OVER w - row_number() OVER (PARTITION BY song_id, channel IN ('view', 'click') ORDER BY start_ms, note_id) AS isl FROM notes {WIN}),
 r AS (SELECT song_id, u, isl, min(start_ms) AS f, count(*) AS n FROM g GROUP BY 1, 2, 3)
SELECT song_id, coalesce(min(CASE WHEN u AND n >= 3 THEN f END), 30000) AS voiced_end FROM r GROUP BY song_id""",
)
def w11(spark, d):
    voiced = ~F.col("channel").isin("view", "click")
    return TL.voiced_end(B.notes(spark, d), BY, ORDER, S(), "start_ms", voiced, F.lit(30_000).cast("bigint"))


_HOLD = f"""hold AS (SELECT *, CASE WHEN nx IS NULL THEN end_ms + 300 ELSE least(greatest(end_ms, nx), end_ms + 300) END AS show_end
  FROM (SELECT *, lead(start_ms) OVER w AS nx FROM notes {WIN}))"""


@query(
    "w12_display_hold",
    B.with_(B.NOTES, _HOLD) + "SELECT note_id, show_end, greatest(end_ms, coalesce(nx, end_ms)) AS show_end_next FROM hold",
)
def w12(spark, d):
    n = B.notes(spark, d)
    a = TL.display_hold(n, BY, ORDER, S(), "start_ms", "end_ms", 300)
    b = TL.display_hold(n, BY, ORDER, S(), "start_ms", "end_ms", 300, hold_next=True)
    return a.select("note_id", "show_end").join(
        b.select("note_id", F.col("show_end").alias("show_end_next")), "note_id"
    )


_CUES = f"""lead_c AS (SELECT song_id, note_id, greatest(0, start_ms - 10) AS s, greatest(greatest(0, start_ms - 10), show_end - 10) AS e FROM hold),
 cues AS (SELECT song_id, note_id, s, least(e, coalesce(lead(s) OVER (PARTITION BY song_id ORDER BY s, note_id), e)) AS e FROM lead_c)"""


def _cues(spark, d):
    held = TL.display_hold(B.notes(spark, d), BY, ORDER, S(), "start_ms", "end_ms", 300)
    c = TL.lead_cues(held, BY, ORDER, S(), "start_ms", "show_end", 10)
    return c.select("song_id", "note_id", F.col("start_ms").alias("s"), F.col("show_end").alias("e"))


@query(
    "w13_cue_lead_and_title",
    B.with_(B.NOTES, _HOLD, _CUES) + """, t AS (SELECT song_id, CASE WHEN min(start_ms) >= 100 THEN min(start_ms) + 200 ELSE 0 END AS te FROM notes GROUP BY 1)
SELECT c.song_id, 'cue' AS kind, greatest(s, te) AS s, e FROM cues c JOIN t USING (song_id) WHERE te <= 0 OR e > te
UNION ALL SELECT song_id, 'title', 0, te FROM t WHERE te > 0""",
)
def w13(spark, d):
    cues = _cues(spark, d).withColumn("kind", F.lit("cue"))
    first = F.min("start_ms")
    titles = B.notes(spark, d).groupBy("song_id").agg(
        F.when(first >= 100, first + 200).otherwise(F.lit(0).cast("bigint")).alias("title_end")
    )
    return TL.prepend_title(cues, titles, BY, "s", "e", "kind")


_TOT = "tot AS (SELECT c_custkey AS song_id, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 26500 END AS total FROM customer)"


def _totals(spark, d):
    k = F.col("c_custkey")
    return B.table(spark, d, "customer").select(
        k.alias("song_id"), F.when(k % 9 == 0, 0).otherwise(26_500).cast("bigint").alias("total")
    )


_IDLE = """cov AS (SELECT *, max(e) OVER (PARTITION BY song_id ORDER BY s, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM cues),
 edge AS (SELECT song_id, min(s) AS f, max(e) AS l FROM cues GROUP BY 1),
 idle AS (SELECT song_id, 'interlude' AS kind, c AS a, s AS b FROM cov JOIN tot USING (song_id) WHERE total > 0 AND s > c
  UNION ALL SELECT song_id, 'intro', 0, coalesce(f, total) FROM tot LEFT JOIN edge USING (song_id) WHERE total > 0 AND coalesce(f > 0, true)
  UNION ALL SELECT song_id, 'outro', l, total FROM tot JOIN edge USING (song_id) WHERE total > 0 AND total > l)"""


@query(
    "w14_gap_classification",
    B.with_(B.NOTES, _HOLD, _CUES, _TOT, _IDLE) + "SELECT song_id, kind, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS \"end\" FROM idle",
)
def w14(spark, d):
    return TL.idle_sections(_cues(spark, d), _totals(spark, d), BY, ["s", "note_id"], S("s"), "s", "e")


@query(
    "w15_timeline_fill",
    B.with_(B.NOTES, _HOLD, _CUES, _TOT, _IDLE) + """SELECT song_id, 'fill' AS kind, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end" FROM idle
UNION ALL SELECT song_id, 'cue', s, e FROM cues WHERE e > s""",
)
def w15(spark, d):
    return TL.fill_timeline(_cues(spark, d), _totals(spark, d), BY, ["s", "note_id"], S("s"), "s", "e")


@query(
    "w16_subtitle_spans",
    N + f""", sp AS (SELECT song_id, note_id, row_number() OVER w AS rn, start_ms - 15 AS s, end_ms + 15 AS e, lead(start_ms - 15) OVER w AS nx FROM notes {WIN}),
 lv AS (SELECT *, greatest(least(e, coalesce(nx, e)), s + 20) - rn * 20 AS lvl FROM sp),
 tp AS (SELECT *, max(lvl) OVER (PARTITION BY song_id ORDER BY rn) AS top,
   max(lvl) OVER (PARTITION BY song_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf FROM lv)
SELECT note_id, greatest(s, coalesce(bf + (rn - 1) * 20, s)) AS sub_start, CASE WHEN nx IS NULL THEN e ELSE top + rn * 20 END AS sub_end FROM tp""",
)
def w16(spark, d):
    n = B.notes(spark, d).select("song_id", "note_id", (F.col("start_ms") - 15).alias("s"), (F.col("end_ms") + 15).alias("e"))
    out = TL.cascade_spans(n, BY, ["s", "note_id"], S("s"), "s", "e", 20, clip_to_next=True)
    return out.select("note_id", F.col("s").alias("sub_start"), F.col("e").alias("sub_end"))


@query(
    "w17_consecutive_groups",
    B.with_(B.TURNS) + """, k AS (SELECT song_id, line_id, CASE WHEN length(text) % 5 > 0 THEN length(text) % 2 END AS k FROM turns),
 p AS (SELECT *, lag(k) OVER (PARTITION BY song_id ORDER BY line_id) AS pk FROM k),
 g AS (SELECT *, sum(CASE WHEN k = pk THEN 0 ELSE 1 END) OVER (PARTITION BY song_id ORDER BY line_id) AS g FROM p)
SELECT song_id, CAST(g AS BIGINT) AS group_no, min(line_id) AS first_line, max(line_id) AS last_line, count(*) AS n_lines FROM g GROUP BY 1, 2""",
)
def w17(spark, d):
    n = F.length("text")
    t = B.turns(spark, d).select("song_id", "line_id", F.when(n % 5 > 0, n % 2).alias("k"))
    g = TL.consecutive_groups(t, BY, ["line_id"], by_width("line_id", 1024), "k")
    return g.groupBy("song_id", "group_no").agg(
        F.min("line_id").alias("first_line"), F.max("line_id").alias("last_line"), F.count("*").alias("n_lines")
    )


@query(
    "w18_granularity",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'line' END, CASE o_orderpriority WHEN '1-URGENT' THEN 'phrase' WHEN '2-HIGH' THEN 'line' END,
  CASE WHEN o_custkey % 2 = 0 THEN 'phrase' ELSE 'line' END) AS granularity FROM orders""",
)
def w18(spark, d):
    o = B.table(spark, d, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderstatus") == "F", "line").otherwise(F.col("o_orderstatus")).alias("element"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "phrase")
        .when(F.col("o_orderpriority") == "2-HIGH", "line")
        .otherwise("bad")
        .alias("override"),
    )
    default = F.when(F.col("o_custkey") % 2 == 0, "phrase").otherwise("line")
    out = TL.resolve_setting(o, ["element", "override"], ["line", "phrase"], default, "granularity")
    return out.select("o_orderkey", "granularity")


@query(
    "w19_shared_note_arbitration",
    B.with_(B.WORDS) + """, c AS (SELECT line_id, word_id % 50 AS note, pos, cents, qty FROM words),
 r AS (SELECT *, row_number() OVER (PARTITION BY line_id, note ORDER BY qty DESC, pos, cents) AS rn, count(*) OVER (PARTITION BY line_id, note) AS claims FROM c)
SELECT line_id, note, pos, qty AS overlap, claims FROM r WHERE rn = 1""",
)
def w19(spark, d):
    from versemill.operators.mapping import arbitrate_notes

    claims = B.words(spark, d).select("line_id", (F.col("word_id") % 50).alias("note"), "pos", "cents", F.col("qty").alias("overlap"))
    return arbitrate_notes(claims, ["line_id", "note"], "overlap", ["pos", "cents"]).select(
        "line_id", "note", "pos", "overlap", "claims"
    )


@query(
    "w20_dense_renumber",
    B.with_(B.JOBS) + """SELECT owner, job_id, dense_rank() OVER (PARTITION BY owner ORDER BY job_id) - 1 AS new_id,
  job_id <> dense_rank() OVER (PARTITION BY owner ORDER BY job_id) - 1 AS changed FROM jobs WHERE status <> 'P'""",
)
def w20(spark, d):
    from versemill.plans.ordered import row_number, scan

    j = B.jobs(spark, d).where(F.col("status") != "P").select("owner", "job_id")
    out = scan(j, ["owner"], ["job_id"], B.row_slice("job_id"), rn=row_number())
    new_id = F.col("rn") - 1
    return out.select("owner", "job_id", new_id.alias("new_id"), (F.col("job_id") != new_id).alias("changed"))


@query(
    "w21_on_off_pairing",
    N + f""", g AS (SELECT *, channel IN ('view', 'purchase') AS is_on, lead(channel IN ('view', 'purchase')) OVER x AS nxt, lead(start_ms) OVER x AS off_ms FROM notes
  WINDOW x AS (PARTITION BY song_id, pitch % 4 ORDER BY start_ms, note_id))
SELECT note_id, off_ms AS end_at FROM g WHERE is_on AND nxt = false""",
)
def w21(spark, d):
    n = B.notes(spark, d).withColumn("key", F.col("pitch") % 4)
    on = F.col("channel").isin("view", "purchase")
    return TL.pair_on_off(n, ["song_id", "key"], ORDER, S(), on, "start_ms").select("note_id", "end_at")


@query(
    "w22_rest_fill",
    N + f""", g AS (SELECT *, lead(start_ms) OVER w AS nx, row_number() OVER w AS rn FROM notes {WIN}),
 h AS (SELECT *, CASE WHEN nx IS NOT NULL AND (nx < end_ms OR nx - end_ms < 60) THEN nx ELSE end_ms END AS stop FROM g)
SELECT song_id, 'note' AS kind, start_ms AS start, stop AS "end" FROM h UNION ALL SELECT song_id, 'rest', stop, nx FROM h WHERE nx > stop
UNION ALL SELECT song_id, 'rest', 0, start_ms FROM h WHERE rn = 1 AND start_ms > 0""",
)
def w22(spark, d):
    out = TL.fill_rests(B.notes(spark, d), BY, ORDER, S(), "start_ms", "end_ms", 60)
    return out.select("song_id", "kind", "start", "end")


@query(
    "w23_frame_quantise",
    N + f""", f AS (SELECT *, CAST(round_even(start_ms * 93.75 / 1000, 0) AS BIGINT) AS sf, CAST(round_even(end_ms * 93.75 / 1000, 0) AS BIGINT) AS ef FROM notes),
 a AS (SELECT *, max(ef) OVER (PARTITION BY song_id ORDER BY start_ms, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM f WHERE ef > sf),
 b AS (SELECT *, greatest(sf, coalesce(cur, 0)) AS s, greatest(sf, coalesce(cur, 0)) - coalesce(cur, 0) AS gap FROM a),
 c AS (SELECT *, gap = 1 AND cur IS NOT NULL AS absorb FROM b WHERE ef > s)
SELECT note_id, CASE WHEN gap = 1 AND cur IS NULL THEN 0 ELSE s END AS start_f, ef + CASE WHEN lead(absorb) OVER w THEN 1 ELSE 0 END AS end_f,
  CASE WHEN gap > 1 THEN gap ELSE 0 END AS rest_before FROM c {WIN}""",
)
def w23(spark, d):
    frame = lambda c: F.bround(F.col(c) * 93.75 / 1000).cast("bigint")
    out = TL.quantise_frames(B.notes(spark, d), BY, ORDER, S(), frame("start_ms"), frame("end_ms"))
    return out.select("note_id", "start_f", "end_f", "rest_before")


_BOUND = """CASE WHEN {i} <= 0 THEN 0 WHEN {i} >= m THEN total WHEN total < att * (m - 1) + 6 THEN CAST(round_even(total * {i} / m, 0) AS BIGINT)
  WHEN flag = 'A' THEN total - att * (m - {i}) ELSE att * {i} END"""


@query(
    "w25_mora_slots",
    B.with_(B.WORDS) + f""", t AS (SELECT line_id, pos, word_id, cents, flag, qty * 4 AS total, 1 + word_id % 4 AS m, greatest(1, least(15, CAST(round_even(qty * 4 * 0.3::DOUBLE, 0) AS BIGINT))) AS att FROM words),
 s AS (SELECT t.*, slot FROM t, unnest(range(0, m)) AS u(slot))
SELECT line_id, pos, word_id, cents, slot, {_BOUND.format(i='slot')} AS slot_start, {_BOUND.format(i='(slot + 1)')} AS slot_end FROM s""",
)
def w25(spark, d):
    w = B.words(spark, d).withColumns({"total": F.col("qty") * 4, "m": 1 + F.col("word_id") % 4})
    out = TL.mora_slots(w, "total", "m", F.when(F.col("flag") == "A", "back").otherwise("front"))
    return out.select("line_id", "pos", "word_id", "cents", "slot", "slot_start", "slot_end")


@query(
    "w26_vowel_carry",
    N + f""", k AS (SELECT song_id, start_ms, note_id, CASE pitch % 7 WHEN 0 THEN 'ー' WHEN 1 THEN 'ーン' WHEN 2 THEN 'ン' WHEN 3 THEN 'キ' WHEN 4 THEN 'ロ' WHEN 5 THEN 'スー' ELSE 'メ' END AS k FROM notes),
 v AS (SELECT *, CASE k WHEN 'キ' THEN 'イ' WHEN 'ロ' THEN 'オ' WHEN 'スー' THEN 'ウ' WHEN 'メ' THEN 'エ' END AS v FROM k)
SELECT note_id, CASE WHEN k LIKE 'ー%' THEN coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY start_ms, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'ア') || substr(k, 2) ELSE k END AS kana FROM v""",
)
def w26(spark, d):
    sample = F.array(*[F.lit(x) for x in ("ー", "ーン", "ン", "キ", "ロ", "スー", "メ")])
    n = B.notes(spark, d).withColumn("kana", F.element_at(sample, (F.col("pitch") % 7 + 1).cast("int")))
    return TL.carry_vowel(n, BY, ORDER, S(), "kana", K.vowel_of(F.col("kana"))).select("note_id", "kana")


@query(
    "w27_even_distribution",
    B.with_(B.WORDLIST) + "SELECT list, id, ntile(7) OVER (PARTITION BY list ORDER BY id) AS bucket FROM wordlist",
)
def w27(spark, d):
    items = B.wordlist(spark, d).select("list", "id")
    buckets = items.select("list").distinct().withColumn("n", F.lit(7))
    return TL.distribute_evenly(items, buckets, ["list"], ["id"], B.row_slice("id"), "n").withColumn(
        "bucket", F.col("bucket").cast("bigint")
    )


@query(
    "w29_pagination",
    B.with_(B.WORDLIST) + """, n AS (SELECT list, count(*) AS n, max(size) / 5.0 AS sec FROM wordlist GROUP BY 1),
 p AS (SELECT list, CEIL(n / least(least(4, greatest(1, CEIL(n / 120.0))), greatest(1, floor(sec / 3)))) AS size FROM n)
SELECT list, id, CAST(floor((row_number() OVER (PARTITION BY list ORDER BY id) - 1) / p.size) + 1 AS BIGINT) AS page FROM wordlist JOIN p USING (list)""",
)
def w29(spark, d):
    w = B.wordlist(spark, d).select("list", "id", (F.col("size") / 5).alias("sec"))
    return TL.paginate(w, ["list"], ["id"], B.row_slice("id"), seconds="sec").select("list", "id", "page")


@query(
    "w30_proportional_split",
    B.with_(B.TURNS) + """, w AS (SELECT song_id, line_id, greatest(1, length(text) % 40) AS w, 8 + song_id % 60 AS L FROM turns),
 a AS (SELECT *, row_number() OVER x AS i, sum(w) OVER x AS up, sum(w) OVER (PARTITION BY song_id) AS tot, count(*) OVER (PARTITION BY song_id) AS n FROM w WINDOW x AS (PARTITION BY song_id ORDER BY line_id)),
 b AS (SELECT *, max(greatest(0, least(CAST(round_even(L * up / tot, 0) AS BIGINT), L - (n - i)) - i)) OVER (PARTITION BY song_id ORDER BY line_id) AS top FROM a),
 c AS (SELECT *, CASE WHEN i = n THEN L ELSE top + i END AS ce FROM b)
SELECT song_id, line_id, CAST(coalesce(lag(ce) OVER (PARTITION BY song_id ORDER BY line_id), 0) AS BIGINT) AS cut_start, CAST(ce AS BIGINT) AS cut_end FROM c""",
)
def w30(spark, d):
    t = B.turns(spark, d).select(
        "song_id", "line_id", (F.length("text") % 40).alias("w"), (8 + F.col("song_id") % 60).alias("L")
    )
    out = TL.proportional_cuts(t, BY, ["line_id"], by_width("line_id", 1024), F.col("w"), "L")
    return out.select(
        "song_id", "line_id", F.col("cut_start").cast("bigint").alias("cut_start"), F.col("cut_end").cast("bigint").alias("cut_end")
    )


@query(
    "w33_ordered_retention",
    N + """, r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY start_ms DESC, note_id DESC) AS rank FROM notes WHERE 26000 - start_ms <= 9000)
SELECT song_id, note_id, rank FROM r WHERE rank <= 5""",
)
def w33(spark, d):
    n = B.notes(spark, d)
    out = TL.keep_newest(n, BY, F.lit(26_000) - F.col("start_ms"), 9_000, [F.col("start_ms").desc(), F.col("note_id").desc()], 5)
    return out.select("song_id", "note_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "w34_ttl_expiry",
    B.with_(B.JOBS) + "SELECT job_id FROM jobs WHERE status IN ('F', 'O') AND coalesce(CASE WHEN job_id % 3 > 0 THEN created_h + job_id % 30 END, created_h) <= 2400 - 500",
)
def w34(spark, d):
    j = B.jobs(spark, d).withColumn("finished_h", F.when(F.col("job_id") % 3 > 0, F.col("created_h") + F.col("job_id") % 30))
    return TL.expired(j, "status", ["F", "O"], "finished_h", "created_h", 2400, 500).select("job_id")


@query(
    "w35_rolling_quota",
    B.with_(B.JOBS) + """SELECT job_id, count(*) FILTER (priority <> '5-LOW') OVER (PARTITION BY owner ORDER BY created_h RANGE BETWEEN 239 PRECEDING AND CURRENT ROW) AS recent_owner,
  count(*) FILTER (priority <> '5-LOW') OVER (PARTITION BY owner % 20 ORDER BY created_h RANGE BETWEEN 239 PRECEDING AND CURRENT ROW) AS recent_client FROM jobs""",
)
def w35(spark, d):
    """Jobs of the owner and of the client in the trailing window; exempt jobs do not count."""
    j = B.jobs(spark, d).withColumn("client", F.col("owner") % 20)
    counted = F.col("priority") != "5-LOW"
    a = TL.trailing_count(j, ["owner"], "created_h", ["created_h", "job_id"], 168, 240, counted)
    b = TL.trailing_count(j, ["client"], "created_h", ["created_h", "job_id"], 24, 240, counted)
    return a.select("job_id", F.col("recent").alias("recent_owner")).join(
        b.select("job_id", F.col("recent").alias("recent_client")), "job_id"
    )


@query(
    "w36_queue_depth",
    B.with_(B.JOBS) + """, e AS (SELECT priority, job_id, created_h AS t, 1 AS d FROM jobs UNION ALL SELECT priority, job_id, created_h + 1 + job_id % 30, -1 FROM jobs WHERE status <> 'P'),
 s AS (SELECT *, sum(d) OVER (PARTITION BY priority ORDER BY t, d, job_id) AS depth FROM e)
SELECT priority, job_id, t AS created_h, CAST(depth AS BIGINT) AS depth FROM s WHERE d = 1""",
)
def w36(spark, d):
    j = B.jobs(spark, d).withColumn("end_h", F.when(F.col("status") != "P", F.col("created_h") + 1 + F.col("job_id") % 30))
    return TL.queue_depth(j, ["priority"], "job_id", "created_h", "end_h", 24)
