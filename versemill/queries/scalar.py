"""Scalar functions over document words, whole documents and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from versemill import bindings as B
from versemill.functions import kana as K
from versemill.functions import music as M
from versemill.functions import text as T
from versemill.functions.registry import register
from versemill.plans.ordered import running_sum, scan
from versemill.queries.registry import query

ROWS, VOWELS = K.ROW_CHARS, K.ROW_VOWELS


def _vowel(ch: str) -> str:
    return f"(CASE WHEN length({ch}) > 0 AND strpos('{ROWS}', {ch}) > 0 THEN translate({ch}, '{ROWS}', '{VOWELS}') END)"


_BIG = "CAST({} AS BIGINT)".format
_MORA = f"[{K.SMALL_KANA}ー]*"
_KW = B.with_(B.KANA_WORDS)


@query(
    "f1_split_moras",
    _KW + f"""SELECT word, array_to_string(regexp_extract_all(kana, '.{_MORA}'), '|') AS moras,
  array_to_string(regexp_extract_all(kana, '.[{K.SMALL_KANA}]*'), '|') AS fine_moras,
  CAST(len(regexp_extract_all(kana, '.{_MORA}')) AS BIGINT) AS n_moras FROM kw""",
)
def f1(spark, d):
    k = F.col("kana")
    return B.kana_words(spark, d).select(
        "word",
        F.array_join(K.split_moras(k), "|").alias("moras"),
        F.array_join(K.split_fine_moras(k), "|").alias("fine_moras"),
        F.size(K.split_moras(k)).cast("bigint").alias("n_moras"),
    )


@query("f2_vowel_of", _KW + f"SELECT word, {_vowel('right(rtrim(kana, chr(12540)), 1)')} AS vowel FROM kw")
def f2(spark, d):
    return B.kana_words(spark, d).select("word", K.vowel_of(F.col("kana")).alias("vowel"))


_CHARS = """ch AS (SELECT word, i, kana[i] AS c FROM kw, unnest(range(1, length(kana) + 1)) AS u(i)),
  st AS (SELECT word, i, c, """ + _vowel("c") + """ AS v FROM ch)"""


@query(
    "f3_normalize_small_vowels",
    _KW[:-1] + "," + _CHARS + f""", pv AS (SELECT word, i, c, v, last_value(CASE WHEN c <> 'ー' THEN coalesce(v, '?') END IGNORE NULLS)
    OVER (PARTITION BY word ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM st)
SELECT word, string_agg(CASE WHEN strpos('{K.SMALL_VOWELS}', c) > 0 AND (p IS NULL OR p = '?' OR p = v)
  THEN translate(c, '{K.SMALL_VOWELS}', '{K.LARGE_VOWELS}') ELSE c END, '' ORDER BY i) AS opened FROM pv GROUP BY word""",
)
def f3(spark, d):
    return B.kana_words(spark, d).select("word", K.normalize_small_vowels(F.col("kana")).alias("opened"))


@query(
    "f4_open_long_vowel_runs",
    _KW[:-1] + "," + _CHARS + """, pv AS (SELECT word, i, c, lag(c) OVER w AS before,
    last_value(CASE WHEN c <> 'ー' THEN coalesce(v, 'ー') END IGNORE NULLS)
    OVER (PARTITION BY word ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM st
    WINDOW w AS (PARTITION BY word ORDER BY i))
SELECT word, string_agg(CASE WHEN c = 'ー' AND before = 'ー' THEN coalesce(p, c) ELSE c END, '' ORDER BY i) AS opened
FROM pv GROUP BY word""",
)
def f4(spark, d):
    return B.kana_words(spark, d).select("word", K.open_long_vowel_runs(F.col("kana")).alias("opened"))


_LAST = "right(acc, 1)"
_LONG_STEP = f"""acc || CASE WHEN (x = 'ウ' AND {_vowel(_LAST)} IN ('オ', 'ウ')) OR (x = 'イ' AND {_vowel(_LAST)} IN ('エ', 'イ'))
  OR (x IN ('ア', 'イ', 'ウ', 'エ', 'オ') AND {_vowel(_LAST)} = x) THEN 'ー' ELSE x END"""


@query(
    "f5_normalize_long_vowels",
    _KW + f"""SELECT word, list_reduce(regexp_extract_all(kana, '.'), lambda acc, x: {_LONG_STEP}, '') AS long_form FROM kw""",
)
def f5(spark, d):
    return B.kana_words(spark, d).select("word", K.normalize_long_vowels(F.col("kana")).alias("long_form"))


@query(
    "f6_kana_conversion",
    _KW[:-1] + f""", h AS (SELECT word, kana, translate(kana, '{K.KATAKANA}', '{K.HIRAGANA}') AS hira FROM kw)
SELECT word, hira, translate(hira, '{K.HIRAGANA}', '{K.KATAKANA}') AS kata,
  regexp_replace(left(word, 2) || '・' || kana || word, '[^ァ-ヺー]', '', 'g') AS only_kana,
  translate('・' || kana || ' = ' || word, '{K.SILENT_SYMBOLS}', '') AS sounded FROM h""",
)
def f6(spark, d):
    k, w = F.col("kana"), F.col("word")
    return B.kana_words(spark, d).withColumn("hira", K.to_hiragana(k)).select(
        "word",
        "hira",
        K.to_katakana(F.col("hira")).alias("kata"),
        K.keep_kana(F.concat(F.left(w, F.lit(2)), F.lit("・"), k, w)).alias("only_kana"),
        K.strip_silent(F.concat(F.lit("・"), k, F.lit(" = "), w)).alias("sounded"),
    )


@query(
    "f6_strip_punctuation",
    r"""SELECT doc_id, CAST(length(regexp_replace(text, '[\s、。,.!?！？・「」『』()（）〜~-]', '', 'g')) AS BIGINT) AS kept,
  md5(regexp_replace(text, '[\s、。,.!?！？・「」『』()（）〜~-]', '', 'g')) AS digest FROM documents""",
)
def f6_strip(spark, d):
    s = K.strip_punctuation(F.col("text"))
    return B.documents(spark, d).select(
        "doc_id", F.length(s).cast("bigint").alias("kept"), F.md5(s).alias("digest")
    )


_RUN = f"[{K.KANA_CLASS}{K.SILENT_SYMBOLS}]"


@query(
    "f7_script_runs",
    f"""WITH r AS (SELECT doc_id, regexp_extract_all(translate(text, 'aeiou', 'アエイオウ'),
   '(?s)[{K.KANA_CLASS}{K.SILENT_SYMBOLS}]+|[^{K.KANA_CLASS}{K.SILENT_SYMBOLS}]+') AS runs FROM documents),
 x AS (SELECT doc_id, i AS run_no, runs[i] AS run FROM r, unnest(range(1, len(runs) + 1)) AS u(i)),
 y AS (SELECT doc_id, run_no, run, CAST(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY run_no) AS BIGINT) AS stop FROM x)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_runs, CAST(count(*) FILTER (regexp_matches(run, '^{_RUN}')) AS BIGINT) AS n_kana,
  CAST(sum((stop - length(run)) * (run_no % 7)) AS BIGINT) AS start_check, CAST(max(stop) AS BIGINT) AS stop FROM y GROUP BY doc_id""",
)
def f7(spark, d):
    """Runs of every text with their offsets; offsets come from a sliced running sum.

    Runs are summed up inside their text's row, by slices of 4096 runs, and the running
    sum is one over slices. Runs of texts of one id are taken in order of their numbers.
    """
    one, zero = F.col("texts")[0], F.lit(0).cast("bigint")

    def numbered(text):
        run = lambda r, i: F.struct((i + 1).cast("bigint").alias("run_no"), F.length(r).cast("bigint").alias("n"), K.is_kana_run(r).alias("is_kana"))
        return F.transform(K.script_runs(F.translate(text, "aeiou", "アエイオウ")), run)

    single = F.size("texts") == 1
    runs = F.when(single, numbered(one)).otherwise(F.array_sort(F.flatten(F.transform("texts", numbered))))
    rows = B.texts(spark, d).select("doc_id", single.alias("single"), F.explode(F.array(runs)).alias("runs")).where(F.size("runs") > 0)
    last = F.floor(F.element_at("runs", -1)["run_no"] / 4096).cast("int")

    def part(k):
        own = F.slice("runs", F.greatest(k * 4096, F.lit(1)), F.when(k == 0, 4095).otherwise(4096))
        return F.when(F.col("single"), own).otherwise(F.filter("runs", lambda r: F.floor(r["run_no"] / 4096) == k))

    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("part"), part(k).alias("runs")))
    rows = rows.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.part", "p.runs").where(F.size("runs") > 0)

    def step(acc, r):
        weight = r["run_no"] % 7
        return F.struct((acc["n"] + r["n"]).alias("n"), (acc["check"] + acc["n"] * weight).alias("check"), (acc["weight"] + weight).alias("weight"))

    start = F.struct(zero.alias("n"), zero.alias("check"), zero.alias("weight"))
    sums = rows.select(
        "doc_id", "part", F.size("runs").alias("n_runs"), F.size(F.filter("runs", lambda r: r["is_kana"])).alias("n_kana"),
        F.explode(F.array(F.aggregate("runs", start, step))).alias("s"),
    ).select("doc_id", "part", "n_runs", "n_kana", "s.*")
    out = scan(sums, ["doc_id"], ["part"], F.col("part"), cut=True, before=running_sum("n", inclusive=False))
    before = F.coalesce("before", zero)
    return out.groupBy("doc_id").agg(
        F.sum("n_runs").alias("n_runs"),
        F.sum("n_kana").alias("n_kana"),
        F.sum(F.col("check") + before * F.col("weight")).alias("start_check"),
        F.max(before + F.col("n")).alias("stop"),
    )


@query("f8_ruby_segments")
def f8(spark, d):
    surface = F.translate("word", "aeiou", "アエイオウ")
    return B.kana_words(spark, d).select(
        "word",
        F.array_join(K.ruby_readings(surface, F.col("kana")), "|").alias("readings"),
        K.needs_ruby(surface, F.col("kana")).alias("needs_ruby"),
    )


@query(
    "f9_ruby_annotations",
    r"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '([a-z]{8,})', '｜\1《\1x》', 'g') AS marked FROM documents)
SELECT doc_id, regexp_replace(marked, '｜([^｜《》]+)《([^《》]*)》', '\1', 'g') = text AS restored,
  CAST(len(regexp_extract_all(text, '[a-z]{8,}')) AS BIGINT) AS n_spans,
  CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[a-z]{8,}'), lambda x: length(x) + 1)), 0) AS BIGINT) AS reading_chars
FROM a""",
)
def f9(spark, d):
    marked = F.regexp_replace("text", "([a-z]{8,})", "｜$1《$1x》")
    df = B.documents(spark, d).select("doc_id", "text", marked.alias("marked"))
    seg = F.filter(K.ruby_segments(F.col("marked")), lambda s: s["reading"].isNotNull())
    return df.withColumn("seg", seg).select(
        "doc_id",
        (K.strip_ruby(F.col("marked")) == F.col("text")).alias("restored"),
        F.size("seg").cast("bigint").alias("n_spans"),
        F.aggregate("seg", F.lit(0).cast("bigint"), lambda a, s: a + F.length(s["reading"])).alias("reading_chars"),
    )


@query(
    "f10_note_kana_classes",
    _KW[:-1] + f""", m AS (SELECT word, kana, regexp_extract_all(kana, '.{_MORA}') AS ms FROM kw),
 x AS (SELECT word, i, ms[i] AS m, CASE WHEN i > 1 THEN ms[i - 1] END AS prev FROM m, unnest(range(1, len(ms) + 1)) AS u(i)),
 y AS (SELECT word, i, m, prev, {_vowel('right(rtrim(prev, chr(12540)), 1)')} AS pv FROM x)
SELECT word, greatest(1, CAST(count(*) - count(*) FILTER (prev IS NOT NULL AND (m IN ('ン', 'ッ') OR (m IN ('イ', 'ウ') AND pv IS NOT NULL))) AS BIGINT)) AS attacks,
  regexp_full_match(any_value(translate(word, '{B.LATIN}', '{B.LATIN_KANA}')), '.[ァィゥェォー]+') AS held FROM y GROUP BY word""",
)
def f10(spark, d):
    k = F.col("kana")
    return B.kana_words(spark, d).select(
        "word", K.note_attacks(k).cast("bigint").alias("attacks"), K.held_note(k).alias("held")
    )


@query("f10_compressed_moras")
def f10_compressed(spark, d):
    """Each vowel or n after a mora folded into a long mark, then recovered from the word."""
    folded = F.regexp_replace("kana", f"(.[{K.SMALL_KANA}]*)[ンアイウエオ]", "$1ー")
    pieces = K.split_moras(folded)
    return B.kana_words(spark, d).select(
        "word", F.array_join(K.compressed_counts(F.col("kana"), pieces), "|").alias("folded")
    )


_KANA_OF_LINE = f"translate(lower(p_name), '{B.LATIN}', '{B.LATIN_KANA}')"


@query(
    "f11_expansion_candidates",
    """WITH w AS (SELECT l_orderkey AS line_id, count(*) AS n, sum(CAST(l_quantity AS BIGINT) % 3) AS budget FROM lineitem GROUP BY 1),
 s AS (SELECT l_orderkey AS line_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS slot,
   1 + CAST(l_quantity AS BIGINT) % 2 AS size FROM lineitem),
 c AS (SELECT w.line_id, mask, budget FROM w, unnest(range(1, CAST(1 AS BIGINT) << n)) AS u(mask)),
 e AS (SELECT c.line_id, mask, budget, sum(size) AS added, count(*) AS n_slots, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) AS slots,
   string_agg(lpad(CAST(slot AS VARCHAR), 2, '0'), ',' ORDER BY slot) AS k
   FROM c JOIN s ON c.line_id = s.line_id AND ((mask >> slot) & 1) = 1 GROUP BY 1, 2, 3 HAVING sum(size) <= budget)
SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY n_slots DESC, k) AS rank, slots, CAST(added AS BIGINT) AS added FROM e""",
)
def f11(spark, d):
    """All subsets of a line's compressed slots that fit its spare notes, most slots first."""
    from versemill.operators.placement import expansion_candidates

    item = B.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("line_id"),
        *[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")],
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    q = F.col("l_quantity").cast("bigint")
    lines = item.groupBy("line_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(order.alias("o"), (1 + q % 2).alias("s")))), lambda x: x["s"]
        ).alias("sizes"),
        F.sum(q % 3).alias("budget"),
    )
    return expansion_candidates(lines, "line_id", "sizes", "budget", limit=None)


_NOTE_NAME = """chr(CAST(65 + p_partkey % 7 AS INT)) || CASE p_size % 3 WHEN 0 THEN '#' WHEN 1 THEN 'b' ELSE '' END || CAST(p_size % 8 AS VARCHAR)"""
_MIDI = """(CASE left(nm, 1) WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END
  + CASE WHEN nm LIKE '%#%' THEN 1 WHEN nm LIKE '%b%' THEN -1 ELSE 0 END + (CAST(right(nm, 1) AS BIGINT) + 1) * 12)"""


@query(
    "f12_note_names",
    f"""WITH n AS (SELECT p_partkey, {_NOTE_NAME} AS nm FROM part)
SELECT p_partkey, nm AS name, CAST({_MIDI} AS BIGINT) AS midi, CAST(least({_MIDI}, 60) AS BIGINT) AS low,
  CAST(greatest({_MIDI}, 60) AS BIGINT) AS high FROM n""",
)
def f12(spark, d):
    p = B.table(spark, d, "part").select("p_partkey", "p_size")
    name = F.concat(
        F.char(F.lit(65) + F.col("p_partkey") % 7),
        F.when(F.col("p_size") % 3 == 0, "#").when(F.col("p_size") % 3 == 1, "b").otherwise(""),
        (F.col("p_size") % 8).cast("string"),
    )
    text = F.concat(F.lit("歌手 推奨音域：mid（"), F.col("name"), F.lit("～C4）"))
    r = M.pitch_range(text)
    return p.select("p_partkey", name.alias("name")).select(
        "p_partkey", "name", M.note_name_to_midi(F.col("name")).cast("bigint").alias("midi"),
        r["low"].cast("bigint").alias("low"), r["high"].cast("bigint").alias("high"),
    )


@query(
    "f13_progress",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
  ELSE least(1.0, CAST(CAST(floor(value) AS BIGINT) AS DOUBLE) / 100) END AS progress FROM events""",
)
def f13(spark, d):
    line = F.when(F.col("event_type") == "error", "stopped").otherwise(
        F.concat(F.lit("frame 1, progress = "), F.floor("value").cast("string"), F.lit(" % done"))
    )
    return B.table(spark, d, "events").select("event_id", M.parse_progress(line).alias("progress"))


@query(
    "f14_time_formats",
    B.with_(B.NOTES) + """, x AS (SELECT note_id, start_ms * 977 AS ms FROM notes), y AS (SELECT note_id, ms,
  CAST(round_even(ms / 10, 0) AS BIGINT) AS cs FROM x)
SELECT note_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt,
  printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS sub,
  CASE WHEN ms < 60000 THEN '約' || CAST(CAST(round_even(ms / 1000, 0) AS BIGINT) AS VARCHAR) || '秒'
    ELSE '約' || CAST(CAST(round_even(ms / 1000 / 60, 0) AS BIGINT) AS VARCHAR) || '分' END AS label FROM y""",
)
def f14(spark, d):
    ms = F.col("start_ms") * 977
    return B.notes(spark, d).select(
        "note_id", T.srt_time(ms).alias("srt"), T.subtitle_time(ms).alias("sub"),
        T.duration_label(ms / 1000).alias("label"),
    )


@query(
    "f15_escapes",
    r"""SELECT page_id, md5(replace(replace(replace(html, '{', '('), '}', ')'), chr(10), ' ')) AS escaped,
  left(regexp_replace(regexp_replace(html, '[\\/:*?"<>|\s]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS name FROM pages""",
)
def f15(spark, d):
    return B.table(spark, d, "pages").select(
        "page_id", F.md5(T.escape_subtitle(F.col("html"))).alias("escaped"), T.safe_name(F.col("html")).alias("name")
    )


@query(
    "f16_colours",
    """WITH c AS (SELECT doc_id, '#' || left(sha1(text), CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 8 END) AS c FROM documents)
SELECT doc_id, '&H' || CASE WHEN length(c) = 9 THEN printf('%02X', 255 - CAST('0x' || c[8:9] AS INT)) ELSE '00' END
  || upper(c[6:7] || c[4:5] || c[2:3]) AS colour FROM c""",
)
def f16(spark, d):
    c = F.concat(F.lit("#"), F.left(F.sha1("text"), F.when(F.col("doc_id") % 2 == 0, 6).otherwise(8)))
    return B.documents(spark, d).select("doc_id", T.subtitle_color(c).alias("colour"))


_STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(
    "f17_metadata_credit",
    f"""WITH m AS (SELECT page_id, {_STRIP.format("html")} AS artist FROM pages)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE concat_ws(', ',
  nullif(CASE WHEN length(artist) > 40 THEN left(artist, 39) || '…' ELSE artist END, ''),
  CASE WHEN page_id % 3 > 0 THEN 'CC BY 4.0' END, 'via shared media') END AS credit FROM m""",
)
def f17(spark, d):
    value = lambda c: F.struct(c.alias("value"))
    meta = F.to_json(
        F.struct(
            value(F.col("html")).alias("Artist"),
            value(F.when(F.col("page_id") % 3 > 0, F.lit("<b>CC BY</b> 4.0"))).alias("LicenseShortName"),
            value(F.when(F.col("page_id") % 4 == 0, "False").otherwise("true")).alias("AttributionRequired"),
        )
    )
    return (
        B.table(spark, d, "pages")
        .select("page_id", meta.alias("meta"))
        .select("page_id", T.credit_from_metadata(F.col("meta"), "via shared media").alias("credit"))
    )


@query(
    "f18_credit_lines",
    """WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN '' ELSE ' voice ' || o_orderstatus END AS synth,
  CASE WHEN o_custkey % 3 > 0 THEN 'Song ' || o_custkey END AS song, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE ' ' END AS display,
  CASE WHEN o_custkey % 5 > 0 THEN 'notice' END AS notice FROM orders),
 y AS (SELECT o_orderkey, nullif(trim(synth), '') AS synth, song, concat_ws(' — ', song, coalesce(nullif(trim(display), ''), notice)) AS orig FROM x)
SELECT o_orderkey, concat_ws(' / ', 'app', synth, CASE WHEN orig <> '' THEN CASE WHEN song IS NOT NULL THEN 'Original: ' ELSE '' END || orig END) AS credit FROM y""",
)
def f18(spark, d):
    k = F.col("o_custkey")
    return B.table(spark, d, "orders").select(
        "o_orderkey",
        T.credit_line(
            F.lit("app"),
            F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit(" voice "), F.col("o_orderstatus"))),
            F.when(k % 3 > 0, F.concat(F.lit("Song "), k.cast("string"))),
            F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(" "),
            F.when(k % 5 > 0, "notice"),
        ).alias("credit"),
    )


@query(
    "f19_url_utilities",
    r"""WITH p AS (SELECT page_id, url, html, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '\?([^#]*)', 1) AS q,
  regexp_extract(url, '(#.*)$', 1) AS frag, regexp_extract(url, '/([a-z]{2}/[^?]*)', 1) AS tail FROM pages)
SELECT page_id, base || '?' || array_to_string(list_concat(list_filter(string_split(q, '&'), lambda x: x <> '' AND split_part(x, '=', 1) <> 'page'),
  ['page=' || page_id]), '&') || frag AS busted,
  CASE WHEN tail <> '' THEN 'File:' || trim(url_decode(tail)) END AS title,
  (starts_with(ltrim(left(html, 1024)), '<svg') OR ((starts_with(ltrim(left(html, 1024)), '<?xml') OR starts_with(ltrim(left(html, 1024)), '<!--')
   OR starts_with(ltrim(left(html, 1024)), '<!DOCTYPE')) AND contains(left(html, 4096), '<svg'))) AS svg, left(sha1(url), 16) AS url_key FROM p""",
)
def f19(spark, d):
    return B.table(spark, d, "pages").select(
        "page_id",
        T.cache_busted(F.col("url"), page=F.col("page_id")).alias("busted"),
        T.page_title(F.regexp_replace("url", "/([a-z]{2}/)", "/wiki/File:$1"), "/wiki/File:").alias("title"),
        T.looks_like_svg(F.col("html")).alias("svg"),
        T.url_key(F.col("url")).alias("url_key"),
    )


@query(
    "f20_email_and_issuer",
    r"""SELECT c_custkey, lower(trim('  ' || c_name || '@Example.ORG ')) AS email,
  regexp_full_match('https://team' || c_custkey || CASE WHEN c_nationkey % 2 = 0 THEN '.auth' ELSE '_' END || '.access.example.com',
  'https://(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)*[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.access\.example\.com') AS valid FROM customer""",
)
def f20(spark, d):
    host = F.concat(
        F.lit("https://team"), F.col("c_custkey").cast("string"),
        F.when(F.col("c_nationkey") % 2 == 0, ".auth").otherwise("_"), F.lit(".access.example.com"),
    )
    return B.table(spark, d, "customer").select(
        "c_custkey",
        T.canonical_email(F.concat(F.lit("  "), F.col("c_name"), F.lit("@Example.ORG "))).alias("email"),
        T.valid_issuer(host, "access.example.com").alias("valid"),
    )


@query(
    "f21_keys",
    """SELECT doc_id, left(sha1(text || chr(31) || lang || chr(31) || source), 24) AS cache_key,
  left(sha256(text), 16) AS session_id, true AS valid, regexp_full_match(source, '[0-9a-f]{16}') AS source_valid FROM documents""",
)
def f21(spark, d):
    sid = F.left(F.sha2("text", 256), F.lit(16))
    return B.documents(spark, d).select(
        "doc_id", T.composite_key(F.col("text"), F.col("lang"), F.col("source")).alias("cache_key"),
        sid.alias("session_id"), T.valid_session_id(sid).alias("valid"),
        T.valid_session_id(F.col("source")).alias("source_valid"),
    )


@query("f22_singer_moras")
def f22(spark, d):
    k = F.col("kana")
    return B.kana_words(spark, d).select("word", F.array_join(K.singer_moras(k), "|").alias("moras"))


@query(
    "x4_sql_functions",
    _KW + f"""SELECT word, array_to_string(regexp_extract_all(kana, '.{_MORA}'), '|') AS moras,
  {_vowel('right(rtrim(kana, chr(12540)), 1)')} AS vowel, word IN ('na', 'nan', 'none', 'null') AS missing FROM kw""",
)
def x4(spark, d):
    register(spark)
    B.kana_words(spark, d).createOrReplaceTempView("vm_kana_words")
    return spark.sql(
        """SELECT word, array_join(vm_split_moras(kana), '|') AS moras, vm_vowel_of(kana) AS vowel,
           vm_is_missing(word) AS missing FROM vm_kana_words"""
    )


@query(
    "w32_dropout_flags",
    _KW[:-1] + f""", m AS (SELECT word, regexp_extract_all(kana, '.{_MORA}') AS ms FROM kw),
 x AS (SELECT word, i, ms[i] AS m, CASE WHEN i > 1 THEN ms[i - 1] END AS prev FROM m, unnest(range(1, len(ms) + 1)) AS u(i)),
 y AS (SELECT word, i, m, {_vowel('right(rtrim(prev, chr(12540)), 1)')} AS pv FROM x)
SELECT word, string_agg(CASE WHEN m IN ('ッ', 'ン', 'ー') OR (m = 'イ' AND pv = 'エ') OR (m = 'ウ' AND pv = 'オ') THEN '1' ELSE '0' END, '' ORDER BY i) AS flags
FROM y GROUP BY word""",
)
def w32(spark, d):
    flags = K.dropout_flags(K.split_moras(F.col("kana")))
    return B.kana_words(spark, d).select(
        "word", F.array_join(F.transform(flags, lambda f: f.cast("int").cast("string")), "").alias("flags")
    )
