"""Literal cases of single operators."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from versemill.functions import kana as K
from versemill.functions import music as MU
from versemill.functions import text as T
from versemill.operators import matching as M
from versemill.operators import metrics as A
from versemill.operators import placement as PL
from versemill.operators import soundalike as SA
from versemill.operators import timeline as TL
from versemill.operators import validation as V
from versemill.sources import documents as D
from versemill.sources import wordlists as W
from versemill.streaming import requests as R


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def notes(spark, rows):
    return spark.createDataFrame(
        [(1, i, int(s * 1000), int(e * 1000), p) for i, (s, e, p) in enumerate(rows)],
        "song_id int, note_id bigint, start_ms bigint, end_ms bigint, pitch bigint",
    )


def SLICE():
    return F.floor(F.col("start_ms") / 1000)


@pytest.mark.parametrize(
    "rows,ratio",
    [([(0, 1, 60), (1, 2, 62), (2, 3, 64)], 1.0), ([(0, 2, 60), (1, 3, 64), (2, 4, 67)], 0.0)],
)
def test_monophony(spark, rows, ratio):
    out = A.monophony(notes(spark, rows), ["song_id"], [], ["start_ms", "note_id"], SLICE(), "start_ms", "end_ms", "pitch", F.lit(False))
    assert out.first().ratio == ratio


def _sky(spark, rows):
    n = notes(spark, rows).withColumn("low", -F.col("pitch"))
    out = M.skyline(n, ["song_id"], ["start_ms", "low", "note_id"], SLICE(), "start_ms", "end_ms", "pitch")
    return [(r.start_ms / 1000, r.end_ms / 1000, r.pitch) for r in out.orderBy("start_ms").collect()]


def test_skyline(spark):
    assert _sky(spark, [(0, 1, 60), (0, 1, 64), (0, 1, 67), (0, 1, 72)]) == [(0, 1, 72)]
    assert _sky(spark, [(0, 2, 60), (1, 2, 67)]) == [(0, 1, 60), (1, 2, 67)]


def _modal(spark, values):
    f = spark.createDataFrame([(1, v) for v in values], "span int, midi double")
    return A.modal_pitch(f, ["span"], "midi").first().midi


def test_modal_pitch(spark):
    assert _modal(spark, [60.0, 60.2, 59.8]) == 60
    assert _modal(spark, [67.0, 67.1, 66.9, 67.2, 67.0, 66.0, 65.0]) == 67
    assert _modal(spark, [60.0] * 3 + [62.0] * 3) == 60
    assert _modal(spark, [67.0, 67.2, None]) == 67


def test_shift_plan(spark):
    def plan(pitches, movable=True):
        df = spark.createDataFrame([(1, p) for p in pitches], "song_id int, pitch int")
        return A.shift_plan(df, ["song_id"], "pitch", F.lit(54), F.lit(78), F.lit(movable)).first()

    for keys in ([60, 65, 70, 75], list(range(67, 90)), list(range(45, 60))):
        p = plan(keys)
        assert (p.key_shift, p.out_of_range) == (0, 0)
    p = plan(range(61, 84))
    assert (p.vocal_shift, p.key_shift, p.out_of_range) == (-5, -5, 0)
    assert plan(range(61, 84), movable=False).key_shift == 0


@pytest.mark.parametrize(
    "cues,total,want",
    [
        ([(2, 5), (20, 25)], 40, [("intro", 0, 2), ("interlude", 5, 20), ("outro", 25, 40)]),
        ([(0, 30)], 30, []),
        ([], 12, [("intro", 0, 12)]),
        ([], 0, []),
    ],
)
def test_idle_sections(spark, cues, total, want):
    c = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(cues)], "song_id int, id bigint, s bigint, e bigint")
    t = spark.createDataFrame([(1, total)], "song_id int, total bigint")
    out = TL.idle_sections(c, t, ["song_id"], ["s", "id"], F.floor(F.col("s") / 10), "s", "e")
    assert sorted((r.kind, r.start, r.end) for r in out.collect()) == sorted(want)


def _kana_pairs(spark, truth, est):
    df = lambda ks: spark.createDataFrame([(1, i, K_) for i, K_ in enumerate(ks)], "song int, note bigint, kana string")
    normal = lambda d: d.withColumn("kana", K.normalize_long_vowels(F.col("kana")))
    # Long vowels are normalised over the whole stream, so join the pieces first.
    def stream(ks):
        owners = [i for i, k in enumerate(ks) for _ in k]
        text = spark.createDataFrame([("".join(ks),)], "s string").select(K.normalize_long_vowels(F.col("s"))).first()[0]
        return spark.createDataFrame([(1, o, p, c) for p, (o, c) in enumerate(zip(owners, text))], "song int, note bigint, pos bigint, ch string")

    t, e = stream(truth), stream(est)
    m = M.match_characters(t, e, ["song"], 1)
    return {(r.note, r.est) for r in M.match_owners(m, e, ["song"], "note", "est").collect()}


def test_kana_match(spark):
    got = _kana_pairs(spark, ["ト", "ウ", "キョ", "ウ"], ["トー", "キョー"])
    assert {a for a, _ in got} == {0, 1, 2, 3}
    assert {a for a, _ in _kana_pairs(spark, ["ア", "カ", "イ"], ["ア", "サ", "イ"])} == {0, 2}


def test_plain_list(spark):
    lines = ["# comment", "ネコ", "東京,トウキョウ,トーキョー # capital", ""]
    df = spark.createDataFrame([("l", i, t) for i, t in enumerate(lines)], "list string, line_no bigint, text string")
    out = W.parse_plain(df, "list", "line_no", "text").orderBy("id", "variant").collect()
    assert [(r.id, r.surface, r.reading) for r in out] == [(1, "ネコ", ""), (2, "東京", "トウキョウ"), (2, "東京", "トーキョー")]


def test_header(spark):
    cells = spark.createDataFrame([(1, i, c) for i, c in enumerate(["id", "image", "team", "image_page", "team"])], "k int, pos int, name string")
    r = V.resolve_header(cells, "k", "pos", "name").first()
    assert (r.n_kept, r.n_duplicates, r.dropped) == (2, 1, "image,image_page")
    df = spark.createDataFrame([("a", "b")], ["﻿ Surface ", " 読み"])
    assert W.canonical_columns(df).columns == ["surface", "pronunciation"]


def test_wordlist_files(spark, tmp_path):
    (tmp_path / "cities.csv").write_text("id,word,読み,pref\n7,東京,トウキョウ,tokyo\n7,京,キョウ,\n", encoding="utf-8")
    rows = W.scan_wordlists(spark, str(tmp_path)).orderBy("surface").collect()
    assert {(r.list, r.id, r.surface) for r in rows} == {("cities", "7", "東京"), ("cities", "7", "京")}
    assert {r.extras["pref"] for r in rows} == {"tokyo", None}
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.txt").write_bytes("ネコ".encode("shift_jis"))
    (raw / "b.txt").write_bytes("﻿ネコ".encode())
    got = {r.charset: r.text for r in W.read_files(spark, str(raw)).collect()}
    assert got == {"shift_jis": "ネコ", "utf-8": "ネコ"}
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "pets.txt").write_text("ネコ\nイヌ,イヌ\n", encoding="utf-8")
    assert [(r.list, r.id, r.surface) for r in W.scan_plain(spark, str(plain)).orderBy("id").collect()] == [("pets", 1, "ネコ"), ("pets", 2, "イヌ")]


def test_records_across_blocks(spark, tmp_path):
    """Quoted cells over several lines and blocks, doubled quotes, files with headers of their own and of other order."""
    rows = [(f"i{k}", "x\ny " * (k % 7), 'say "{}", ok'.format(k)) for k in range(400)]
    text = lambda cells: ",".join('"' + c.replace('"', '""') + '"' for c in cells)
    first = "\n".join(["id,original,note", *map(text, rows)])
    second = "\n".join(["\ufeffnote , ID,Word,id", *(text((c, a, b, "no")) for a, b, c in rows)])
    (tmp_path / "one.csv").write_text(first, encoding="utf-8")
    (tmp_path / "two.csv").write_text(second, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert W.read_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 5
        got = W.scan_wordlists(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    blank = lambda x: x or None
    one = sorted((r.id, r.original, r.extras["note"]) for r in got if r.list == "one")
    two = sorted((r.id, r.surface, r.extras["note"]) for r in got if r.list == "two")
    want = sorted((a, b, c) for a, b, c in rows)
    assert [(a, b or "", c) for a, b, c in one] == want and [(a, b or "", c) for a, b, c in two] == want


def test_document_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "a", "b"), (2, 0, "u", "c")], "song_id bigint, line_id bigint, role string, text string")
    docs = D.nest_lines(lines, "song_id", "line_id", F.col("line_id"), F.col("role"), F.col("text"))
    docs = docs.withColumn("version", F.col("song_id").cast("int"))
    D.write_documents(docs, str(tmp_path / "docs"))
    good, bad = D.read_projects(spark, str(tmp_path / "docs"))
    assert sorted(map(tuple, D.project_lines(good).collect())) == [(1, 0, "u", "a"), (1, 1, "a", "b")]
    assert [r.song_id for r in bad.collect()] == [2]
    D.write_lines(lines.withColumn("line", F.col("text")), "line", str(tmp_path / "out"), "song_id")
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_generation_diff(spark):
    old = spark.createDataFrame([("a", "1", None), ("b", "1", None), ("c", "1", "t0"), ("d", "1", "t0")], "url string, sha256 string, orphaned_at string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("e", "1")], "url string, sha256 string")
    got = {r.url: (r.status, r.orphaned_at) for r in A.generation_diff(old, new, "t1").collect()}
    assert got == {"a": ("unchanged", None), "b": ("updated", None), "c": ("orphaned", "t0"), "d": ("unchanged", None), "e": ("new", None)}
    one_new = A.sync_counters(A.generation_diff(old.limit(0), new.limit(1), "t1")).first()
    assert (one_new.total, one_new.new, one_new.updated, one_new.unchanged, one_new.orphaned) == (1, 1, 0, 0, 0)


def test_kana_functions(spark):
    k = F.col("k")
    assert one(spark, K.split_moras(k), k="キャットー") == ["キャ", "ッ", "トー"]
    assert one(spark, K.split_fine_moras(k), k="キャー") == ["キャ", "ー"]
    assert one(spark, K.vowel_of(k), k="キョー") == "オ"
    assert one(spark, K.vowel_of(k), k="ン") is None
    assert one(spark, K.normalize_small_vowels(k), k="セェファ") == "セエファ"
    assert one(spark, K.open_long_vowel_runs(k), k="ヨーーー") == "ヨーオオ"
    assert one(spark, K.open_long_vowel_runs(k), k="ンーー") == "ンーー"
    assert one(spark, K.normalize_long_vowels(k), k="トウキョウ") == "トーキョー"
    assert one(spark, K.singer_moras(k), k="ハァビー") == ["ハ", "ア", "ビ", "イ"]
    assert one(spark, K.singer_moras(k), k="ファン") == ["ファ", "ン"]
    assert one(spark, K.note_attacks(k), k="タイ") == 1
    assert one(spark, K.held_note(k), k="オー") is True
    assert one(spark, K.ruby_readings(F.lit("燦花シノノ"), k), k="サンカシノノ") == ["サンカ"]
    assert one(spark, K.ruby_readings(F.lit("柳瀬 泰平"), k), k="ヤナセタイヘイ") is None
    assert one(spark, K.compressed_counts(F.lit("リンゴ"), k), k=["リー", "ゴ"]) == ["ン", ""]
    assert one(spark, K.strip_ruby(k), k="私の｜宇宙《そら》へ") == "私の宇宙へ"
    assert [tuple(x) for x in one(spark, K.ruby_segments(k), k="私の｜宇宙《そら》へ")] == [("私の", None), ("宇宙", "そら"), ("へ", None)]


def test_text_and_music_functions(spark):
    k = F.col("k")
    assert one(spark, MU.note_name_to_midi(k), k="Bb2") == 46
    assert one(spark, MU.note_name_to_midi(k), k="C4") == 60
    assert one(spark, MU.note_name_to_midi(k), k="H4") is None
    assert tuple(one(spark, MU.pitch_range(k), k="推奨音域：mid2A～hiE（A3～E5）")) == (57, 76)
    assert one(spark, MU.parse_progress(k), k="progress = 42 %") == 0.42
    assert one(spark, T.subtitle_color(k), k="#11223344") == "&HBB332211"
    assert one(spark, T.srt_time(k), k=3_661_007) == "01:01:01,007"
    assert one(spark, T.safe_name(k), k=' a/b: "c" ') == "a_b_c"
    assert one(spark, T.display_value(k), k="東-京 a-b") == "東・京 a-b"
    assert one(spark, T.is_missing(k), k=" N/A ") is True


def test_tick_cascade_and_frames(spark):
    n = notes(spark, [(0, 0.010, 60), (0.005, 0.006, 61), (0.012, 0.013, 62)])
    out = TL.cascade_spans(n, ["song_id"], ["start_ms", "note_id"], SLICE(), "start_ms", "end_ms", 1)
    assert [(r.start_ms, r.end_ms) for r in out.orderBy("note_id").collect()] == [(0, 10), (10, 11), (12, 13)]


def test_chunk_cuts(spark):
    rng = random.Random(3)
    segs, t = [], 0
    for i in range(200):
        n = rng.randrange(1, 60)
        segs.append((t, t + n, i % 2 == 1))
        t += n
    df = spark.createDataFrame([(1, a, z, r) for a, z, r in segs], "song int, start bigint, end bigint, is_rest boolean")
    got = sorted(r.cut for r in M.chunk_cuts(df, ["song"], "start", "end", "is_rest", 300, 20, 6).collect())
    rests = [(a, z) for a, z, r in segs if r and z - a >= 20]
    assert all(any(a <= c <= z for a, z in rests) for c in got)
    for begin, cut in zip([0, *got], [*got, t]):
        # A chunk above the limit holds no usable rest that could have ended it in time.
        if cut - begin > 300:
            assert not any(begin < a and z - 6 <= begin + 300 for a, z in rests)
        elif cut != t:
            # Cut as late as possible: no later usable rest fits the limit.
            assert not any(cut < z - 6 <= begin + 300 and a > cut for a, z in rests)


def test_placement_against_all_placements(spark):
    words = [("カキク", "カサキタク"), ("ットン", "ナナナナ"), ("アッカ", "アイッカキ"), ("コウ", "コオウ")]
    df = spark.createDataFrame(words, "m string, n string")
    df = df.select(K.split_moras(F.col("m")).alias("moras"), K.split_moras(F.col("n")).alias("notes"))
    cols = df.select(
        "moras", "notes", F.transform("moras", K.vowel_of).alias("mv"), F.transform("notes", K.vowel_of).alias("nv"),
        F.transform("moras", K.consonant_of).alias("mc"), F.transform("notes", K.consonant_of).alias("nc"),
        K.dropout_flags(F.col("moras")).alias("md"), K.dropout_flags(F.col("notes")).alias("nd"),
    ).collect()
    got = {tuple(r.moras): (r.score, r.positions) for r in PL.place_moras(df, "moras", "notes").collect()}
    for r in cols:
        options = []
        for at in itertools.combinations(range(len(r.notes)), len(r.moras)):
            if at[0] != 0 or any(m == "ッ" and i and at[i] != at[i - 1] + 1 for i, m in enumerate(r.moras)):
                continue
            score = sum(1000 * (r.mv[i] == r.nv[j]) + 10 * (r.mc[i] == r.nc[j]) + (not r.md[i]) + (not r.nd[j]) for i, j in enumerate(at))
            options.append((-score, tuple(reversed(at)), list(at)))
        want = min(options)
        assert got[tuple(r.moras)] == (-want[0], want[2])


def test_sound_alike_against_all_pairs(spark):
    rng = random.Random(9)
    make = lambda n: sorted({"".join(rng.choice("abeiorst") for _ in range(rng.randrange(2, 15))) for _ in range(n)})
    a, b = make(120), make(120)
    spans = spark.createDataFrame([(x,) for x in a], "word string")
    variants = spark.createDataFrame([(x,) for x in b], "variant string")
    cost = lambda x, y: sum(
        (16 if (p if p in "aeiouy" else "") != (q if q in "aeiouy" else "") else 0)
        + (4 if ("" if p in "aeiouy" else p) != ("" if q in "aeiouy" else q) else 0)
        for p, q in zip(x, y)
    )
    for bound in (12, 24, 50):
        got = {(r.word, r.variant, r.cost) for r in SA.sound_alike_pairs(spans, variants, bound).collect()}
        want = {(x, y, cost(x, y)) for x in a for y in b if len(x) == len(y) and cost(x, y) <= bound}
        assert got == want


@pytest.mark.parametrize("settle_every", [1, 256])
def test_alignment_against_all_assignments(spark, monkeypatch, settle_every):
    monkeypatch.setattr(M, "SETTLE_EVERY", settle_every)
    rng = random.Random(11)
    n, m = 5, 4
    sims = {(i, k): rng.choice([0.4, 0.5, 0.7, 0.9]) for i in range(n) for k in range(m) if rng.random() < 0.6}
    lines = spark.createDataFrame([(1, i) for i in range(n)], "song int, line bigint")
    similar = spark.createDataFrame([(1, i, k, s) for (i, k), s in sims.items()], "song int, line bigint, other bigint, s double")
    out = M.align_lines(lines, similar, "song", "line", "other", F.col("s"), 0.05).collect()
    got = [r.other for r in sorted(out, key=lambda r: r.line)]

    def total(choice):
        j, value = -1, 0.0
        for i, k in enumerate(choice):
            if k is None:
                continue
            if (i, k) not in sims or k < j:
                return None
            value += sims[i, k] - 0.05 * (max(0, k - j - 1) if j >= 0 else k)
            j = k
        return value

    best = max(v for c in itertools.product([None, *range(m)], repeat=n) if (v := total(c)) is not None)
    assert total(got) == pytest.approx(best)


def test_map_fit_finds_a_known_map(spark):
    rng = random.Random(2)
    starts = sorted(rng.randrange(0, 60_000) for _ in range(80))
    n = spark.createDataFrame([(1, i, s) for i, s in enumerate(starts)], "song int, note_id bigint, start bigint")
    m = spark.createDataFrame([(1, round(1.02 * s + 1500)) for s in starts], "song int, onset bigint")
    r = M.fit_global_map(m, n, "song", "onset", "start").first()
    assert r.scale == pytest.approx(1.02)
    assert abs(r.offset - 1500) <= 20


def test_limiter_never_exceeds_its_limit(spark):
    rng = random.Random(4)
    hits = [(rng.randrange(3), i, rng.randrange(0, 5000)) for i in range(300)]
    df = spark.createDataFrame(hits, "k int, id bigint, t bigint")
    out = R.limit_rate(df, ["k"], ["t", "id"], "t", F.floor(F.col("t") / 100), 3, 200).collect()
    for key in range(3):
        times = sorted(r.t for r in out if r.k == key and r.allowed)
        assert all(b - a >= 200 for a, b in zip(times, times[3:]))
    assert len(out) == 300


def test_pairing_is_one_by_one_rule(spark):
    rng = random.Random(8)
    ev = [(1, i, rng.randrange(0, 3000)) for i in range(60)]
    nt = [(1, i, rng.randrange(0, 3000), rng.randrange(40, 60)) for i in range(50)]
    e = spark.createDataFrame(ev, "song int, event bigint, at bigint")
    n = spark.createDataFrame(nt, "song int, note bigint, start bigint, pitch bigint")
    got = {(r.event, r.note) for r in M.pair_events(e, n, ["song"], "event", "at", "note", "start", "pitch", 60, 128).collect()}
    used, want = set(), set()
    for _, i, at in sorted(ev, key=lambda x: (x[2], x[1])):
        free = [(abs(s - at), -p, j) for _, j, s, p in nt if j not in used and abs(s - at) <= 60]
        if free:
            used.add(min(free)[2])
            want.add((i, min(free)[2]))
    assert got == want


def _match_by_table(moras, notes):
    """Least total cost over the full (moras x notes) table."""
    inf = 10**9
    cost = [[inf] * (len(notes) + 1) for _ in range(len(moras) + 1)]
    cost[0][0] = 0
    for i in range(len(moras) + 1):
        for j in range(len(notes) + 1):
            if j:
                cost[i][j] = min(cost[i][j], cost[i][j - 1] + 400)
            if i:
                t, p = moras[i - 1]
                cost[i][j] = min(cost[i][j], cost[i - 1][j] + 600)
                if j:
                    s, e, q = notes[j - 1]
                    tone = 100 * min(abs(p - q), abs(p - q - 12), abs(p - q + 12), 6)
                    cost[i][j] = min(
                        cost[i][j], cost[i - 1][j - 1] + abs(t - s) + tone,
                        cost[i - 1][j] + 150 + max(0, s - t) + max(0, t - e) + tone,
                    )
    return cost[-1][-1]


@pytest.mark.parametrize("settle_every", [1, 256])
def test_cost_matching_is_optimal(spark, monkeypatch, settle_every):
    monkeypatch.setattr(M, "SETTLE_EVERY", settle_every)
    rng = random.Random(6)
    for trial in range(4):
        ns, t = [], 0
        for _ in range(14):
            t += rng.randrange(100, 900)
            ns.append((t, t + rng.randrange(50, 400), rng.randrange(55, 70)))
        ms = sorted((s + rng.randrange(-300, 300), p + rng.choice([0, 0, 1, 12])) for s, e, p in ns if rng.random() < 0.8)
        moras = spark.createDataFrame([(1, i, o, p) for i, (o, p) in enumerate(ms)], "song int, mora bigint, onset bigint, mp bigint")
        nts = spark.createDataFrame([(1, j, s, e, p) for j, (s, e, p) in enumerate(ns)], "song int, note bigint, s bigint, e bigint, np bigint")
        out = M.match_moras(moras, nts, "song", "mora", "onset", "mp", "note", "s", "e", "np").orderBy("mora").collect()
        used = [r.note for r in out if r.note is not None]
        assert used == sorted(used)
        assert max(r.total for r in out if r.total is not None) == _match_by_table(ms, ns)
