"""Aggregations: scores, reports and estimates per song, list or job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy_report(rows: DataFrame, group: str, word: Sequence[str], ok: Column) -> DataFrame:
    """Notes and words that agree, per group and in total; a word needs all its notes."""
    good = F.coalesce(ok, F.lit(False))
    words = rows.groupBy(*word).agg(
        F.bool_and(good).alias("__ok"), F.count("*").alias("__n"), F.count_if(good).alias("__n_ok")
    )
    return words.rollup(group).agg(
        F.count("*").alias("n_words"), F.count_if("__ok").alias("n_words_ok"),
        F.sum("__n").alias("n_notes"), F.sum("__n_ok").alias("n_notes_ok"),
    )


def channel_hit_rate(ticks: DataFrame, notes: DataFrame, by, channel: str, at: str, start: str, tolerance, width, preferred: Sequence[str], enough: float = 0.9) -> DataFrame:
    """Share of lyric ticks with a note start within ``tolerance`` per channel, and the chosen channel.

    The first of the preferred channels, then the channels in order, with a
    share of ``enough`` wins; else the best share, the earlier one on a tie.
    """
    from versemill.plans.intervals import asof_join

    by = list(by)
    channels = notes.select(*by, channel).distinct()
    per_channel = ticks.join(channels, by)
    starts = notes.select(*by, channel, F.col(start).alias("__at")).distinct().withColumn("__s", F.col("__at"))
    t = per_channel.withColumn("__from", F.col(at) - tolerance)
    hit = asof_join(t, starts, [*by, channel], "__from", "__at", ["__s"], width, direction="forward")
    rate = hit.groupBy(*by, channel).agg(
        F.count("*").alias("n_ticks"), F.count_if(F.col("__s") <= F.col(at) + tolerance).alias("n_hits")
    )
    share = F.col("n_hits") / F.col("n_ticks")
    place = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(channel)), F.lit(0)),
        F.lit(len(preferred) + 1),
    )
    order = F.struct(
        (share < enough).alias("a"),
        F.when(share >= enough, F.lit(0.0)).otherwise(-share).alias("b"),
        place.alias("c"),
        F.col(channel).alias("d"),
    )
    return rate.groupBy(*by).agg(
        F.min_by(F.struct(channel, "n_hits", "n_ticks"), order).alias("r")
    ).select(*by, "r.*")


def monophony(notes: DataFrame, by, song: Sequence[str], order, slice_by: Column, start: str, end: str, pitch: str, skip: Column) -> DataFrame:
    """Share of notes that end before the next starts, and ratio squared times mean pitch."""
    from versemill.plans.ordered import lead, scan

    s = scan(notes.where(~skip), by, order, slice_by, __next=lead(start))
    agg = s.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(end) <= F.col("__next")).alias("n_clear"),
        F.sum(pitch).alias("__p"),
    )
    ratio = F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.col("n_clear") / (F.col("n") - 1))
    return agg.withColumn("ratio", ratio).withColumn(
        "score", F.col("ratio") * F.col("ratio") * F.col("__p") / F.col("n")
    ).drop("__p")


def contour_match(pairs: DataFrame, totals: DataFrame, by, diff: str, slice_by) -> DataFrame:
    """Matched share minus the median absolute deviation of pitch differences over 24.

    ``totals``: by, n_moras, n_notes; channels outside 0.25 .. 3 notes per mora
    are left out before the medians are taken.
    """
    from versemill.plans.ordered import materialize, median

    by = list(by)
    usable = totals.where(
        (F.col("n_notes") >= 0.25 * F.col("n_moras")) & (F.col("n_notes") <= 3 * F.col("n_moras"))
    )
    p = materialize(pairs.join(usable, by, "left_semi"))
    mid = median(p, by, diff, slice_by(diff)).select(*by, F.col("median").alias("__mid"), F.col("n").alias("n_pairs"))
    dev = p.join(mid, by).withColumn("__dev", F.abs(F.col(diff) - F.col("__mid")))
    mad = median(dev, by, "__dev", slice_by("__dev")).select(*by, F.col("median").alias("mad"))
    out = usable.join(mid, by).join(mad, by)
    return out.withColumn("score", F.col("n_pairs") / F.col("n_moras") - F.col("mad") / 24).select(
        *by, "n_pairs", F.col("__mid").alias("median_diff"), "mad", "score"
    )


def transposition(pairs: DataFrame, by, diff: str, slice_by: Column) -> DataFrame:
    """Median pitch difference, rounded half to even."""
    from versemill.plans.ordered import median

    return median(pairs, by, diff, slice_by).select(*by, F.bround("median").cast("bigint").alias("transpose"))


def modal_pitch(frames: DataFrame, by, pitch: str, low: int = 36, high: int = 96) -> DataFrame:
    """Most frequent whole pitch per key; on a tie the one nearest the median, then the lower.

    Works on the pitch histogram of each key: at most one row per semitone.
    """
    from versemill.plans.ordered import materialize, median

    by, frames = list(by), materialize(frames)
    semis = frames.where(F.col(pitch).isNotNull()).withColumn("__semi", F.bround(pitch).cast("bigint"))
    hist = semis.groupBy(*by, "__semi").agg(F.count("*").alias("__c"))
    mid = median(semis, by, pitch, F.floor(F.col(pitch) / 1024)).select(*by, "median", "n")
    order = F.struct((-F.col("__c")).alias("a"), F.abs(F.col("__semi") - F.col("median")).alias("b"), F.col("__semi").alias("c"))
    best = hist.join(mid, by).groupBy(*by, "n").agg(F.min_by("__semi", order).alias("__s"))
    return best.select(*by, "n", F.greatest(F.lit(low), F.least(F.lit(high), F.col("__s"))).alias("midi"))


# Octave shifts tried, largest key shift in semitones.
OCTAVE_SHIFTS = (0, 12, -12, 24, -24)
MAX_KEY_SHIFT = 6


def shift_plan(notes: DataFrame, by, pitch: str, low: Column, high: Column, movable: Column) -> DataFrame:
    """Octave shift that leaves least notes out of range; else, where the backing can move, a key shift too.

    The pitch histogram of a song (at most 128 pitches) lies in one row and meets the
    fixed grid of shifts there.
    """
    by = list(by)
    hist = notes.groupBy(*by, pitch).agg(
        F.count("*").alias("c"), F.max(low).alias("lo"), F.max(high).alias("hi"), F.bool_or(movable).alias("__mv")
    )
    songs = hist.groupBy(*by).agg(F.collect_list(F.struct(F.col(pitch).alias("p"), "c", "lo", "hi")).alias("h"), F.bool_or("__mv").alias("mv"))
    grid = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.lit(k + o).alias("v"))
            for k in range(-MAX_KEY_SHIFT, MAX_KEY_SHIFT + 1)
            for o in OCTAVE_SHIFTS
        ]
    )

    def out_of_range(v: Column) -> Column:
        outside = lambda x: (x["p"] + v < x["lo"]) | (x["p"] + v > x["hi"])
        return F.aggregate("h", F.lit(0).cast("bigint"), lambda n, x: n + F.when(outside(x), x["c"]).otherwise(0))

    shifts = F.transform(grid, lambda g: F.struct(
        out_of_range(g["v"]).alias("out"), F.abs(g["k"]).alias("a"), F.abs(g["v"]).alias("b"), g["v"].alias("v"), g["k"].alias("k")
    ))
    rows = songs.select(*by, "mv", F.explode(F.array(shifts)).alias("g"))
    still = F.transform(F.filter("g", lambda x: x["k"] == 0), lambda x: F.struct(x["out"].alias("out"), x["b"].alias("a"), (-x["v"]).alias("b")))
    best = rows.select(*by, "mv", F.array_min(still).alias("p"), F.array_min("g").alias("q"))
    use_key = F.col("mv") & (F.col("p.out") > 0)
    return best.select(
        *by,
        F.when(use_key, F.col("q.v")).otherwise(-F.col("p.b")).cast("bigint").alias("vocal_shift"),
        F.when(use_key, F.col("q.k")).otherwise(0).cast("bigint").alias("key_shift"),
        F.when(use_key, F.col("q.out")).otherwise(F.col("p.out")).alias("out_of_range"),
    )


def evaluation_report(pairs: DataFrame, totals: DataFrame, by, pitch_diff: str, time_diff: str, pitch_slice, time_slice) -> DataFrame:
    """Coverage, transposition, pitch accuracy, time offset, onset error and its 90th percentile.

    Order statistics come from histograms (see ``exact_quantiles``).
    """
    from versemill.plans.ordered import exact_quantiles, materialize, median

    by, pairs = list(by), materialize(pairs)
    tr = transposition(pairs, by, pitch_diff, pitch_slice(pitch_diff))
    off = median(pairs, by, time_diff, time_slice(time_diff)).select(*by, F.col("median").alias("time_offset"))
    r = pairs.join(tr, by).join(off, by)
    r = materialize(r).withColumns(
        {"__r": F.col(pitch_diff) - F.col("transpose"), "__t": F.abs(F.col(time_diff) - F.col("time_offset"))}
    )
    acc = r.groupBy(*by, "transpose", "time_offset").agg(
        F.count("*").alias("n_matched"),
        F.count_if(F.col("__r") == 0).alias("n_exact"),
        F.count_if(F.abs("__r") <= 1).alias("n_within1"),
        F.sum("__t").alias("__sum"),
    )
    p90 = exact_quantiles(r, by, "__t", time_slice("__t"), onset_p90=F.floor(F.lit(0.9) * (F.col("n") - 1)))
    n = F.col("n_matched")
    return (
        totals.join(acc, by).join(p90.select(*by, "onset_p90"), by)
        .select(
            *by, "n_matched", (n / F.col("n_truth")).alias("coverage"), "transpose",
            (F.col("n_exact") / n).alias("pitch_acc"), (F.col("n_within1") / n).alias("pitch_acc1"),
            "time_offset", (F.col("__sum") / n).alias("onset_mae"), "onset_p90",
        )
    )


def first_seen(df: DataFrame, by, value: Column, order: Sequence[str], keep: Column) -> DataFrame:
    """Distinct non-empty values per key in order of first appearance."""
    v = F.trim(value)
    named = df.withColumn("value", v).where(keep & (F.col("value") != ""))
    return named.groupBy(*by, "value").agg(F.min(F.struct(*order)).alias("first_at")).select(*by, "value", "first_at.*")


def merge_first_known(df: DataFrame, key: str, order: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """First row per key; blank fields filled from later rows."""
    position = F.struct(*order)
    filled = [F.min_by(F.col(c), F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", position)).alias(c) for c in fill]
    return df.groupBy(key).agg(*filled, F.count("*").alias("n_rows"))


def manifest_health(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per generation and whether it may be promoted."""
    active = F.col("orphaned_at").isNull()
    out = entries.groupBy(*by).agg(
        F.count_if(active).alias("n_active"),
        F.count_if(active & (F.col("status") == "ok")).alias("n_available"),
        F.count_if(active & (F.col("status") == "failed")).alias("n_failed"),
        F.count_if(active & F.col("credit").isNull()).alias("n_credit_unknown"),
        F.count_if(active & (F.col("status") == "ok") & F.col("local_path").isNull()).alias("n_missing_files"),
    )
    clean = (F.col("n_failed") == 0) & (F.col("n_credit_unknown") == 0) & (F.col("n_missing_files") == 0)
    return out.withColumn("promotable", clean & (F.col("n_available") == F.col("n_active")))


def generation_diff(old: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Status of every url over two manifest generations.

    Orphans keep the time they were first orphaned; a returning url clears it.
    """
    o = old.select("url", F.col("sha256").alias("__osha"), F.col("orphaned_at").alias("__oorph"), F.lit(True).alias("__old"))
    n = new.select("url", "sha256", F.lit(True).alias("__new"))
    j = o.join(n, "url", "full")
    status = (
        F.when(F.col("__new").isNull(), "orphaned")
        .when(F.col("__old").isNull(), "new")
        .when(F.col("sha256") != F.col("__osha"), "updated")
        .otherwise("unchanged")
    )
    return j.select(
        "url", status.alias("status"), F.coalesce("sha256", "__osha").alias("sha256"),
        F.when(F.col("__new").isNull(), F.coalesce("__oorph", F.lit(now))).alias("orphaned_at"),
    )


def sync_counters(diff: DataFrame) -> DataFrame:
    s = F.col("status")
    return diff.agg(
        F.count_if(s != "orphaned").alias("total"), *[F.count_if(s == x).alias(x) for x in ("new", "updated", "unchanged", "orphaned")]
    )


def variant_volume(words: DataFrame, by, units: Column) -> DataFrame:
    return words.groupBy(*by, units.alias("n_units")).agg(F.count("*").alias("n_variants"))


def line_unit_bound(units: DataFrame, by, line: Sequence[str], max_units: Column) -> DataFrame:
    """Bound on the units of a match: the longest line's sum of unit maxima, plus two."""
    return units.groupBy(*by, *line).agg(F.sum(max_units).alias("__s")).groupBy(*by).agg((F.max("__s") + 2).alias("max_units"))


def peak_envelope(samples: DataFrame, by, index: str, value: str, hop: int) -> DataFrame:
    """Peak of each block of ``hop`` samples, scaled by the key's peak, 3 decimals."""
    by = list(by)
    blocks = samples.groupBy(*by, F.floor(F.col(index) / hop).alias("block")).agg(F.max(F.abs(value)).alias("__p"))
    top = blocks.groupBy(*by).agg(F.max("__p").alias("__top"))
    scaled = F.when(F.col("__top") > 0, F.col("__p") / F.col("__top")).otherwise(F.lit(0.0))
    return blocks.join(top, by).select(*by, "block", F.round(scaled, 3).alias("peak"))


def roll_up_lines(notes: DataFrame, by, order: Sequence[str], fields: Sequence[str], id_: str, part: Column) -> DataFrame:
    """Ordered concatenation of texts and list of ids per line.

    A line has a handful of notes; ``part`` (a block of the order) bounds what
    one row gathers, so an endless line comes out as several parts.
    """
    by = [*by, "part"]
    notes = notes.withColumn("part", part)
    row = F.struct(F.struct(*order).alias("o"), F.struct(id_, *fields).alias("v"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"])
    out = notes.groupBy(*by).agg(rows.alias("__rows"))
    return out.select(
        *by, F.transform("__rows", lambda x: x[id_]).alias("note_ids"),
        *[F.array_join(F.transform("__rows", lambda x: x[f]), "").alias(f) for f in fields],
    )


def stage_durations(stages: DataFrame, job: str, stage: str, start: str, end: str) -> DataFrame:
    """Seconds per stage, per job and overall in one pass."""
    return stages.groupingSets([[F.col(stage)], [F.col(job)], []], F.col(stage), F.col(job)).agg(
        F.sum(F.col(end) - F.col(start)).alias("seconds"), F.count("*").alias("n")
    )


def headline_words(words: DataFrame, by, order: Sequence[str], word: str, filler: str, k: int = 4) -> DataFrame:
    """First ``k`` non-empty words per song; empty when every word is filler."""
    from versemill.plans.ordered import top_rows

    real = words.where(F.trim(F.coalesce(F.col(word), F.lit(""))) != "")
    first = top_rows(real, by, [F.col(c) for c in order], k)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", word))), lambda x: x[word]), " ")
    shown = first.groupBy(*by).agg(text.alias("__t"))
    any_real = words.groupBy(*by).agg(F.bool_or(~F.col(filler)).alias("__any"))
    return any_real.join(shown, list(by), "left").select(
        *by, F.when(F.col("__any"), F.coalesce("__t", F.lit(""))).otherwise("").alias("headline")
    )


def planned_length(notes: DataFrame, audio: DataFrame, by, end: str, tail, page_len, min_tail) -> DataFrame:
    """Sung end plus tail, at least the audio; stretched for end pages when too little is left."""
    sung = notes.groupBy(*by).agg(F.max(end).alias("sung_end"))
    j = audio.join(sung, list(by), "left")
    total = F.greatest(F.coalesce(F.col("sung_end") + tail, F.lit(0)), F.coalesce(F.col("audio_len"), F.lit(0)))
    j = j.withColumn("total", total)
    left = F.col("total") - F.coalesce(F.col("sung_end"), F.lit(0))
    extended = F.when((F.col("pages") > 0) & (left < min_tail), F.col("total") + (F.col("pages") + 1) * page_len).otherwise(F.col("total"))
    return j.withColumn("planned", extended)


def token_spans_to_moras(moras: DataFrame, tokens: DataFrame, by, mora: str, pos: str) -> DataFrame:
    """Start of the first token, end of the last, score of the first; nulls where nothing aligned."""
    t = tokens.groupBy(*by, mora).agg(
        F.min_by("start", F.struct(pos)).alias("start"), F.max_by("end", F.struct(pos)).alias("end"),
        F.min_by("score", F.struct(pos)).alias("score"),
    )
    return moras.join(t, [*by, mora], "left")


def score_digest(lines: DataFrame, by, order: Sequence[str], text: str, sung: Column, edge: int = 20) -> DataFrame:
    """Joined lyrics, shortened in the middle beyond twice ``edge`` characters, and the sung count.

    Only the first and last rows that can show are kept per song, so a long
    song is not gathered.
    """
    n = F.length(text)
    from versemill.plans.ordered import top_rows

    # Rows of empty text do not show; any other row holds at least one character.
    shown = lines.where(n > 0)
    head = top_rows(shown, by, [F.col(c) for c in order], 2 * edge + 1)
    tail = top_rows(shown, by, [F.col(c).desc() for c in order], edge)
    join = lambda df, asc: df.groupBy(*by).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", F.col(text).alias("t"))), asc=asc), lambda x: x["t"]
            ),
            "",
        ).alias("__h" if asc else "__e")
    )
    total = lines.groupBy(*by).agg(F.sum(n).alias("n_chars"), F.count_if(sung).alias("n_sung"))
    j = total.join(join(head, True), list(by), "left").join(join(tail, False), list(by), "left")
    h, e = F.coalesce("__h", F.lit("")), F.coalesce("__e", F.lit(""))
    cut = F.concat(F.left(h, F.lit(edge)), F.lit("…"), F.right(e, F.lit(edge)))
    return j.select(*by, "n_chars", "n_sung", F.when(F.col("n_chars") > 2 * edge, cut).otherwise(h).alias("digest"))


def throughput_factor(runs: DataFrame, by, order: Sequence[str], wall: Column, score: Column) -> DataFrame:
    """Smoothed ratio after each run: the first seeds it, then 0.7 old + 0.3 new, 4 decimals.

    Rounding makes each step depend on the one before, so runs are streamed in
    order with one number of state per key.
    """
    from versemill.plans.fold import fold_sorted

    ok = runs.where((wall > 0) & (score > 0)).withColumn("x", wall / score)

    def smooth(state, row):
        new = round(row["x"], 4) if state is None else round(0.7 * state + 0.3 * row["x"], 4)
        return new, (new,)

    return fold_sorted(ok.select(*by, *order, "x"), by, order, smooth, "factor double")
