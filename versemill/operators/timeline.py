"""Segmentation, gap repair and timelines of timed rows.

All functions take ``by`` (song key), a total ``order`` and a slice of the
ordering column, and stay parallel inside one song (see ``plans.ordered``).
Times are numbers in one unit; thresholds are in the same unit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.plans.ordered import (
    islands, lag, last_known, lead, materialize, next_known, row_number, running_max, running_sum, scan,
)


def line_numbers(df, by, order, slice_by, breaks: Column, name: str = "line_no") -> DataFrame:
    """Number lines; a row with ``breaks`` starts a new one."""
    return islands(df, by, order, slice_by, breaks, name)


def parse_lyric_events(df, by, order, slice_by, raw: str = "raw") -> DataFrame:
    """Surface, reading and line break of lyric events.

    ``/`` and ``<`` mark a break before the next sung event; ``[`` opens a
    reading and ``]`` closes it, possibly several events later.
    """
    text = F.regexp_replace(raw, "^[/<]+", "")
    marks = F.col(raw).rlike("^[/<]")
    opens = text.contains("[") & ~text.contains("]")
    state = F.when(opens, "open").when(text.contains("]"), "closed")
    base = df.withColumns({"__t": text, "__sung": text != ""})
    step = scan(
        base, by, order, slice_by,
        __breaks=running_sum(marks.cast("bigint")), __state=last_known(state, inclusive=False),
    )
    step = scan(
        step, by, order, slice_by, cut=True,
        __before=last_known(F.when(F.col("__sung"), F.col("__breaks")), inclusive=False),
    )
    inside = F.coalesce(F.col("__state") == "open", F.lit(False))
    t = F.col("__t")
    has_open = t.contains("[")
    surface = F.when(inside, "").when(has_open, F.substring_index(t, "[", 1)).otherwise(t)
    reading = F.when(inside, F.substring_index(t, "]", 1)).when(
        has_open, F.substring_index(F.regexp_extract(t, r"(?s)\[(.*)$", 1), "]", 1)
    ).otherwise(t)
    return (
        step.withColumns(
            {
                "surface": surface,
                "kana": reading,
                "line_break": F.col("__breaks") > F.coalesce(F.col("__before"), F.lit(0)),
            }
        )
        .where("__sung")
        .drop("__t", "__sung", "__breaks", "__state", "__before")
    )


def repair_word_breaks(df, by, order, slice_by, raw: str = "raw") -> DataFrame:
    """Undo a line break inside a word.

    Shape: ``/x`` then ``/x[y]`` then ``y``, not at the head of the song. The
    first two rows lose their break; the second becomes a long mark.
    """
    s = scan(
        df, by, order, slice_by, cut=True,
        __p=lag(F.lit(True)),
        __r1=lead(raw), __s1=lead("surface"), __k1=lead("kana"), __b1=lead("line_break"),
    )
    s = scan(s, by, order, slice_by, cut=True, __r2=lead("__r1"))
    broken = (
        F.col("__p")
        & F.col("line_break")
        & F.col("__b1")
        & (F.col("surface") != "")
        & (F.col("surface") == F.col("__s1"))
        & (F.col(raw) == F.concat(F.lit("/"), F.col("surface")))
        & (F.col("__r1") == F.concat(F.lit("/"), "surface", F.lit("["), "__k1", F.lit("]")))
        & (F.col("__r2") == F.col("__k1"))
        & (F.col("surface") == F.col("kana"))
        & (F.col("__k1") != "")
        & (F.col("__k1") != F.col("kana"))
    )
    s = s.withColumn("__hit", F.coalesce(broken, F.lit(False)))
    s = scan(s, by, order, slice_by, cut=True, __after=lag("__hit"))
    after = F.coalesce(F.col("__after"), F.lit(False))
    return s.withColumns(
        {
            "line_break": F.col("line_break") & ~F.col("__hit") & ~after,
            "surface": F.when(after, "").otherwise(F.col("surface")),
            "kana": F.when(after, "ー").otherwise(F.col("kana")),
            "repaired": F.col("__hit"),
        }
    ).select(*df.columns, "repaired")


def group_phrases(df, by, order, slice_by, start, end, gap, max_notes: int = 12) -> DataFrame:
    """A phrase ends at a rest of ``gap`` or after ``max_notes`` notes."""
    s = scan(df, by, order, slice_by, __prev=lag(end))
    new = F.coalesce(F.col(start) - F.col("__prev") >= gap, F.lit(True))
    s = islands(s, by, order, slice_by, new, "phrase")
    s = scan(s, [*by, "phrase"], order, slice_by, cut=True, __n=row_number())
    part = F.floor((F.col("__n") - 1) / max_notes)
    return s.withColumn("part", part).drop("__prev", "__n")


def close_small_gaps(df, by, order, slice_by, start, end, max_gap) -> DataFrame:
    """A gap of at most ``max_gap`` before the next row is sung through."""
    s = scan(df, by, order, slice_by, __next=lead(start))
    gap = F.col("__next") - F.col(end)
    return s.withColumn(end, F.when((gap > 0) & (gap <= max_gap), F.col("__next")).otherwise(F.col(end))).drop("__next")


def insert_melisma(df, by, order, slice_by, start, end, matched: Column, max_gap) -> DataFrame:
    """Unmatched notes that follow the previous one closely carry it on; others are dropped.

    Rows are a single voice (no overlaps), so a chain of unmatched notes lasts
    until the first gap above ``max_gap`` since the latest matched note.
    """
    s = scan(df.withColumn("__m", matched), by, order, slice_by, cut=True, __prev=lag(end), __n=row_number())
    far = F.coalesce(F.col(start) - F.col("__prev") > max_gap, F.lit(True))
    s = scan(
        s, by, order, slice_by, cut=True,
        __last_m=running_max(F.when(F.col("__m"), F.col("__n"))),
        __last_far=running_max(F.when(~F.col("__m") & far, F.col("__n"))),
    )
    joined = F.col("__last_m").isNotNull() & (
        F.col("__last_far").isNull() | (F.col("__last_far") < F.col("__last_m"))
    )
    return (
        s.withColumn("is_melisma", ~F.col("__m"))
        .where(F.col("__m") | joined)
        .select(*df.columns, "is_melisma")
    )


def monotone_spans(df, by, order, slice_by, start, end, min_length) -> DataFrame:
    """Spans in order: starts never go back, a minimum length, no end beyond the next start."""
    s = scan(df, by, order, slice_by, __s=running_max(start))
    s = scan(s.withColumn("__e", F.greatest(F.col(end), F.col("__s") + min_length)), by, order, slice_by, cut=True, __next=lead("__s"))
    clipped = F.least(F.col("__e"), F.coalesce(F.col("__next"), F.col("__e")))
    return s.withColumns({start: F.col("__s"), end: clipped}).select(*df.columns)


def cascade_spans(df, by, order, slice_by, start, end, min_length, clip_to_next: bool = False) -> DataFrame:
    """Push overlapping spans forward so that each starts at or after the end before it.

    ``end[i] = max(end, start + min, end[i-1] + min)`` unrolls to a running
    maximum of ``max(end, start + min) - i*min``, so no row-by-row fold is
    needed. With ``clip_to_next`` an end is first cut to the raw next start,
    and the last span keeps its end.
    """
    specs = {"__n": row_number()}
    if clip_to_next:
        specs["__next"] = lead(start)
    s = scan(df, by, order, slice_by, **specs)
    raw_end = F.least(F.col(end), F.coalesce(F.col("__next"), F.col(end))) if clip_to_next else F.col(end)
    level = F.greatest(raw_end, F.col(start) + min_length) - F.col("__n") * min_length
    s = scan(s, by, order, slice_by, cut=True, __top=running_max(level), __top_before=running_max(level, inclusive=False))
    before = F.col("__top_before") + (F.col("__n") - 1) * min_length
    new_start = F.greatest(F.col(start), F.coalesce(before, F.col(start)))
    new_end = F.col("__top") + F.col("__n") * min_length
    if clip_to_next:
        new_end = F.when(F.col("__next").isNull(), F.col(end)).otherwise(new_end)
    return s.withColumns({start: new_start, end: new_end}).select(*df.columns)


def interpolate_spans(df, by, order, slice_by, start, end) -> DataFrame:
    """Missing spans run from the previous known end (else 0) to the next known start."""
    known = F.col(start).isNotNull()
    s = scan(
        df, by, order, slice_by,
        __pe=last_known(F.when(known, F.col(end)), inclusive=False),
        __ns=next_known(F.when(known, F.col(start)), inclusive=False),
    )
    lo = F.coalesce(F.col("__pe"), F.lit(0))
    hi = F.greatest(F.coalesce(F.col("__ns"), lo), lo)
    return s.withColumns(
        {start: F.coalesce(F.col(start), lo), end: F.when(known, F.col(end)).otherwise(hi)}
    ).drop("__pe", "__ns")


def fill_pitch(df, by, order, slice_by, pitch, default=60, low=36, high=96) -> DataFrame:
    """Unknown pitch from the row before, else the row after, else ``default``; kept in range."""
    s = scan(df, by, order, slice_by, __p=last_known(pitch), __n=next_known(pitch))
    value = F.coalesce(F.col("__p"), F.col("__n"), F.lit(default))
    return s.withColumn(pitch, F.greatest(F.lit(low), F.least(F.lit(high), value))).drop("__p", "__n")


def voiced_end(df, by, order, slice_by, at, voiced: Column, limit: Column, run: int = 3) -> DataFrame:
    """Start of the first run of ``run`` unvoiced frames per key, else the limit."""
    s = scan(df.withColumn("__u", ~voiced), by, order, slice_by, __was=lag("__u"))
    s = islands(s, by, order, slice_by, ~F.col("__u").eqNullSafe(F.col("__was")), "__run")
    runs = s.groupBy(*by, "__run").agg(
        F.min(at).alias("__from"), F.count("*").alias("__len"), F.first("__u").alias("__u"),
        F.max(limit).alias("__limit"),
    )
    cut = F.when(F.col("__u") & (F.col("__len") >= run), F.col("__from"))
    return runs.groupBy(*by).agg(F.coalesce(F.min(cut), F.max("__limit")).alias("voiced_end"))


def display_hold(df, by, order, slice_by, start, end, hold, hold_next: bool = False) -> DataFrame:
    """How long a row stays on screen: to the next start, at most ``hold`` past its end."""
    s = scan(df, by, order, slice_by, __next=lead(start))
    nxt, e = F.col("__next"), F.col(end)
    if hold_next:
        shown = F.greatest(e, F.coalesce(nxt, e))
    else:
        shown = F.when(nxt.isNull(), e + hold).otherwise(F.least(F.greatest(e, nxt), e + hold))
    return s.withColumn("show_end", shown).drop("__next")


def lead_cues(df, by, order, slice_by, start, show_end, lead_time) -> DataFrame:
    """Shift cues earlier (not below 0) and cut each at the start of the next one."""
    moved_start = F.greatest(F.lit(0), F.col(start) - lead_time)
    moved = df.withColumns({start: moved_start, show_end: F.greatest(moved_start, F.col(show_end) - lead_time)})
    s = scan(moved, by, order, slice_by, cut=True, __next=lead(start))
    return s.withColumn(show_end, F.least(F.col(show_end), F.coalesce(F.col("__next"), F.col(show_end)))).drop("__next")


def prepend_title(cues: DataFrame, titles: DataFrame, by, start, end, kind: str) -> DataFrame:
    """Put a title cue [0, title_end) in front; covered cues go, partly covered ones start later."""
    t = titles.select(*by, "title_end")
    kept = cues.join(t, list(by), "left").where(
        F.col("title_end").isNull() | (F.col("title_end") <= 0) | (F.col(end) > F.col("title_end"))
    )
    kept = kept.withColumn(start, F.greatest(F.col(start), F.coalesce(F.col("title_end"), F.col(start))))
    title = titles.where(F.col("title_end") > 0).select(
        *by, F.lit("title").alias(kind), F.lit(0).cast("bigint").alias(start), F.col("title_end").alias(end)
    )
    return kept.select(*by, kind, start, end).unionByName(title)


def idle_sections(cues: DataFrame, totals: DataFrame, by, order, slice_by, start, end) -> DataFrame:
    """Uncovered time per key as intro, interlude and outro. ``totals`` has ``total`` per key."""
    by, cues = list(by), materialize(cues)
    s = scan(cues, by, order, slice_by, __cover=running_max(end, inclusive=False))
    between = s.where(F.col("__cover").isNotNull() & (F.col(start) > F.col("__cover"))).select(
        *by, F.lit("interlude").alias("kind"), F.col("__cover").alias("start"), F.col(start).alias("end")
    )
    edge = cues.groupBy(*by).agg(F.min(start).alias("__first"), F.max(end).alias("__last"))
    t = totals.where(F.col("total") > 0).join(edge, by, "left")
    intro = t.where(F.coalesce(F.col("__first") > 0, F.lit(True))).select(
        *by, F.lit("intro").alias("kind"), F.lit(0).cast("bigint").alias("start"),
        F.coalesce("__first", "total").alias("end"),
    )
    outro = t.where(F.col("total") > F.col("__last")).select(
        *by, F.lit("outro").alias("kind"), F.col("__last").alias("start"), F.col("total").alias("end")
    )
    known = totals.where(F.col("total") > 0).select(*by)
    return between.join(known, by, "left_semi").unionByName(intro).unionByName(outro)


def fill_timeline(cues: DataFrame, totals: DataFrame, by, order, slice_by, start, end) -> DataFrame:
    """Cues (not overlapping) and filler rows that together tile [0, total]."""
    by, cues = list(by), materialize(cues)
    filler = idle_sections(cues, totals, by, order, slice_by, start, end).select(
        *by, F.lit("fill").alias("kind"), "start", "end"
    )
    shown = cues.where(F.col(end) > F.col(start)).select(
        *by, F.lit("cue").alias("kind"), F.col(start).alias("start"), F.col(end).alias("end")
    )
    return shown.unionByName(filler)


def consecutive_groups(df, by, order, slice_by, key: str, name: str = "group_no") -> DataFrame:
    """Adjacent rows with an equal key share a number; a null key never joins."""
    s = scan(df, by, order, slice_by, __prev=lag(key))
    new = ~F.coalesce(F.col(key) == F.col("__prev"), F.lit(False))
    return islands(s, by, order, slice_by, new, name).drop("__prev")


def resolve_setting(df: DataFrame, candidates: Sequence[str], allowed: Sequence[str], default: Column, name: str) -> DataFrame:
    """First candidate column holding an allowed value, else the default."""
    valid = [F.when(F.col(c).isin(*allowed), F.col(c)) for c in candidates]
    return df.withColumn(name, F.coalesce(*valid, default))


def pair_on_off(df, by, order, slice_by, is_on: Column, at: str) -> DataFrame:
    """On rows whose next row of the key is an off row, with the off time as end."""
    s = scan(df.withColumn("__on", is_on), by, order, slice_by, __next_on=lead("__on"), end_at=lead(at))
    return s.where(F.col("__on") & (F.col("__next_on") == F.lit(False))).drop("__on", "__next_on")


def fill_rests(df, by, order, slice_by, start, end, min_rest) -> DataFrame:
    """Notes clipped to the next start; gaps below ``min_rest`` absorbed, others become rest rows."""
    by = list(by)
    s = scan(df, by, order, slice_by, __next=lead(start), __prev=lag(F.lit(True)))
    nxt, e = F.col("__next"), F.col(end)
    stop = F.when(nxt.isNotNull() & ((nxt < e) | (nxt - e < min_rest)), nxt).otherwise(e)
    s = s.withColumn("__stop", stop)
    notes = s.select(*by, *order, F.lit("note").alias("kind"), F.col(start).alias("start"), F.col("__stop").alias("end"))
    rests = s.where(nxt > F.col("__stop")).select(
        *by, *order, F.lit("rest").alias("kind"), F.col("__stop").alias("start"), nxt.alias("end")
    )
    head = s.where(F.col("__prev").isNull() & (F.col(start) > 0)).select(
        *by, *order, F.lit("rest").alias("kind"), F.lit(0).cast("bigint").alias("start"), F.col(start).alias("end")
    )
    dedup = lambda d: d.select(*dict.fromkeys(d.columns))
    return dedup(notes).unionByName(dedup(rests)).unionByName(dedup(head))


def quantise_frames(df, by, order, slice_by, start_frame: Column, end_frame: Column) -> DataFrame:
    """Whole frames without overlap; vanished notes dropped, one-frame gaps absorbed.

    Adds ``start_f``, ``end_f`` and ``rest_before`` (frames of rest in front).
    """
    by = list(by)
    raw = df.withColumns({"__sf": start_frame, "__ef": end_frame}).where(F.col("__ef") > F.col("__sf"))
    s = scan(raw, by, order, slice_by, __cursor=running_max("__ef", inclusive=False))
    cursor = F.coalesce(F.col("__cursor"), F.lit(0).cast("bigint"))
    s = s.withColumn("__s", F.greatest(F.col("__sf"), cursor)).where(F.col("__ef") > F.col("__s"))
    gap = F.col("__s") - cursor
    first = F.col("__cursor").isNull()
    s = s.withColumns(
        {
            "rest_before": F.when(gap > 1, gap).otherwise(0).cast("bigint"),
            "__absorb": (gap == 1) & ~first,
            "start_f": F.when((gap == 1) & first, cursor).otherwise(F.col("__s")),
        }
    )
    s = scan(s, by, order, slice_by, cut=True, __grow=lead("__absorb"))
    end_f = F.col("__ef") + F.when(F.coalesce(F.col("__grow"), F.lit(False)), 1).otherwise(0)
    return s.withColumn("end_f", end_f).select(*df.columns, "start_f", "end_f", "rest_before")


# Attack length and share, least hold, in frames of 1/93.75 s.
ATTACK_FRAMES, ATTACK_SHARE, HOLD_FRAMES = 15, 0.3, 6


def mora_slots(df: DataFrame, total: str, m: str, mode: Column) -> DataFrame:
    """Frame slots of ``m`` moras in a note of ``total`` frames.

    Mode front: short slots first and the last mora held; back: the first mora
    held and short slots at the tail. Too short notes are split evenly.
    """
    t, n = F.col(total), F.col(m)
    attack = F.greatest(F.lit(1), F.least(F.lit(ATTACK_FRAMES), F.bround(t * ATTACK_SHARE).cast("bigint")))
    even = t < attack * (n - 1) + HOLD_FRAMES
    k = F.col("slot")

    def bound(i: Column) -> Column:
        inner = (
            F.when(even, F.bround(t * i / n).cast("bigint"))
            .when(mode == "back", t - attack * (n - i))
            .otherwise(attack * i)
        )
        return F.when(i <= 0, 0).when(i >= n, t).otherwise(inner)

    slots = df.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return slots.withColumns({"slot_start": bound(k).cast("bigint"), "slot_end": bound(k + 1).cast("bigint")})


def carry_vowel(df, by, order, slice_by, kana: str, vowel: Column, default: str = "ア") -> DataFrame:
    """A leading long mark takes the vowel of the row before it."""
    s = scan(df.withColumn("__v", vowel), by, order, slice_by, __prev=last_known("__v", inclusive=False))
    held = F.concat(F.coalesce(F.col("__prev"), F.lit(default)), F.expr(f"substr({kana}, 2)"))
    return s.withColumn(kana, F.when(F.col(kana).startswith("ー"), held).otherwise(F.col(kana))).drop("__v", "__prev")


def distribute_evenly(items: DataFrame, buckets: DataFrame, by, order, slice_by, n: str) -> DataFrame:
    """Bucket 1..n of each item, the first ``m mod n`` buckets one larger; null when items are too few."""
    by = list(by)
    s = scan(items, by, order, slice_by, __i=row_number())
    sizes = items.groupBy(*by).agg(F.count("*").alias("__m")).join(buckets.select(*by, n), by)
    s = s.join(sizes, by)
    width, extra = F.floor(F.col("__m") / F.col(n)), F.col("__m") % F.col(n)
    wide = extra * (width + 1)
    i = F.col("__i")
    bucket = F.when(i <= wide, F.ceil(i / (width + 1))).otherwise(extra + F.ceil((i - wide) / width))
    return s.withColumn("bucket", F.when(F.col("__m") >= F.col(n), bucket)).drop("__i", "__m", n)


def paginate(df, by, order, slice_by, seconds: str | None = None, per_page=120, max_pages=4, page_seconds=3) -> DataFrame:
    """Even pages: at most ``max_pages``, no more than the time allows; the rest fills the pages up."""
    by = list(by)
    n = F.col("__n")
    pages = F.least(F.lit(max_pages), F.greatest(F.lit(1), F.ceil(n / per_page)))
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"), *([F.max(seconds).alias("__sec")] if seconds else []))
    if seconds:
        timed = F.least(pages, F.greatest(F.lit(1), F.floor(F.col("__sec") / page_seconds)))
        pages = F.when(F.col("__sec") > 0, timed).otherwise(pages)
    sizes = sizes.withColumn("__size", F.ceil(n / pages))
    s = scan(df, by, order, slice_by, __i=row_number()).join(sizes.select(*by, "__size"), by)
    return s.withColumn("page", F.floor((F.col("__i") - 1) / F.col("__size")) + 1).drop("__i", "__size")


def proportional_cuts(df, by, order, slice_by, weight: Column, length: str) -> DataFrame:
    """Share out a text of ``length`` characters by weight; each piece has at least one character.

    The cut after piece i is ``min(L - (n - i), max over j <= i of (round(L*W_j/W) + i - j))``,
    the closed form of pushing every cut one past the one before.
    """
    by = list(by)
    s = scan(
        df.withColumn("__w", F.greatest(F.lit(1), weight)), by, order, slice_by,
        __upto=running_sum("__w"), __i=row_number(),
    )
    sizes = df.withColumn("__w", F.greatest(F.lit(1), weight)).groupBy(*by).agg(
        F.sum("__w").alias("__total"), F.count("*").alias("__n")
    )
    s = s.join(sizes, by)
    target = F.bround(F.col(length) * F.col("__upto") / F.col("__total")).cast("bigint")
    return forward_cuts(s, df.columns, by, order, slice_by, target, length)


def forward_cuts(s, columns, by, order, slice_by, target: Column, length: str) -> DataFrame:
    """``columns`` with the span of each piece: its end is ``target``, moved so that each piece has a character.

    ``s`` holds a piece's number ``__i`` from 1 and their count ``__n``; the last piece ends the text.
    """
    i, n = F.col("__i"), F.col("__n")
    level = F.least(target, F.col(length) - (n - i)) - i
    s = scan(s.withColumn("__level", F.greatest(level, F.lit(0))), by, order, slice_by, cut=True, __top=running_max("__level"))
    cut = F.when(i == n, F.col(length)).otherwise(F.col("__top") + i)
    s = scan(s.withColumn("cut_end", cut), by, order, slice_by, cut=True, __prev_cut=lag("cut_end"))
    return s.withColumn("cut_start", F.coalesce(F.col("__prev_cut"), F.lit(0))).select(*columns, "cut_start", "cut_end")


def keep_newest(df, by, age: Column, max_age, newest: Sequence[Column], keep: int) -> DataFrame:
    """Expire rows by age, then keep the newest ``keep`` per key."""
    from versemill.plans.ordered import top_rows

    return top_rows(df.where(age <= max_age), by, newest, keep)


def expired(df: DataFrame, status: str, terminal: Sequence[str], finished: str, created: str, now, ttl) -> DataFrame:
    """Terminal jobs whose finish (else creation) lies at least ``ttl`` back."""
    return df.where(F.col(status).isin(*terminal) & (F.coalesce(F.col(finished), F.col(created)) <= now - ttl))


def trailing_count(df, by, at: str, order, width, window, counted: Column) -> DataFrame:
    """Counted rows of the key in ``(at - window, at]``, as a difference of running counts.

    A running count and one as-of lookup of the count at ``at - window``:
    nothing is held per key, however many rows a key has.
    """
    from versemill.plans.intervals import asof_join
    from versemill.plans.ordered import by_width

    by = list(by)
    c = scan(
        df.withColumn("__c", counted.cast("bigint")), by, order, by_width(at, width), __upto=running_sum("__c")
    )
    c = materialize(c)
    per_time = c.groupBy(*by, at).agg(F.max("__upto").alias("__cum")).withColumnRenamed(at, "__at")
    c = c.withColumn("__from", F.col(at) - window)
    now = c.join(per_time.select(*by, F.col("__at").alias(at), F.col("__cum").alias("__now")), [*by, at])
    out = asof_join(now, per_time, by, "__from", "__at", ["__cum"], width, cut=True)
    return out.withColumn(
        "recent", F.coalesce(F.col("__now"), F.lit(0)) - F.coalesce(F.col("__cum"), F.lit(0))
    ).select(*df.columns, "recent")


def queue_depth(df, by, order_id: str, start: str, end: str, width) -> DataFrame:
    """Jobs submitted and not finished at each submit, itself included."""
    from versemill.plans.ordered import by_width

    ups = df.select(*by, order_id, F.col(start).alias("__t"), F.lit(1).alias("__d"))
    downs = df.where(F.col(end).isNotNull()).select(*by, order_id, F.col(end).alias("__t"), F.lit(-1).alias("__d"))
    s = scan(
        ups.unionByName(downs), by, ["__t", "__d", order_id], by_width("__t", width), depth=running_sum("__d")
    )
    return s.where(F.col("__d") == 1).select(*by, order_id, F.col("__t").alias(start), "depth")
