"""Joins on time and position: tempo maps, grids, spans and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.plans.intervals import asof_join, overlapping_pairs, points_in_spans
from versemill.plans.ordered import by_width, lag, lead, materialize, row_number, running_max, running_sum, scan


def tempo_segments(tempo: DataFrame, by: Sequence[str], tick: str, us_per_beat: str, width: int) -> DataFrame:
    """Tempo rows with the time passed before each: ``base`` in (microseconds times ticks per beat).

    Whole numbers throughout, so that no rounding adds up along a song.
    """
    s = scan(tempo, by, [tick], by_width(tick, width), __pt=lag(tick), __pu=lag(us_per_beat))
    step = F.coalesce((F.col(tick) - F.col("__pt")) * F.col("__pu"), F.lit(0))
    s = scan(s.withColumn("__step", step), by, [tick], by_width(tick, width), cut=True, base=running_sum("__step"))
    return materialize(s.drop("__pt", "__pu", "__step"))


def ticks_to_time(points: DataFrame, segments: DataFrame, by, at: str, tick: str, us_per_beat: str, width: int, out: str = "scaled") -> DataFrame:
    """Time of each tick in (microseconds times ticks per beat); divide by ticks per beat for microseconds."""
    seg = segments.select(*by, F.col(tick).alias("__seg"), F.col(us_per_beat).alias("__us"), F.col("base").alias("__base"))
    seg = seg.withColumn("__at", F.col("__seg"))
    hit = asof_join(points, seg, by, at, "__at", ["__seg", "__us", "__base"], width)
    return hit.withColumn(out, F.col("__base") + (F.col(at) - F.col("__seg")) * F.col("__us")).drop("__seg", "__us", "__base")


def time_to_ticks(points: DataFrame, segments: DataFrame, by, at: str, tick: str, us_per_beat: str, width: int, out: str = "tick") -> DataFrame:
    """Inverse of ``ticks_to_time``: whole tick at or before a scaled time."""
    seg = segments.select(*by, F.col(tick).alias("__seg"), F.col(us_per_beat).alias("__us"), F.col("base").alias("__base"))
    seg = seg.withColumn("__at", F.col("__base"))
    hit = asof_join(points, seg, by, at, "__at", ["__seg", "__us", "__base"], width, tie=["__seg"], cut=True)
    return hit.withColumn(
        out, F.col("__seg") + F.floor((F.col(at) - F.col("__base")) / F.col("__us"))
    ).drop("__seg", "__us", "__base")


def measure_grid(signatures: DataFrame, ends: DataFrame, by, tick: str, num: str, den: str, beat_ticks: int, width: int) -> DataFrame:
    """Measures (start, end, beats) from time signatures; a new signature starts a new measure.

    ``ends`` gives ``end_tick`` per song; the last measure runs past it whole.
    """
    by = list(by)
    s = scan(signatures, by, [tick], by_width(tick, width), __next=lead(tick)).join(ends, by)
    stop = F.coalesce(F.col("__next"), F.greatest(F.col("end_tick"), F.col(tick) + 1))
    length = (F.lit(4 * beat_ticks) * F.col(num) / F.col(den)).cast("bigint")
    m = s.withColumns({"__stop": stop, "__len": length}).where(F.col("__stop") > F.col(tick))
    m = m.withColumn("m_start", F.explode(F.sequence(F.col(tick), F.col("__stop") - 1, F.col("__len"))))
    m_end = F.col("m_start") + F.col("__len")
    m_end = F.when(F.col("__next").isNotNull(), F.least(m_end, F.col("__next"))).otherwise(m_end)
    return m.select(*by, "m_start", m_end.alias("m_end"), F.col(num).alias("beats"), F.col(den).alias("beat_unit"))


def beats_in_measures(measures: DataFrame, by, beat_ticks: int) -> DataFrame:
    step = (F.lit(4 * beat_ticks) / F.col("beat_unit")).cast("bigint")
    return measures.select(
        *by, "m_start", F.explode(F.sequence(F.col("m_start"), F.col("m_end") - 1, step)).alias("beat_tick")
    )


def char_spans(df: DataFrame, by, order, slice_by, text: str) -> DataFrame:
    """Character interval [c0, c1) of each piece of a line."""
    s = scan(df, by, order, slice_by, c1=running_sum(F.length(text).cast("bigint")))
    return s.withColumn("c0", F.col("c1") - F.length(text))


def unit_durations(units: DataFrame, notes: DataFrame, line: Sequence[str], unit: str, length: str, width: int = 64) -> DataFrame:
    """Sum of the lengths of the notes a unit overlaps; the line's mean for units without notes."""
    line, units = list(line), materialize(units)
    pairs = overlapping_pairs(
        units.select(*line, unit, "c0", "c1"), notes.select(*line, F.col("n0"), F.col("n1"), length),
        line, ("c0", "c1"), ("n0", "n1"), width,
    )
    hit = pairs.groupBy(*line, unit).agg(F.sum(length).alias("__sum"))
    mean = hit.groupBy(*line).agg(F.sum("__sum").alias("__t"), F.count("*").alias("__n"))
    return (
        units.join(hit, [*line, unit], "left")
        .join(mean, line, "left")
        .withColumn("duration", F.coalesce(F.col("__sum").cast("double"), F.col("__t") / F.col("__n")))
        .drop("__sum", "__t", "__n")
    )


def length_weights(units: DataFrame, line: Sequence[str], duration: Column, alpha: float) -> DataFrame:
    """Weights ``duration ** alpha`` scaled to a mean of 1 per line."""
    w = units.withColumn("__w", F.pow(duration, F.lit(alpha)))
    mean = w.groupBy(*line).agg(F.avg("__w").alias("__mean"))
    return w.join(mean, list(line)).withColumn("weight", F.col("__w") / F.col("__mean")).drop("__w", "__mean")


def words_to_notes(words: DataFrame, notes: DataFrame, line, word: str, note: str, width: int = 64) -> DataFrame:
    """Notes each word's character interval overlaps, in order."""
    pairs = overlapping_pairs(words.select(*line, word, "c0", "c1"), notes.select(*line, note, "n0", "n1"), line, ("c0", "c1"), ("n0", "n1"), width)
    return pairs.groupBy(*line, word).agg(F.array_sort(F.collect_list(note)).alias("note_ids"))


def frames_per_span(frames: DataFrame, spans: DataFrame, by, span: Sequence[str], at: str, start: str, end: str, slack, width: int) -> DataFrame:
    """(span, frame) rows; spans without a frame are tried again with ``slack`` on both sides."""
    cols = [*by, *span, start, end]
    first = points_in_spans(frames, spans.select(*cols), by, at, start, end, width)
    rest = spans.select(*cols).join(first.select(*span).distinct(), list(span), "left_anti")
    wide = rest.withColumns({start: F.col(start) - slack, end: F.col(end) + slack})
    again = points_in_spans(frames, wide, by, at, start, end, width)
    keep = [c for c in frames.columns if c not in by]
    out = lambda df, retried: df.select(*by, *span, *keep, F.lit(retried).alias("retried"))
    return out(first, False).unionByName(out(again, True))


def split_at_measures(notes: DataFrame, measures: DataFrame, by, note: str, start: str, end: str, width: int) -> DataFrame:
    """Notes cut at measure borders, with tie marks; the lyric stays on the first piece."""
    pairs = overlapping_pairs(notes, measures.select(*by, "m_start", "m_end"), by, (start, end), ("m_start", "m_end"), width)
    first, last = F.col("m_start") <= F.col(start), F.col("m_end") >= F.col(end)
    tie = F.when(first & last, "").when(first, "start").when(last, "stop").otherwise("continue")
    return pairs.select(
        *by, note, F.greatest("m_start", start).alias("piece_start"), F.least("m_end", end).alias("piece_end"),
        tie.alias("tie"), first.alias("has_lyric"),
    )


def snap_to_nearest(targets: DataFrame, beats: DataFrame, by, at: str, beat: str, lo: Column, hi: Column, width: int) -> DataFrame:
    """Closest beat strictly inside (lo, hi), else the target; the earlier beat on a tie."""
    b = beats.select(*by, F.col(beat).alias("b")).distinct().withColumn("__b", F.col("b"))
    t = asof_join(targets, b, by, at, "__b", ["b"], width, direction="both")
    inside = lambda c: F.when((c > lo) & (c < hi), c)
    p, n = inside(F.col("prev_b")), inside(F.col("next_b"))
    nearer = F.when(n.isNull() | (F.col(at) - p <= n - F.col(at)), p).otherwise(n)
    return t.withColumn("snapped", F.coalesce(nearer, n, F.col(at))).drop("prev_b", "next_b")


def sung_gaps(sections: DataFrame, notes: DataFrame, by, start: str, end: str, n_start: str, n_end: str, width: int) -> DataFrame:
    """Time without singing around a section, at least the section itself."""
    ends = notes.select(*by, F.col(n_end).alias("__at")).distinct().withColumn("__prev", F.col("__at"))
    starts = notes.select(*by, F.col(n_start).alias("__at")).distinct().withColumn("__next", F.col("__at"))
    s = asof_join(sections, ends, by, start, "__at", ["__prev"], width)
    s = asof_join(s, starts, by, end, "__at", ["__next"], width, direction="forward", cut=True)
    own = F.col(end) - F.col(start)
    gap = F.when(F.col("__prev").isNotNull() & F.col("__next").isNotNull(), F.greatest(own, F.col("__next") - F.col("__prev"))).otherwise(own)
    return s.withColumn("sung_gap", gap).drop("__prev", "__next")


def snap_to_measure_start(events: DataFrame, measures: DataFrame, by, at: str, width: int) -> DataFrame:
    """Add ``m_start``, the last measure start at or before each event.

    It is the greatest start met so far, so the scan carries plain numbers, which a hash
    aggregation sums up by slice; a start that comes twice changes nothing.
    """
    starts = measures.select(
        *by, F.col("m_start").alias("__t"), F.lit(0).alias("__side"), F.col("m_start").alias("__m"),
        F.lit(None).cast(events.select(F.struct("*")).schema[0].dataType).alias("__l"),
    )
    rows = events.select(
        *by, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(measures.schema["m_start"].dataType).alias("__m"),
        F.struct("*").alias("__l"),
    )
    met = scan(rows.unionByName(starts), by, ["__t", "__side"], by_width("__t", width), m_start=running_max("__m"))
    return met.where(F.col("__l").isNotNull()).select("__l.*", "m_start")


def number_in_measure(pieces: DataFrame, by, start: str, slice_by: Column) -> DataFrame:
    return scan(pieces, by, [start], slice_by, number=row_number())
