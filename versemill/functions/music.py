"""Pitch, time and gain functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Semitones of the note letters C D E F G A B; C4 is 60.
LETTERS = "CDEFGAB"
SEMITONES = (0, 2, 4, 5, 7, 9, 11)
SHARPS, FLATS = ("#", "♯"), ("b", "♭")
# Fixed value: the words before a voice's recommended range.
RANGE_LABEL = "推奨音域"
# Loudness floor, gain limits, headroom in decibels.
SILENCE_DB = -70.0
GAIN_MIN, GAIN_MAX, HEADROOM_DB = 0.15, 0.6, 2.0


def note_name_to_midi(name: Column) -> Column:
    """``A3``, ``C#5``, ``Bb2`` as a note number; null if it is not a note name."""
    name = F.trim(name)
    place = F.instr(F.lit(LETTERS), F.substring(name, 1, 1))
    second = F.substring(name, 2, 1)
    shift = F.when(second.isin(*SHARPS), 1).when(second.isin(*FLATS), -1).otherwise(0)
    octave = F.when(shift == 0, F.substring(name, 2, 12)).otherwise(F.substring(name, 3, 12))
    base = F.get(F.array(*[F.lit(s) for s in SEMITONES]), place - 1)
    whole = (F.length(name) > 1) & (place > 0) & octave.rlike("^-?[0-9]+$")
    return F.when(whole, base + shift + (octave.try_cast("int") + 1) * 12)


def pitch_range(description: Column) -> Column:
    """Ordered (low, high) of the recommended range in a description, or null.

    The range is what the first brackets after the label hold: two note names with a
    tilde between. Wide forms of brackets and tilde count as their narrow ones.
    """
    plain = F.translate(description, "（）～〜", "()~~")
    held = F.split_part(F.split_part(plain, F.lit(RANGE_LABEL), F.lit(2)), F.lit("("), F.lit(2))
    ends = F.split(F.split_part(held, F.lit(")"), F.lit(1)), "~")
    a, b = note_name_to_midi(F.get(ends, F.lit(0))), note_name_to_midi(F.get(ends, F.lit(1)))
    both = held.contains(")") & (F.size(ends) == 2) & a.isNotNull() & b.isNotNull()
    return F.when(both, F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))


def parse_progress(line: Column) -> Column:
    """``progress = 42 %`` as 0.42, kept within 0 .. 1."""
    percent = F.regexp_extract(line, r"progress\s*=\s*(\d+)\s*%", 1)
    share = percent.cast("double") / 100
    return F.when(percent != "", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def accompaniment_gain(vocal_db: Column, backing_db: Column) -> Column:
    """Linear gain that sets the backing ``HEADROOM_DB`` below the vocal."""
    usable = (vocal_db > SILENCE_DB) & (backing_db > SILENCE_DB)
    gain = F.pow(F.lit(10.0), (vocal_db - HEADROOM_DB - backing_db) / 20)
    return F.when(usable, F.least(F.lit(GAIN_MAX), F.greatest(F.lit(GAIN_MIN), gain))).otherwise(GAIN_MAX)
